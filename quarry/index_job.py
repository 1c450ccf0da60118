"""The incremental index: scan, diff, parse what changed, resolve edges, embed, index the texts, and carry the notes along."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalars
from .functions.embedders import Embedder, hash_embedder
from .operators import diff, fulltext, graph, memories, mutations
from .parse import extract
from .schema import HASH_CHANGED, SYMBOL_DELETED
from .session import spread, staged
from .sources import walk
from .store import Store


@dataclass
class IndexStats:
    """What a run found and did. Files: scanned = new + changed + unchanged; skipped have a known extension but are too
    large, ignored or in a skipped directory. edges_resolved counts before equal edges are merged, edges after."""

    scanned: int = 0
    new: int = 0
    changed: int = 0
    unchanged: int = 0
    deleted: int = 0
    skipped: int = 0
    symbols: int = 0
    edges_found: int = 0
    edges_resolved: int = 0
    edges: int = 0
    vectors: int = 0
    memories_staled: int = 0
    memories_relinked: int = 0
    errors: int = 0
    seconds: float = 0.0


def symbol_id(repo, qualified, path):
    """A stable id: the same symbol has the same id after every index run, so edges and vectors survive."""
    return F.xxhash64(repo, qualified, path).bitwiseAND(F.lit((1 << 62) - 1))


def index(spark: SparkSession, root: str, repo: str, store: Store, force: bool = False, embed: Embedder | None = None, attribution: str = "file", only: DataFrame | None = None) -> IndexStats:
    """Brings the stored parts of one repository up to date with the tree under root.

    Files are hashed first; only what is new or changed is read again, parsed once and kept as text for no longer than
    that. force parses every file again and, as the notes then keep their symbols, stales none. only: a table of paths
    (path), as a watcher hands it over; no other file is looked at. Without changes nothing is written; with them the
    parts of this repository alone, in one commit. Edges are resolved for the changed files against all symbols; edges,
    vectors and texts of symbols that are gone are dropped. Vectors of another embedder, or another dimension, than
    `embed` are all made anew, so a part never mixes two.
    """
    began, stats, embed = time.time(), IndexStats(), embed or hash_embedder()
    stored = store.read("files", repo)
    if only is None:
        disk, own = walk.scan(spark, root, repo, with_content=False), stored
    else:
        allowed = walk.listing(spark, root).join(only.select("path").distinct(), "path", "left_semi").select("path")
        disk, own = walk.read_files(spark, root, repo, allowed).drop("content"), stored.join(only.select("path").distinct(), "path", "left_semi")
    disk = staged(disk, "scan")
    states = staged(diff.incremental(disk.select("path", "content_hash"), own.select("path", "content_hash"), force), "states")
    counts = diff.index_stats(states).first()
    stats.scanned, stats.new, stats.changed, stats.unchanged, stats.deleted = counts
    same_embedder = store.meta(f"embedder:{repo}", [embed.name, embed.dimension]) == [embed.name, embed.dimension]
    if not (stats.new or stats.changed or stats.deleted) and same_embedder:
        stats.seconds = time.time() - began
        return stats
    fresh_paths = states.where("state in ('new', 'changed')").select("path")
    gone = states.where("state in ('changed', 'deleted')").select(F.lit(repo).alias("repo_name"), F.col("path").alias("file_path"), "state")
    changed = disk.join(fresh_paths, "path", "left_semi")
    parsed_files = staged(extract.parse_files(spread(walk.read_files(spark, root, repo, fresh_paths))), "parsed")

    symbols_before, edges_before = store.read("symbols", repo), store.read("dependencies", repo)
    extracted = extract.symbol_rows(parsed_files).withColumn("seq", F.col("start_line"))
    keyed = mutations.last_wins(extracted, ["repo_name", "qualified_name", "file_path"], "seq")
    parsed = staged(keyed.withColumn("id", symbol_id("repo_name", "qualified_name", "file_path")).withColumn("indexed_at", F.current_timestamp()).select(*symbols_before.columns), "symbols")
    found = parsed_files.agg(F.coalesce(F.sum(F.size("edges")), F.lit(0)), F.count("error")).first()
    stats.symbols, stats.edges_found, stats.errors = parsed.count(), found[0], found[1]
    stats.skipped = walk.skipped(spark, root) if only is None else 0

    # notes first, while the symbols they are bound to can still be seen; those of no repository too
    note_parts = [p for p in dict.fromkeys([repo, ""]) if store.exists("memories", p)]
    before = {p: store.read("memories", p) for p in note_parts}
    notes = dict(before)
    if not force:
        for part in note_parts:
            for state, reason in (("changed", HASH_CHANGED), ("deleted", SYMBOL_DELETED)):
                notes[part] = memories.snapshot_stale(notes[part], symbols_before, gone.where(F.col("state") == state), reason)
            notes[part] = staged(notes[part], "notes")
            stats.memories_staled += notes[part].join(before[part].where("not is_stale").select("id"), "id", "left_semi").where("is_stale").count()

    kept = mutations.without_files(symbols_before, gone)
    symbols_after = staged(kept.unionByName(parsed), "all-symbols")
    files_new = changed.select(
        F.xxhash64("repo_name", "path").alias("id"), "repo_name", "path", "content_hash", F.current_timestamp().alias("last_indexed"), "size_bytes")
    files_kept = mutations.without_files(stored, gone, "path").select(*files_new.columns)
    files_after = staged(files_kept.unionByName(files_new), "files")

    raw = extract.edge_rows(parsed_files).where(F.col("kind") != "import")
    resolved = staged(graph.resolved(raw, symbols_after, repo, attribution), "resolved")
    stats.edges_resolved = resolved.count()
    old_edges = mutations.without_edges_of_files(edges_before, symbols_before, gone)
    edges_after = staged(mutations.live_edges(mutations.add_edges(old_edges, resolved.distinct()), symbols_after), "edges")
    stats.edges = edges_after.count()

    changes: dict[tuple[str, str], DataFrame | None] = {}
    for part in note_parts:
        relinked = staged(memories.relink(notes[part], symbols_after, files_after, repo), "relinked")
        stats.memories_relinked += notes[part].where("symbol_id is null").select("id").join(relinked.where("symbol_id is not null").select("id"), "id", "left_semi").count()
        changes["memories", part] = relinked

    words = graph.callee_words(edges_after, symbols_after)
    to_embed = parsed if same_embedder else symbols_after
    new_vectors = staged(_vectors(to_embed, words, embed), "vectors")
    stats.vectors = new_vectors.count()
    others = symbols_after.join(to_embed.select("id"), "id", "left_anti").select(F.col("id").alias("symbol_id"))
    old_vectors = store.read("vec_symbols", repo).join(others, "symbol_id", "left_semi").select("symbol_id", "repo_name", "embedding")

    indexed = store.exists("fts_postings", repo)
    texts = staged(fulltext.documents(parsed if indexed else symbols_after, words), "texts")
    changes |= {
        ("files", repo): files_after, ("symbols", repo): symbols_after, ("dependencies", repo): edges_after, ("vec_symbols", repo): old_vectors.unionByName(new_vectors),
        ("fts_postings", repo): _kept(store, "fts_postings", repo, gone, indexed).unionByName(fulltext.postings(texts, stemmed=True)),
        ("fts_lengths", repo): _kept(store, "fts_lengths", repo, gone, indexed).unionByName(fulltext.lengths(texts)),
    }
    store.commit(changes, {f"embedder:{repo}": [embed.name, embed.dimension]})
    stats.seconds = time.time() - began
    return stats


def forget(store: Store, repo: str) -> None:
    """Drops all parts of a repository, its vectors and full-text rows among them; notes stay, without a symbol."""
    own = store.read("symbols", repo).select("id")
    changes: dict[tuple[str, str], DataFrame | None] = {("memories", p): memories.detach(store.read("memories", p), own) for p in dict.fromkeys([repo, ""]) if store.exists("memories", p)}
    for name in ("files", "symbols", "dependencies", "vec_symbols", "routes", "fts_postings", "fts_lengths"):
        changes[name, repo] = None
    store.commit(changes)


def _kept(store: Store, name: str, repo: str, gone: DataFrame, indexed: bool) -> DataFrame:
    """The stored full-text rows of the files that are still as they were."""
    rows = store.read(name, repo)
    return mutations.without_files(rows, gone) if indexed else rows.limit(0)


def _vectors(symbols: DataFrame, words: DataFrame, embed: Embedder) -> DataFrame:
    """Vectors of the symbols' embedding texts, the callees' names among their keywords."""
    rows = symbols.join(words.withColumnRenamed("caller_id", "id"), "id", "left")
    keywords = scalars.keywords(F.col("code_block"), F.col("kind"), F.col("names"))
    text = scalars.embed_text(F.col("kind"), F.col("qualified_name"), F.col("code_block"), keywords)
    return rows.select(F.col("id").alias("symbol_id"), "repo_name", embed.column(text).alias("embedding"))
