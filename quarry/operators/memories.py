"""Notes on symbols and their life: saved, staled, detached, relinked, purged. All are functions from tables to tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import params, scalars
from ..schema import MAX_NOTE
from .running import row_numbers


def save(memories: DataFrame, new: DataFrame, now: Column | datetime | None = None) -> DataFrame:
    """memories and new_rows(); a store that can append takes those alone."""
    return memories.unionByName(new_rows(memories, new, now))


def new_rows(memories: DataFrame, new: DataFrame, now: Column | datetime | None = None) -> DataFrame:
    """The rows of new(symbol_id, note, author) that are not refused, as rows of memories; ids go on from the greatest.

    Refused: notes over 2,000 characters and notes that the symbol already has word for word, in the table or earlier in
    new; a null symbol is not checked. Other authors than agent and developer become agent.
    """
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    good = new.where(F.col("note").isNotNull() & (F.char_length("note") <= MAX_NOTE)).select("symbol_id", "note", scalars.author(F.col("author")).alias("author"))
    bound = good.where("symbol_id is not null").dropDuplicates(["symbol_id", "note"])
    fresh = bound.join(memories.select("symbol_id", "note"), ["symbol_id", "note"], "left_anti").unionByName(good.where("symbol_id is null").select("symbol_id", "note", "author"))
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = row_numbers(fresh, [], [F.col("symbol_id"), F.col("note"), F.col("author")], "n").join(F.broadcast(top))  # top is one row
    return numbered.select(
        (F.col("top") + F.col("n")).alias("id"), "symbol_id", "note", "author", F.lit(False).alias("is_stale"), F.lit(None).cast("string").alias("stale_reason"),
        F.lit(None).cast("string").alias("last_known_symbol"), F.lit(None).cast("string").alias("last_known_file"), moment.alias("created_at"), moment.alias("updated_at"))


def of_symbols(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes bound to the symbols in ids(id), newest first, ties by id."""
    return memories.join(ids.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi").select(*memories.columns).orderBy(F.desc("created_at"), "id")


def paged(memories: DataFrame, offset: int = 0, limit: int | None = 20) -> DataFrame:
    """Newest first, ties by id; a negative offset is 0, a limit outside 1..100 is 20."""
    return memories.orderBy(F.desc("created_at"), "id").offset(max(offset, 0)).limit(params.in_range_or(limit, 1, 100, 20))


def of_symbol_name(memories: DataFrame, symbols: DataFrame, repo: str, name: str) -> DataFrame:
    """Notes of the symbols whose name or qualified name contains the text, with the symbol's qualified name and file."""
    hits = symbols.where((F.col("repo_name") == repo) & (scalars.like_any(F.col("name"), name) | scalars.like_any(F.col("qualified_name"), name)))
    return memories.join(hits.select(F.col("id").alias("symbol_id"), "qualified_name", "file_path"), "symbol_id")


def of_file(memories: DataFrame, symbols: DataFrame, repo: str, path: str) -> DataFrame:
    hits = symbols.where((F.col("repo_name") == repo) & (F.col("file_path") == path))
    return memories.join(hits.select(F.col("id").alias("symbol_id"), "qualified_name", "file_path"), "symbol_id")


def snapshot_stale(memories: DataFrame, symbols: DataFrame, gone: DataFrame, reason: str | Column) -> DataFrame:
    """All memories, those of the symbols in the files gone(repo_name, file_path) staled and detached.

    Only fresh notes are staled: reason set, qualified name and file kept, symbol_id null. A note that was stale before
    keeps its reason and snapshot; it is detached only if its symbol has a fresh note too.
    """
    hit = symbols.join(gone.select("repo_name", "file_path").distinct(), ["repo_name", "file_path"], "left_semi").select(F.col("id").alias("symbol_id"), "qualified_name", "file_path")
    newly = memories.where("not is_stale").join(hit, "symbol_id", "left_semi").select("symbol_id").distinct().withColumn("newly", F.lit(True))
    wide = memories.join(hit.join(newly, "symbol_id"), "symbol_id", "left")
    touched, fresh = F.coalesce("newly", F.lit(False)), ~F.coalesce("is_stale", F.lit(False))
    why = F.lit(reason) if isinstance(reason, str) else reason
    changed = {
        "symbol_id": F.when(~touched, F.col("symbol_id")),
        "is_stale": F.col("is_stale") | touched,
        "stale_reason": F.when(touched & fresh, why).otherwise(F.col("stale_reason")),
        "last_known_symbol": F.when(touched & fresh, F.col("qualified_name")).otherwise(F.col("last_known_symbol")),
        "last_known_file": F.when(touched & fresh, F.col("file_path")).otherwise(F.col("last_known_file")),
    }
    return wide.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in memories.columns])


def detach(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """symbol_id null for every note of the symbols in ids(id)."""
    gone = ids.select(F.col("id").alias("symbol_id")).distinct().withColumn("gone", F.lit(True))
    wide = memories.join(gone, "symbol_id", "left")
    return wide.select(*[F.when(F.col("gone").isNull(), F.col("symbol_id")).alias(c) if c == "symbol_id" else F.col(c) for c in memories.columns])


def relink(memories: DataFrame, symbols: DataFrame, files: DataFrame, repo: str | None = None) -> DataFrame:
    """All memories; orphans whose snapshot (qualified name, file) names a symbol of an indexed file are bound to it.

    They become fresh, without a reason. Of several symbols the greatest id wins. repo limits the symbols; the orphans
    belong to no repository, so without it a note can be bound across repositories.
    """
    known = symbols if repo is None else symbols.where(F.col("repo_name") == repo)
    indexed = files.select("repo_name", F.col("path").alias("file_path")).distinct()
    homes = known.join(indexed, ["repo_name", "file_path"], "left_semi").groupBy(F.col("qualified_name").alias("last_known_symbol"), F.col("file_path").alias("last_known_file")).agg(F.max("id").alias("home"))
    wide = memories.join(homes, ["last_known_symbol", "last_known_file"], "left")
    bound = F.col("symbol_id").isNull() & F.col("home").isNotNull()
    changed = {
        "symbol_id": F.when(bound, F.col("home")).otherwise(F.col("symbol_id")),
        "is_stale": F.when(bound, F.lit(False)).otherwise(F.col("is_stale")),
        "stale_reason": F.when(~bound, F.col("stale_reason")),
    }
    return wide.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in memories.columns])


def purge_stale(memories: DataFrame, symbols: DataFrame, repo: str, orphaned_only: bool = False) -> DataFrame:
    """memories without the stale ones: orphans of any repository only, or orphans and those bound to the repository."""
    stale, orphan = F.coalesce("is_stale", F.lit(False)), F.col("symbol_id").isNull()
    if orphaned_only:
        return memories.where(~(stale & orphan))
    own = symbols.where(F.col("repo_name") == repo).select(F.col("id").alias("symbol_id")).distinct().withColumn("own", F.lit(True))
    wide = memories.join(own, "symbol_id", "left").where(~(stale & (orphan | F.col("own").isNotNull())))
    return wide.select(*memories.columns)


def orphans_by_key(memories: DataFrame) -> DataFrame:
    """(last_known_symbol, last_known_file, notes long, first_id long) of the notes without a symbol; nulls in the key drop out.

    The notes themselves are orphan_members(): a key may have any number of them, so they are rows and no list.
    """
    return orphan_members(memories).groupBy("last_known_symbol", "last_known_file").agg(F.count(F.lit(1)).alias("notes"), F.min("id").alias("first_id"))


def orphan_members(memories: DataFrame) -> DataFrame:
    """(last_known_symbol, last_known_file, id): each note without a symbol under its key."""
    rows = memories.where("symbol_id is null and last_known_symbol is not null and last_known_file is not null")
    return rows.select("last_known_symbol", "last_known_file", "id")
