"""Ranked, pattern, vector and hybrid search."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import params, scalars
from ..session import spread
from .fulltext import fts_search  # noqa: F401 - part of the search interface
from .running import row_numbers

RRF = 60


def fuzzy(symbols: DataFrame, repo: str, query: str, limit: int | None = None) -> DataFrame:
    """Symbols whose name or qualified name contains the query, case-insensitively, with match_rank.

    0 exact name, 1 exact qualified name, 2 name prefix, 3 otherwise; ties by id. The limit defaults to 20.
    """
    name, qualified = F.col("name"), F.col("qualified_name")
    hits = symbols.where((F.col("repo_name") == repo) & (scalars.like_any(name, query) | scalars.like_any(qualified, query)))
    rank = F.when(name == query, 0).when(qualified == query, 1).when(scalars.like_prefix(name, query), 2).otherwise(3)
    return hits.withColumn("match_rank", rank).orderBy("match_rank", "id").limit(params.limit_or(limit, 20, 1 << 30))


def resolve(symbols: DataFrame, repo: str, name: str) -> DataFrame:
    """At most one symbol: by exact name, else by exact qualified name, else the best fuzzy hit; ties by id.

    A fuzzy hit holds the name as fuzzy() finds it: in any case, with `%` and `_` as wildcards.
    """
    own = symbols.where(F.col("repo_name") == repo)
    n, q = F.col("name"), F.col("qualified_name")
    step = F.when(n == name, 0).when(q == name, 1).when(scalars.like_prefix(n, name), 2).otherwise(3)
    hits = own.where(scalars.like_any(n, name) | scalars.like_any(q, name) | (n == name) | (q == name))
    return hits.withColumn("resolved_by", step).orderBy("resolved_by", "id").limit(1)


def resolve_many(symbols: DataFrame, repo: str, names: DataFrame) -> DataFrame:
    """resolve() for each row of names(input), however many: (input, id), id null where nothing matches.

    Exact names are joined by hash; only what they leave is compared with every symbol, by the same LIKE as resolve()'s.
    """
    own = symbols.where(F.col("repo_name") == repo).select("id", "name", "qualified_name")
    asked = names.select("input").where(F.col("input").isNotNull()).distinct()
    keys = own.select("id", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("name").alias("input")), F.struct(F.lit(1).alias("step"), F.col("qualified_name").alias("input")))).alias("key"))
    exact = keys.select("id", "key.*").join(asked, "input").groupBy("input").agg(F.min(F.struct("step", "id")).alias("best"))
    part = F.concat(F.replace("input", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    left = asked.join(exact, "input", "left_anti").select("input", part.alias("first"), F.concat(F.lit("%"), part).alias("anywhere"))
    close = F.expr("name ilike anywhere or qualified_name ilike anywhere")
    step = F.when(F.expr("name ilike first"), 2).otherwise(3)
    guessed = own.join(left, close).groupBy("input").agg(F.min(F.struct(step.alias("step"), "id")).alias("best"))
    return names.join(exact.unionByName(guessed), "input", "left").select("input", F.col("best.id").alias("id"))


def engine_regex(symbols: DataFrame, pattern: str) -> str:
    """The pattern as the engine runs it; ValueError if the engine does not take it."""
    text = params.engine_pattern(pattern)
    try:
        symbols.sparkSession._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise ValueError(f"invalid pattern: {e}") from None
    return text


def search_patterns(symbols: DataFrame, repo: str, pattern: str, prefix: str = "", kind: str = "", limit: int | None = 50, compatible: bool = False) -> DataFrame:
    """Symbols whose code matches a regular expression: the first match with its byte offsets and a snippet.

    (id, qualified_name, kind, file_path, start_line, match_text, match_start, match_end, snippet), ordered by file, line
    and id. The snippet is the match with 25 bytes on either side, cut to whole characters, and ends in `...` beyond 200
    bytes. limit of 0 or less gives no rows, None all of them. A symbol that lacks the literal of params.required_literal
    cannot match and is not tried. With compatible, at most min(2 * limit, 200) symbols that hold the literal are looked
    at, which can lose rows.
    """
    regex = engine_regex(symbols, pattern)
    rows = symbols.where(F.col("repo_name") == repo)
    if prefix:
        rows = rows.where(scalars.like_prefix(F.col("file_path"), prefix))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    order = ["file_path", "start_line", "id"]
    literal = params.required_literal(pattern)
    if literal:
        rows = rows.where(scalars.like_any(F.col("code_block"), literal))
    if compatible:
        rows = rows.orderBy(*order).limit(50 if limit is None or limit <= 0 else min(2 * limit, 200))
    rows = rows.where(F.col("code_block").rlike(regex))
    text = F.coalesce(F.regexp_substr("code_block", F.lit(regex)), F.lit(""))
    # what stands before the first match; the pattern is in a look-ahead, so its groups keep their numbers
    before = F.regexp_extract("code_block", rf"\A[\s\S]*?(?=(?:{regex}))", 0)
    start = F.octet_length(before)
    first = rows.withColumn("match_text", text).withColumn("match_start", start).withColumn("match_end", start + F.octet_length(text))
    raw = F.encode("code_block", "utf-8")
    a, z = F.greatest(F.lit(0), F.col("match_start") - 25), F.least(F.octet_length("code_block"), F.col("match_end") + 25)
    wide = z - a
    cut = F.substring(raw, a + 1, F.least(wide, F.lit(200)))
    whole = F.regexp_replace(F.decode(cut, "ISO-8859-1"), r"^[\x80-\xBF]+|[\xC0-\xF7][\x80-\xBF]*$", "")
    tail = F.regexp_extract(F.decode(cut, "ISO-8859-1"), r"([\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3})$", 1)
    snippet = F.concat(F.decode(F.encode(F.concat(whole, tail), "ISO-8859-1"), "UTF-8"), F.when(wide > 200, "...").otherwise(""))
    found = first.withColumn("snippet", snippet).select("id", "qualified_name", "kind", "file_path", "start_line", "match_text", "match_start", "match_end", "snippet")
    return found.orderBy(*order) if limit is None else found.orderBy(*order).limit(max(limit, 0))


# vectors


def _products(matrix: np.ndarray, k: int, least: float | None):
    """(row of matrix, symbol_id, similarity) of the vectors of a batch: with k > 0 only the batch's best k of each row.

    Products in double precision; a vector of another length, or null, counts as 0; a product that is no number drops.
    A symbol_id that comes twice in a batch counts once, so its copies take no place among the best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
                lists = batch.column(1).take(pa.array(first))
                sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
                fits = np.flatnonzero(sizes == matrix.shape[1])
                x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
                s = np.zeros((len(matrix), len(ids)))
                with np.errstate(invalid="ignore", over="ignore"):
                    s[:, fits] = matrix @ x.T
                usable = ~np.isnan(s) if least is None else s >= least
                if 0 < k < len(ids):
                    kth = -np.partition(-np.where(usable, s, -np.inf), k - 1, axis=1)[:, k - 1]
                    usable &= s >= kth[:, None]  # ties at the edge stay
                q, v = np.nonzero(usable)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids[v].astype(np.int64)), pa.array(s[q, v])], names=["q", "symbol_id", "similarity"])

    return run


def knn(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, repo: str | None = None) -> DataFrame:
    """(symbol_id, similarity double): the k greatest dot products of at least `least`; k of 0 or less: all. Ties by id.

    A vector of another length counts as 0. Scored in the scan, in blocks; only the best k of each block are shuffled.
    Rows that repeat a symbol_id count once, by their greatest product.
    """
    rows = vectors if repo is None else vectors.where(F.col("repo_name") == repo)
    matrix = np.asarray([query], np.float64)
    scored = rows.where("symbol_id is not null").select("symbol_id", "embedding").mapInArrow(_products(matrix, k, least), "q long, symbol_id long, similarity double")
    near = scored.groupBy("symbol_id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "symbol_id")
    return near.limit(k) if k > 0 else near


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, symbol_id, similarity, place) for a stated query set (query_id, query array), at most 10,000 rows.

    The query set is bounded, so it goes to every row as one matrix for each length of vector; the best k of each block
    are kept before the shuffle. Vectors of another length than the query are no candidates. Rows that repeat a
    query_id or a symbol_id count once.
    """
    stated = queries.select("query_id", "query").dropDuplicates(["query_id"]).limit(10_001).collect()
    if len(stated) > 10_000:
        raise ValueError("a query set holds at most 10,000 vectors")
    spark, parts = vectors.sparkSession, []
    for size in sorted({len(r.query) for r in stated if r.query}):
        own = [r for r in stated if r.query and len(r.query) == size]
        matrix = np.asarray([r.query for r in own], np.float64)
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(own)], "q long, query_id long")
        rows = vectors.where((F.size("embedding") == size) & F.col("symbol_id").isNotNull()).select("symbol_id", "embedding")
        scored = spread(rows).mapInArrow(_products(matrix, k, None), "q long, symbol_id long, similarity double")
        parts.append(scored.join(F.broadcast(names), "q").drop("q"))  # as many rows as there are queries
    if not parts:
        return spark.createDataFrame([], "query_id long, symbol_id long, similarity double, place int")
    once = functools.reduce(DataFrame.unionByName, parts).groupBy("query_id", "symbol_id").agg(F.max("similarity").alias("similarity"))
    salted = once.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(64)))
    order = [F.desc("similarity"), F.col("symbol_id")]
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("r") <= k)
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
    return best.select("query_id", "symbol_id", "similarity", "place")


class VectorCache:
    """A repository's vectors kept in the executors' memory between searches, read again after a change.

    Storage is MEMORY_AND_DISK, so what does not fit spills and a lost executor's part is read again. `version` names
    the state of the stored table: a search with another version than the cached one drops it first, and invalidate()
    drops it at once. One entry a repository.
    """

    def __init__(self):
        self._held: dict[str, tuple[object, DataFrame]] = {}

    def vectors(self, stored: DataFrame, repo: str, version: object) -> DataFrame:
        held = self._held.get(repo)
        if held and held[0] == version:
            return held[1]
        self.invalidate(repo)
        rows = stored.where(F.col("repo_name") == repo).select("symbol_id", "repo_name", "embedding").persist(StorageLevel.MEMORY_AND_DISK)
        self._held[repo] = (version, rows)
        return rows

    def invalidate(self, repo: str) -> None:
        held = self._held.pop(repo, None)
        if held:
            held[1].unpersist()


def _fused(v: DataFrame, t: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, score, similarity, source) of lists with their ranks rv and rt."""
    score = F.coalesce(1.0 / (RRF + F.col("rv")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("rt")), F.lit(0.0))
    source = F.when(F.col("rt").isNull(), "vector").when(F.col("rv").isNull(), "fts").otherwise("both")
    return v.join(t, keys, "full_outer").select(*keys, score.alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), source.alias("source"))


#: Hits of a single search's list that count; the tools ask for 150 at most.
MOST_HITS = 10_000


def rrf(vector_hits: DataFrame, text_hits: DataFrame, keep: int = 0) -> DataFrame:
    """(symbol_id, score, similarity, source) of the two ranked lists of one search, fused by reciprocal ranks.

    vector_hits: (symbol_id, similarity), higher is better; text_hits: (symbol_id, rank), lower is better. Both are
    top-k results; the best MOST_HITS of each are taken, which bounds the windows over them. Longer lists, and many
    searches at once, are for rrf_searches(), which has no bound. source: vector, fts or both; similarity 0 for text hits. Order: score,
    then id; keep > 0 cuts.
    """
    one = Window.partitionBy(F.lit(1))
    v = vector_hits.orderBy(F.desc("similarity"), "symbol_id").limit(MOST_HITS).withColumn("rv", F.row_number().over(one.orderBy(F.desc("similarity"), "symbol_id")))
    t = text_hits.orderBy("rank", "symbol_id").limit(MOST_HITS).withColumn("rt", F.row_number().over(one.orderBy("rank", "symbol_id")))
    fused = _fused(v, t, ["symbol_id"]).orderBy(F.desc("score"), "symbol_id")
    return fused.limit(keep) if keep > 0 else fused


def hybrid(symbols: DataFrame, memories: DataFrame, vector_hits: DataFrame, text_hits: DataFrame, top_k: int = 10, kind: str = "", prefix: str = "", compatible: bool = False) -> DataFrame:
    """Fused hits with their symbols and note counts: (symbol_id, name, kind, file_path, score, similarity, source, memories).

    compatible: the fused list is cut to 2 * top_k before the filters, so fewer rows can come back; otherwise after.
    similarity is rounded to two places. A hit whose symbol is gone is skipped.
    """
    fused = rrf(vector_hits, text_hits, 2 * top_k if compatible else 0)
    counts = memories.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("memories"))
    rows = symbols.withColumnRenamed("id", "symbol_id").join(fused, "symbol_id").join(counts, "symbol_id", "left")
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if prefix:
        rows = rows.where(F.startswith("file_path", F.lit(prefix)))
    shown = rows.select("symbol_id", "name", "kind", "file_path", "score", F.round("similarity", 2).alias("similarity"), "source", F.coalesce("memories", F.lit(0)).alias("memories"))
    return shown.orderBy(F.desc("score"), "symbol_id").limit(top_k)


def rrf_searches(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """(query_id, symbol_id, score, similarity, source): rrf() of every search, of whatever size; in no order.

    vector_hits: (query_id, symbol_id, similarity); text_hits: (query_id, symbol_id, rank); a symbol once a search.
    """
    v = row_numbers(vector_hits, ["query_id"], [F.desc("similarity"), F.col("symbol_id")], "rv")
    t = row_numbers(text_hits, ["query_id"], [F.asc("rank"), F.col("symbol_id")], "rt")
    return _fused(v, t, ["query_id", "symbol_id"])


def hybrid_searches(symbols: DataFrame, memories: DataFrame, vector_hits: DataFrame, text_hits: DataFrame, top_k: int = 10, kind: str = "") -> DataFrame:
    """hybrid() of every search: (query_id, place, symbol_id, name, kind, file_path, score, similarity, source, memories).

    The first top_k of a search are the best of each of 32 salts within it, then the best of those. Scores that differ
    by less than 1e-12 are ties.
    """
    rows = symbols.withColumnRenamed("id", "symbol_id")
    if kind:
        rows = rows.where(F.col("kind") == kind)
    rows = rows.select("symbol_id", "name", "kind", "file_path").join(rrf_searches(vector_hits, text_hits).withColumn("score", F.round("score", 12)), "symbol_id")
    order = [F.desc("score"), F.col("symbol_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(32)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("r") <= top_k)
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top_k)
    counts = memories.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("memories"))
    return best.join(counts, "symbol_id", "left").select("query_id", "place", "symbol_id", "name", "kind", "file_path", "score", F.round("similarity", 2).alias("similarity"), "source", F.coalesce("memories", F.lit(0)).alias("memories"))
