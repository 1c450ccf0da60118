"""Ranked, pattern, full-text, vector and hybrid search as registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import fulltext, graph, lookup, mutations, search
from ..session import scratch, staged, table
from .views import REPO, sql, symbols, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERM = "re"


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text.replace("$REPO", f"'{REPO}'"), **{k: v.replace("$REPO", f"'{REPO}'") for k, v in more.items()})
        return f

    return add


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The parameter of the vector queries: the usable vector with the smallest id; one row."""
    usable = table(spark, sf, "vec_symbols").where((F.size("embedding") == 128) & ~F.exists("embedding", F.isnan))
    row = usable.orderBy("symbol_id").select("embedding").first()
    return [float(x) for x in row.embedding] if row else [0.0] * 128


_RANK = "CASE WHEN name = 're' THEN 0 WHEN qualified_name = 're' THEN 1 WHEN name ILIKE 're%' THEN 2 ELSE 3 END"


@query(f"SELECT id, name, qualified_name, kind, file_path, {_RANK}::INTEGER AS match_rank FROM sym WHERE repo_name = $REPO AND (name ILIKE '%re%' OR qualified_name ILIKE '%re%') ORDER BY match_rank, id LIMIT 20")
def fuzzy_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy(symbols(spark, sf), REPO, TERM).select("id", "name", "qualified_name", "kind", "file_path", "match_rank")


@query(f"SELECT id, qualified_name, resolved_by FROM (SELECT id, qualified_name, {_RANK}::INTEGER AS resolved_by FROM sym WHERE repo_name = $REPO AND (name ILIKE '%re%' OR qualified_name ILIKE '%re%')) ORDER BY resolved_by, id LIMIT 1")
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return search.resolve(symbols(spark, sf), REPO, TERM).select("id", "qualified_name", "resolved_by")


@query(
    "SELECT n.input, arg_min(s.id, struct_pack(step := CASE WHEN s.name = n.input THEN 0 WHEN s.qualified_name = n.input THEN 1 WHEN regexp_matches(s.name, '^' || n.re) THEN 2 ELSE 3 END, id := s.id)) AS id FROM names n"
    " LEFT JOIN own s ON s.name = n.input OR s.qualified_name = n.input OR regexp_matches(s.name, n.re) OR regexp_matches(s.qualified_name, n.re) GROUP BY n.input",
    own="SELECT id, name, qualified_name FROM sym WHERE repo_name = $REPO",
    names="SELECT DISTINCT input, '(?is)' || replace(replace(regexp_escape(input), '_', '.'), '\\%', '.*') AS re FROM (SELECT name AS input FROM own UNION ALL SELECT unnest(['re', 'shard', 'no such symbol', 'Queue', 'et_rom', 're%er', 'QUEUE.']))",
)
def resolve_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every name of the repository, far more than a tool's batch, and some that only match in part or by a wildcard.

    The SQL turns the names into regular expressions, where the operator uses LIKE.
    """
    own = symbols(spark, sf)
    some = spark.sql("SELECT * FROM VALUES ('re'), ('shard'), ('no such symbol'), ('Queue'), ('et_rom'), ('re%er'), ('QUEUE.') AS t(input)")
    names = own.where(F.col("repo_name") == REPO).select(F.col("name").alias("input")).unionByName(some).distinct()
    return search.resolve_many(own, REPO, names)


@query("SELECT id, name, qualified_name, file_path FROM sym WHERE repo_name = $REPO AND qualified_name = (SELECT max(qualified_name) FROM sym WHERE repo_name = $REPO) ORDER BY id LIMIT 1")
def symbol_by_qualified_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf)
    name = table(spark, sf, "symbols").where(F.col("repo_name") == REPO).agg(F.max("qualified_name")).first()[0] or ""  # the parameter of the lookup
    return lookup.symbol_by(rows, REPO, "qualified_name", name).select("id", "name", "qualified_name", "file_path")


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf, "code_block")


@query("SELECT id, file_path, start_line FROM sym WHERE repo_name = $REPO AND code_block ILIKE '%return%' AND regexp_matches(code_block, 'return [a-z]+') ORDER BY file_path, start_line, id LIMIT 50",)
def regex_pattern_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_patterns(_code(spark, sf), REPO, "return [a-z]+").select("id", "file_path", "start_line")


@query("SELECT id, file_path, start_line FROM (SELECT * FROM sym WHERE repo_name = $REPO AND code_block ILIKE '%return%' ORDER BY file_path, start_line, id LIMIT 100) WHERE regexp_matches(code_block, 'return [a-z]+') ORDER BY file_path, start_line, id LIMIT 50")
def regex_literal_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_patterns(_code(spark, sf), REPO, "return [a-z]+", compatible=True).select("id", "file_path", "start_line")


#: The snippet by characters: as many as fit into 25 bytes on either side of the match; the matches asked for are short.
_AROUND = {
    "parts": "SELECT *, left(code_block, pos::BIGINT - 1) AS before, substr(code_block, (pos + length(match_text))::BIGINT) AS behind FROM (SELECT *, instr(code_block, match_text) AS pos FROM found)",
    "sized": "SELECT *, list_max(list_filter(range(0, 26), lambda k: octet_length(encode(right(before, k))) <= 25)) AS l, list_max(list_filter(range(0, 26), lambda k: octet_length(encode(left(behind, k))) <= 25)) AS r FROM parts",
}
_SNIPPET = "SELECT id, file_path, start_line, match_text, octet_length(encode(before))::INTEGER AS match_start, (octet_length(encode(before)) + octet_length(encode(match_text)))::INTEGER AS match_end, right(before, l) || match_text || left(behind, r) AS snippet FROM sized"
_SHOWN = ["id", "file_path", "start_line", "match_text", "match_start", "match_end", "snippet"]


@query(_SNIPPET, found="SELECT id, file_path, start_line, code_block, regexp_extract(code_block, '[a-z]+Ring\\w*') AS match_text FROM sym WHERE repo_name = $REPO AND regexp_matches(code_block, '[a-z]+Ring\\w*')", **_AROUND)
def first_match_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_patterns(_code(spark, sf), REPO, "[a-z]+Ring\\w*", limit=None).select(*_SHOWN)


@query(_SNIPPET, found="SELECT id, file_path, start_line, code_block, regexp_extract(code_block, '$LETTERS') AS match_text FROM sym WHERE repo_name = $REPO AND regexp_matches(code_block, '$LETTERS')".replace("$LETTERS", "|".join(2 * c for c in "abcdefghijklmnopqrstuvwxyz")), **_AROUND)
def regex_back_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The first double letter of every block, by a named group and a reference to it; SQL lists the doubles."""
    return search.search_patterns(_code(spark, sf), REPO, "(?P<letter>[[:lower:]])(?P=letter)", limit=None).select(*_SHOWN)


@query("SELECT id, file_path FROM sym WHERE repo_name = $REPO AND kind = 'function' AND file_path ILIKE 'SRC/%' AND regexp_matches(code_block, 'for|while') ORDER BY file_path, start_line, id")
def regex_prefix_and_kind(spark: SparkSession, sf: str) -> DataFrame:
    """An alternation, which no literal can stand for, under a path prefix in any case and a kind."""
    return search.search_patterns(_code(spark, sf), REPO, "for|while", "SRC/", "function", None).select("id", "file_path")


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_NAME = "[a-zA-Z][a-zA-Z0-9_]{2,}"
_WORDS = (
    "list_concat(CASE WHEN s.kind IN ('function', 'method') THEN list_concat(regexp_extract_all(s.code_block, '[A-Z][a-zA-Z]*(?:Error|Exception|Timeout|Failure)'), regexp_extract_all(s.code_block, '(?:except|catch|rescue)\\s+\\(?([A-Za-z_][\\w.]*)', 1),"
    " list_filter(['retry', 'fallback', 'timeout', 'backoff', 'cache', 'throttle', 'circuit_breaker', 'rate_limit', 'rollback', 'compensate'], lambda b: contains(lower(s.code_block), b))) ELSE [] END, coalesce(c.names, []),"
    " list_filter(regexp_extract_all(split_part(s.code_block, chr(10), 1), '\\b[A-Z][a-zA-Z0-9]+\\b'), lambda w: w NOT IN ('Func', 'True', 'False', 'None', 'String', 'Int', 'Bool', 'Float')),"
    f" CASE WHEN s.kind IN ('variable', 'constant') THEN list_filter(list_transform(regexp_extract_all(s.code_block, '\\b{_NAME}\\b'), lambda w: lower(w)), lambda w: w NOT IN ('var', 'const', 'let', 'new', 'nil', 'null', 'true', 'false', 'string', 'int', 'bool', 'float')) ELSE [] END)"
)
_FTS = {
    "callees": "SELECT d.caller_id, list(s.name) AS names FROM dep d JOIN sym s ON s.id = d.callee_id GROUP BY d.caller_id",
    "words": f"SELECT s.id, list_sort(list_distinct(list_filter(list_transform({_WORDS}, lambda w: lower(w)), lambda w: strlen(w) > 2)))[1:30] AS w FROM sym s LEFT JOIN callees c ON c.caller_id = s.id",
    "texts": "SELECT s.id, s.repo_name, s.file_path, unnest([s.name, s.qualified_name, s.kind, split_part(s.code_block, chr(10), 1), array_to_string(words.w, ' ')]) AS text FROM sym s JOIN words ON words.id = s.id",
    "toks": f"SELECT id, repo_name, file_path, {_TOKENS} AS w FROM texts",
    "sizes": "SELECT id, repo_name, sum(len(w)) AS dl FROM toks GROUP BY id, repo_name",
    "tot": "SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM sizes",
}
_HITS = {**_FTS, "hits": "SELECT id, sum(len(list_filter(w, lambda x: x = 'shard')))::DOUBLE AS tf FROM toks GROUP BY id HAVING sum(len(list_filter(w, lambda x: x = 'shard'))) > 0"}
_PHRASE = {**_FTS, "hits": "SELECT id, sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'func' AND w[i + 1] = 'x')))::DOUBLE AS tf FROM toks GROUP BY id HAVING sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'func' AND w[i + 1] = 'x'))) > 0"}
_BM25 = "-greatest(ln((n - (SELECT count(*) FROM hits) + 0.5) / ((SELECT count(*) FROM hits) + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the service's index: five columns, the keywords with the callees' names among them."""
    rows = symbols(spark, sf, "code_block")
    return staged(fulltext.documents(rows, graph.callee_words(view(spark, sf, "dependencies"), rows)), "texts")  # read for postings and lengths


def _index(spark: SparkSession, sf: str, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index as it is stored: postings by term, and lengths."""
    texts, out = _texts(spark, sf), scratch(spark, "postings")
    rows = fulltext.postings(texts, stemmed)
    fulltext.arranged(rows).write.parquet(out)
    return spark.read.schema(rows.schema).parquet(out), fulltext.lengths(texts)


@query(f"SELECT h.id AS symbol_id, round({_BM25}, 6) AS rank FROM hits h JOIN sizes s ON s.id = h.id, tot WHERE s.repo_name = $REPO", **_HITS)
def fts_term_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(*_index(spark, sf), REPO, "shard", 1 << 30).select("symbol_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT h.id AS symbol_id, round({_BM25}, 6) AS rank FROM hits h JOIN sizes s ON s.id = h.id, tot WHERE s.repo_name = $REPO", **_PHRASE)
def fts_phrase_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(*_index(spark, sf), REPO, "Func (x", 1 << 30).select("symbol_id", F.round("rank", 6).alias("rank"))


#: Words of which Porter's stemmer makes `shard`, and no others that end in what it takes off: SQL knows no stemmer.
_STEM_HITS = {**_FTS, "hits": "SELECT id, sum(len(list_filter(w, lambda x: regexp_matches(x, '^shard(s|ed|ing|er|ers|ings)?$') AND x NOT IN ('sharder', 'sharders', 'shardings'))))::DOUBLE AS tf FROM toks GROUP BY id HAVING sum(len(list_filter(w, lambda x: regexp_matches(x, '^shard(s|ed|ing)?$')))) > 0"}


@query(f"SELECT h.id AS symbol_id, round({_BM25}, 6) AS rank FROM hits h JOIN sizes s ON s.id = h.id, tot WHERE s.repo_name = $REPO", **_STEM_HITS)
def fts_term_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """A term with both sides stemmed, as the service searches."""
    return fulltext.search(*_index(spark, sf, True), REPO, "sharding", 1 << 30, stemmed=True).select("symbol_id", F.round("rank", 6).alias("rank"))


@query(
    "SELECT term, count(*)::BIGINT AS \"columns\", sum(n)::BIGINT AS occurrences FROM (SELECT id, c, term, count(*) AS n FROM (SELECT id, c, unnest(w) AS term FROM numbered) GROUP BY ALL) GROUP BY term",
    **_FTS, gone="SELECT DISTINCT repo_name, path AS file_path FROM fil WHERE id % 5 = 0",
    numbered="SELECT id, w, row_number() OVER () AS c FROM toks t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_name = t.repo_name AND g.file_path = t.file_path) AND t.repo_name <> $REPO",
)
def fts_index_after_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of the index after the rows of some files, and of one repository, were deleted from it."""
    gone = view(spark, sf, "files", ["id", "repo_name", "path"]).where("id % 5 = 0").select("repo_name", F.col("path").alias("file_path"))
    postings, _ = _index(spark, sf)
    left = mutations.without_repo(mutations.without_files(postings, gone), REPO)
    per_column = left.groupBy("term", "symbol_id", "column").agg(F.count(F.lit(1)).alias("n"))
    return per_column.groupBy("term").agg(F.count(F.lit(1)).alias("columns"), F.sum("n").alias("occurrences"))


_GOOD = "SELECT symbol_id, repo_name, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vec WHERE embedding IS NOT NULL"
_Q = "SELECT e FROM good WHERE len(e) = 128 AND len(list_filter(e, lambda x: isnan(x))) = 0 ORDER BY symbol_id LIMIT 1"
_SIMS = "SELECT g.symbol_id, g.repo_name, CASE WHEN len(g.e) = len(q.e) THEN list_inner_product(g.e, q.e) ELSE 0.0 END AS s FROM good g, q"


@query("SELECT symbol_id, round(s, 4) AS similarity FROM sims WHERE NOT isnan(s) AND s >= 0 ORDER BY s DESC, symbol_id LIMIT 10", good=_GOOD, q=_Q, sims=_SIMS)
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(table(spark, sf, "vec_symbols"), query_vector(spark, sf), 10).select("symbol_id", F.round("similarity", 4).alias("similarity"))


@query("SELECT symbol_id, round(s, 4) AS similarity FROM sims WHERE NOT isnan(s) AND s >= 0.1 AND repo_name = $REPO", good=_GOOD, q=_Q, sims=_SIMS)
def knn_min_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(table(spark, sf, "vec_symbols"), query_vector(spark, sf), 0, 0.1, REPO).select("symbol_id", F.round("similarity", 4).alias("similarity"))


@query(
    "SELECT query_id, symbol_id, round(s, 4) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, symbol_id)::INTEGER AS place FROM sims WHERE NOT isnan(s)) WHERE place <= 5",
    good=_GOOD, qs="SELECT symbol_id AS query_id, e FROM good WHERE symbol_id % 100 = 0 AND len(e) = 128",
    sims="SELECT query_id, g.symbol_id, list_inner_product(g.e, qs.e) AS s FROM good g JOIN qs ON len(g.e) = len(qs.e)",
)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 100, a stated query set, against all vectors."""
    vectors = table(spark, sf, "vec_symbols").where("embedding is not null")
    queries = vectors.where((F.col("symbol_id") % 100 == 0) & (F.size("embedding") == 128)).select(F.col("symbol_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn_batch(vectors, queries, 5).select("query_id", "symbol_id", F.round("similarity", 4).alias("similarity"), "place")


@query("SELECT symbol_id, round(s, 4) AS similarity FROM sims WHERE NOT isnan(s) AND s >= 0 AND repo_name = $REPO ORDER BY s DESC, symbol_id LIMIT 10", good=_GOOD, q=_Q, sims=_SIMS)
def knn_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The second search of one repository: its vectors are in the executors' memory."""
    stored, cache = table(spark, sf, "vec_symbols"), search.VectorCache()
    cache.vectors(stored, REPO, "v1").count()
    found = search.knn(cache.vectors(stored, REPO, "v1"), query_vector(spark, sf), 10).select("symbol_id", F.round("similarity", 4).alias("similarity"))
    found = staged(found, "found")
    cache.invalidate(REPO)
    return found


_LISTS = {
    "v": "SELECT query_id, symbol_id, max(similarity_score)::DOUBLE AS similarity FROM semantic_results WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL AND similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY query_id, symbol_id",
    "t": "SELECT query_id, symbol_id, min(fts_rank) AS rank FROM fts_results WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL AND fts_rank IS NOT NULL AND NOT isnan(fts_rank) GROUP BY query_id, symbol_id",
    "rv": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, symbol_id) AS r FROM v",
    "rt": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, symbol_id) AS r FROM t",
    "fused": "SELECT coalesce(rv.query_id, rt.query_id) AS query_id, coalesce(rv.symbol_id, rt.symbol_id) AS symbol_id, coalesce(1.0::DOUBLE / (60 + rv.r), 0) + coalesce(1.0::DOUBLE / (60 + rt.r), 0) AS score, coalesce(rv.similarity, 0) AS similarity, CASE WHEN rt.r IS NULL THEN 'vector' WHEN rv.r IS NULL THEN 'fts' ELSE 'both' END AS source FROM rv FULL JOIN rt ON rv.query_id = rt.query_id AND rv.symbol_id = rt.symbol_id",
}


def _hit_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    semantic, fts = table(spark, sf, "semantic_results"), table(spark, sf, "fts_results")
    score, rank, named = F.col("similarity_score").cast("double"), F.col("fts_rank"), F.col("query_id").isNotNull() & F.col("symbol_id").isNotNull()
    v = semantic.where(named & score.isNotNull() & ~F.isnan(score)).groupBy("query_id", "symbol_id").agg(F.max(score).alias("similarity"))
    t = fts.where(named & rank.isNotNull() & ~F.isnan(rank)).groupBy("query_id", "symbol_id").agg(F.min(rank).alias("rank"))
    return v, t


@query("SELECT query_id, symbol_id, round(score, 6) AS score, round(similarity, 4) AS similarity, source FROM fused", **_LISTS)
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The fused lists of all searches."""
    found = search.rrf_searches(*_hit_lists(spark, sf))
    return found.select("query_id", "symbol_id", F.round("score", 6).alias("score"), F.round("similarity", 4).alias("similarity"), "source")


@query(
    "SELECT query_id, place::INTEGER AS place, symbol_id, name, kind, file_path, round(score, 6) AS score, round(similarity, 2) AS similarity, source, (SELECT count(*) FROM mem WHERE mem.symbol_id = best.symbol_id)::BIGINT AS memories FROM best WHERE place <= 10",
    **_LISTS,
    best="SELECT f.*, s.name, s.kind, s.file_path, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 12) DESC, f.symbol_id) AS place FROM fused f JOIN sym s ON s.id = f.symbol_id WHERE s.kind = 'function'",
)
def hybrid_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten functions of all searches."""
    found = search.hybrid_searches(symbols(spark, sf), view(spark, sf, "memories", ["id", "symbol_id"]), *_hit_lists(spark, sf), kind="function")
    return found.withColumn("score", F.round("score", 6))
