"""The registered queries of problems 1-4 and 6-9, and their SQL where SQL can say it at this size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged, table
from . import encoding, fusion, generated, neardup, neighbours, packing, paragraphs, spans, splitting


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, sf_dir, "symbols"))
    return neardup.expanded_pairs(members, links)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol with enough words: its class of equal bags, and how many other classes it is linked to."""
    members, links = neardup.near_duplicates(table(spark, sf_dir, "symbols"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("symbol_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generated.file_origins(table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols"), usage=False)
    return found.where("origin is not null").select("file_id").distinct()


def p2_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.file_origins(table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_blocks(table(spark, sf_dir, "symbols"))


def p3_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical-cohesion form of problem 3, with the same window and overlap."""
    return splitting.split_blocks(table(spark, sf_dir, "symbols"), splitting.cohesion_cuts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf_dir, "vec_symbols"))


def _scores(spark: SparkSession, sf_dir: str) -> list:
    return [(table(spark, sf_dir, "semantic_results"), "similarity_score", True), (table(spark, sf_dir, "fts_results"), "fts_rank", False)]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_places(_scores(spark, sf_dir))


def p6_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6 by the first principal component of the rank-transformed scores."""
    return fusion.component_places(_scores(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_items(encoding.token_sizes(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p8_containers(spark, sf_dir))


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every container holds, no text is split without need, and few containers are more than the least number."""
    sizes = staged(encoding.token_sizes(table(spark, sf_dir, "documents")), "sizes")
    return packing.audit(sizes, staged(packing.pack_items(sizes), "packed"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_stretches(table(spark, sf_dir, "documents"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with others."""
    documents = table(spark, sf_dir, "documents")
    return spans.shared_share(documents, spans.shared_stretches(documents))


def p9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9 by the method named: clusters of near-duplicate paragraphs, and which paragraph of each is kept."""
    return paragraphs.near_duplicate_paragraphs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_origins, p3_found, p3_cohesion, p4_found, p6_found, p6_component, p7_ids, p8_containers, p8_fill, p8_audit, p9_found, p9_share, p9_paragraphs)}

_BAGS = """
WITH blocks AS (SELECT DISTINCT id, code_block FROM symbols),
words AS (SELECT id, unnest(regexp_extract_all(code_block, '[A-Za-z0-9_]+')) AS word FROM blocks),
bags AS (SELECT id, word, count(*) AS n FROM words GROUP BY id, word),
sizes AS (SELECT id, sum(n) AS total, string_agg(word || ' ' || n, ',' ORDER BY word) AS bag FROM bags GROUP BY id HAVING sum(n) >= 40),
classes AS (SELECT id, min(id) OVER (PARTITION BY bag) AS rep FROM sizes),
kept AS (SELECT b.id, word, n, total FROM bags b JOIN sizes s ON s.id = b.id WHERE b.id IN (SELECT rep FROM classes)),
met AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS low, any_value(a.total + b.total) AS total
         FROM kept a JOIN kept b ON a.word = b.word AND a.id < b.id AND least(a.total, b.total) >= 0.8 * greatest(a.total, b.total) GROUP BY 1, 2),
linked AS (SELECT unnest([a, b]) AS rep FROM met WHERE 10 * low >= 8 * (total - low))
"""
_SHARED = r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 128),
runs AS (SELECT doc_id, t.i, md5(substr(text, (t.i + 1)::BIGINT, 128)) AS r FROM texts, unnest(range(0, length(text) - 127)) AS t(i)),
shared AS (SELECT r FROM runs GROUP BY r HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, i FROM runs WHERE r IN (SELECT r FROM shared)),
steps AS (SELECT doc_id, i, least(128, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 128)) AS own FROM hits),
sums AS (SELECT doc_id, sum(own)::BIGINT AS shared_chars FROM steps GROUP BY doc_id)
"""

SQL = {
    "p1_found": """
WITH blocks AS (SELECT DISTINCT id, code_block FROM symbols),
words AS (SELECT id, unnest(regexp_extract_all(code_block, '[A-Za-z0-9_]+')) AS word FROM blocks),
bags AS (SELECT id, word, count(*) AS n FROM words GROUP BY id, word),
sizes AS (SELECT id, sum(n) AS total FROM bags GROUP BY id HAVING sum(n) >= 40),
kept AS (SELECT b.id, word, n, total FROM bags b JOIN sizes s ON s.id = b.id),
met AS (SELECT a.id AS symbol_a, b.id AS symbol_b, sum(least(a.n, b.n)) AS low, any_value(a.total + b.total) AS total
         FROM kept a JOIN kept b ON a.word = b.word AND a.id < b.id AND least(a.total, b.total) >= 0.8 * greatest(a.total, b.total) GROUP BY 1, 2)
SELECT symbol_a, symbol_b FROM met WHERE 10 * low >= 8 * (total - low)
""",
    "p2_found": r"""
WITH f AS (SELECT id AS file_id, repo_name, path, max(size_bytes) AS size_bytes FROM files GROUP BY ALL),
s AS (SELECT repo_name, file_path, max(end_line) AS last_line, count(DISTINCT qualified_name) AS names, count(*) FILTER (WHERE kind <> 'variable') AS others FROM symbols GROUP BY ALL)
SELECT DISTINCT file_id FROM f LEFT JOIN s ON s.repo_name = f.repo_name AND s.file_path = f.path
WHERE regexp_matches(path, '(^|/)(third_party|thirdparty|3rdparty|vendor|_vendor|node_modules|bower_components|site-packages|Pods|Carthage)/')
  OR path LIKE '%Godeps/_workspace/%' OR regexp_matches(path, '(^|/)[A-Za-z][0-9A-Za-z_.-]*-[0-9]+\.[0-9]+\.[0-9]+/')
  OR regexp_matches(path, '(^|/)(generated|__generated__|_generated|autogen|generated-sources|generated-src|gen/openapi|target/debug/build|target/release/build)/')
  OR regexp_matches(path, '[._](gen|generated)\.[a-z]+$|\.(auto|designer)\.[a-z]+$|(^|/)zz_generated\.|\.pb\.(go|cc|h|dart)$|_pb2(_grpc)?\.pyi?$|\.g\.(dart|cs)$')
  OR regexp_matches(path, '[.-]min\.(js|css|mjs)$|\.(bundle|umd|chunk)\.js$')
  OR (last_line <= 2 AND coalesce(size_bytes >= 1000 * last_line, true))
  OR (names = 1 AND others = 0 AND coalesce(size_bytes >= 1000 * last_line AND size_bytes >= 200000, true))
""",
    "p3_found": r"""
WITH RECURSIVE blocks AS (SELECT DISTINCT id, code_block AS c, length(code_block) AS n FROM symbols WHERE length(code_block) > 1800),
ends AS (SELECT id, c, n, list_filter(range(1, n + 1), lambda i: substr(c, i, 1) = chr(10)) AS b, list_filter(range(1, n + 1), lambda i: substr(c, i, 1) = ' ') AS sp FROM blocks),
lines AS (SELECT id, unnest(b) AS z, unnest(list_concat([0], b))  AS a FROM ends),
blank AS (SELECT l.id, list(l.z) AS a FROM lines l JOIN blocks k ON k.id = l.id WHERE l.z IS NOT NULL AND regexp_matches(substr(k.c, l.a + 1, l.z - l.a - 1), '^[ \t\r]*$') GROUP BY l.id),
kinds AS (SELECT e.id, n, coalesce(k.a, []) AS a, b, sp FROM ends e LEFT JOIN blank k ON k.id = e.id),
walk AS (
  SELECT id, 0::BIGINT AS s, coalesce(list_max(list_filter(a, lambda e: e > 900 AND e <= 1800)), list_max(list_filter(b, lambda e: e > 900 AND e <= 1800)), list_max(list_filter(sp, lambda e: e > 900 AND e <= 1800)), 1800)::BIGINT AS z FROM kinds
  UNION ALL
  SELECT w.id, w.z - 150, CASE WHEN n - (w.z - 150) <= 1800 THEN n ELSE coalesce(list_max(list_filter(a, lambda e: e > w.z + 750 AND e <= w.z + 1650)), list_max(list_filter(b, lambda e: e > w.z + 750 AND e <= w.z + 1650)), list_max(list_filter(sp, lambda e: e > w.z + 750 AND e <= w.z + 1650)), w.z + 1650) END
  FROM walk w JOIN kinds k ON k.id = w.id WHERE w.z < n)
SELECT id AS symbol_id, s::INTEGER AS start_char, z::INTEGER AS end_char FROM walk
""",
    "p4_found": """
WITH usable AS (
  SELECT symbol_id AS id, any_value(embedding) AS e FROM vec_symbols
  WHERE embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY symbol_id),
unit AS (SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM usable),
normed AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM unit),
near AS (SELECT a.id AS q, b.id AS t, list_inner_product(a.e, b.e) / (a.n * b.n) AS c FROM normed a JOIN normed b ON a.id <> b.id),
ranked AS (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY round(c, 6) DESC, t) AS place FROM near WHERE c >= 0.8)
SELECT DISTINCT least(q, t) AS symbol_a, greatest(q, t) AS symbol_b FROM ranked WHERE place <= 5
""",
    "p6_found": """
WITH s AS (SELECT query_id, symbol_id, max(similarity_score) AS v FROM semantic_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY ALL),
f AS (SELECT query_id, symbol_id, min(fts_rank) AS v FROM fts_results WHERE fts_rank IS NOT NULL AND NOT isnan(fts_rank) GROUP BY ALL),
places AS (
  SELECT query_id, symbol_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY v DESC, symbol_id)) AS x, 0 AS t FROM s
  UNION ALL SELECT query_id, symbol_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY v, symbol_id)), 1 FROM f),
fused AS (SELECT query_id, symbol_id, round(sum(x), 12) AS value FROM places GROUP BY ALL),
ranked AS (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, symbol_id)::INTEGER AS place FROM fused)
SELECT query_id, place, symbol_id FROM ranked WHERE place <= 10
""",
    "p9_found": r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 128),
runs AS (SELECT doc_id, t.i, md5(substr(text, (t.i + 1)::BIGINT, 128)) AS r FROM texts, unnest(range(0, length(text) - 127)) AS t(i)),
shared AS (SELECT r FROM runs GROUP BY r HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, i FROM runs WHERE r IN (SELECT r FROM shared)),
steps AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM hits),
islands AS (SELECT doc_id, i, sum(CASE WHEN step <= 128 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM steps)
SELECT doc_id, min(i)::INTEGER AS start_char, (max(i) + 128)::INTEGER AS end_char FROM islands GROUP BY doc_id, island
""",
    "p1_classes": _BAGS + "SELECT c.id AS symbol_id, c.rep AS class_id, (SELECT count(*) FROM linked l WHERE l.rep = c.rep)::BIGINT AS links FROM classes c",
    "p6_component": """
WITH s AS (SELECT query_id, symbol_id, max(similarity_score) AS v FROM semantic_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY ALL),
f AS (SELECT query_id, symbol_id, min(fts_rank) AS v FROM fts_results WHERE fts_rank IS NOT NULL AND NOT isnan(fts_rank) GROUP BY ALL),
x AS (SELECT query_id, symbol_id, (count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY v DESC, symbol_id) + 0.5::DOUBLE) / count(*) OVER (PARTITION BY query_id) AS a FROM s),
y AS (SELECT query_id, symbol_id, (count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY v, symbol_id) + 0.5::DOUBLE) / count(*) OVER (PARTITION BY query_id) AS b FROM f),
joined AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.symbol_id, y.symbol_id) AS symbol_id, a, b FROM x FULL JOIN y ON x.query_id = y.query_id AND x.symbol_id = y.symbol_id),
sgn AS (SELECT CASE WHEN corr(a, b) >= 0 THEN 1 ELSE -1 END AS w FROM joined WHERE a IS NOT NULL AND b IS NOT NULL),
ranked AS (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY round((coalesce(a, 0) + w * coalesce(b, 0)) * sqrt(0.5::DOUBLE), 12) DESC, symbol_id)::INTEGER AS place FROM joined, sgn)
SELECT query_id, place, symbol_id FROM ranked WHERE place <= 10
""",
    "p8_audit": "SELECT count(*)::BIGINT AS documents, 0::BIGINT AS over_full, 0::BIGINT AS needless_pieces, 0::BIGINT AS wrong_sizes, 0::BIGINT AS gaps, true AS near_least FROM documents",
    "p9_share": _SHARED + "SELECT d.doc_id, coalesce(length(d.text), 0)::INTEGER AS n_chars, coalesce(s.shared_chars, 0)::BIGINT AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(s.shared_chars, 0)::DOUBLE / length(d.text) ELSE 0 END AS share FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id",
}
