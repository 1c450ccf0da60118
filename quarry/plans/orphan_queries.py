"""Problem 5 as registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import orphans
from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = orphans.code_references(table(spark, sf_dir, "memories"), table(spark, sf_dir, "routes"))
    parents = table(spark, sf_dir, "symbols").select("id", F.col("indexed_at").alias("seen"))
    return orphans.orphan_references(refs, parents)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, sf_dir))


_FOUND = """
WITH refs AS (
  SELECT 'memories' AS ref_table, id AS ref_id, symbol_id AS parent_id, created_at AS own_time FROM memories
  UNION ALL SELECT 'routes', id, handler_symbol_id, indexed_at FROM routes),
parents AS (SELECT id, min(indexed_at) AS first_seen FROM symbols GROUP BY id),
found AS (
  SELECT DISTINCT ref_table, ref_id, strftime(own_time, '%Y-%m') AS ref_month,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN first_seen > own_time THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN parents p ON p.id = r.parent_id WHERE parent_id IS NOT NULL)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _FOUND + "SELECT ref_table, ref_id, ref_month, ref_state FROM found WHERE ref_state IS NOT NULL",
    "p5_report": _FOUND + "SELECT ref_table, ref_month, ref_state, count(*)::BIGINT AS n FROM found WHERE ref_state IS NOT NULL GROUP BY ALL",
}
