"""Changes of the stored tables as functions from old and new rows to the table after; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .running import running


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces the rows of table with equal keys; of equal keys in new the last by `seq` (if there) wins."""
    rows = last_wins(new, keys, "seq") if "seq" in new.columns else new.dropDuplicates(keys)
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key, without that column."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in rows.columns if c != order])


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Set semantics over (caller_id, callee_id, kind): what is there already is not added again."""
    return edges.unionByName(new.select(*edges.columns)).dropDuplicates(["caller_id", "callee_id", "kind"])


def without_files(table: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
    """table without the rows of the files gone(repo_name, file_path)."""
    keys = gone.select("repo_name", F.col("file_path").alias(column)).distinct()
    return table.join(keys, ["repo_name", column], "left_anti").select(*table.columns)


def without_repo(table: DataFrame, repo: str) -> DataFrame:
    """table without a repository's rows; rows of no repository stay."""
    return table.where(~F.col("repo_name").eqNullSafe(F.lit(repo)))


def append(table: DataFrame, new: DataFrame) -> DataFrame:
    """table and new; for tables without a key, such as routes, of which the same row may be stored twice."""
    return table.unionByName(new.select(*table.columns))


def without_edges_of_files(edges: DataFrame, symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """edges whose caller is no symbol of the files gone(repo_name, file_path)."""
    callers = symbols.join(gone.select("repo_name", "file_path").distinct(), ["repo_name", "file_path"], "left_semi").select(F.col("id").alias("caller_id"))
    return edges.join(callers, "caller_id", "left_anti").select(*edges.columns)


def live_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges of which both ends are symbols."""
    ids = symbols.select("id")
    return edges.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id", "callee_id", "kind")


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """(dimension, vectors long) of the vectors that do not have the expected length; empty if all fit."""
    size = F.size("embedding")
    return vectors.where(F.col("embedding").isNotNull() & (size != dimension)).groupBy(size.alias("dimension")).agg(F.count(F.lit(1)).alias("vectors"))


def running_total(calls: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """calls with `total`, the sum so far within the group of the values above 0; a group may hold most of the rows."""
    return running(calls, [group], [F.col(c) for c in order], F.greatest(F.col(value), F.lit(0)), "total")


def batch_counts(items: DataFrame, group: str) -> DataFrame:
    """(group, successes, errors) of batch items with a nullable `error`."""
    bad = F.col("error").isNotNull().cast("long")
    return items.groupBy(group).agg(F.sum(1 - bad).alias("successes"), F.sum(bad).alias("errors"))
