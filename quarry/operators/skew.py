"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key with more rows than this is hot. Keys that are cannot be more than the rows over HOT, which bounds their broadcast.
HOT = 100_000
SALTS = 16


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of left, whose hot(keys) are spread over salts by the columns `by`, with right, whose few rows of those
    keys are copied to each salt; rows of other keys are neither spread nor copied. Columns: keys, left's, right's."""
    marked = F.broadcast(hot.select(*keys).distinct().withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    a = left.join(marked, keys, "left").withColumn("__salt", salt).drop("__hot")
    b = right.join(marked, keys, "left").withColumn("__salt", every).drop("__hot")
    return a.join(b, [*keys, "__salt"]).drop("__salt")


def hot_keys(rows: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """The keys of more than `hot` rows; counted on the map side first."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(*keys)
