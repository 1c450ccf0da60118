"""Row numbers and running sums of groups of any size: no window ever runs over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged


def running(rows: DataFrame, within: list[str], order: list[Column], value: Column | None, into: str) -> DataFrame:
    """rows with `into`, the sum of value (null: 1, which gives row numbers from 1) up to each row in its group.

    A group may hold most of the rows, so the rows are range-partitioned by group and order, summed within each part,
    and shifted by the sums of the group's parts before; those are one row for each part and group. Rows equal in the
    whole order lie in one part and may be summed in either order. `within` may be empty: one sequence over all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__value", F.lit(1).cast("long") if value is None else value)
    placed = placed.repartitionByRange(parts, *within, *order).withColumn("__part", F.spark_partition_id())
    placed = staged(placed, "placed")  # fixes the parts, which both uses below must see alike
    local = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("__own", F.sum("__value").over(local))
    sums = placed.groupBy("__part", *within).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("__part", *within, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    if not within:
        shift = F.broadcast(shift)  # one row a part
    same = [F.col("s.__part") == F.col("p.__part"), *(F.col(f"s.`{c}`").eqNullSafe(F.col(f"p.`{c}`")) for c in within)]
    found = summed.alias("s").join(shift.alias("p"), on=same)
    return found.select(*[F.col(f"s.`{c}`") for c in rows.columns], (F.col("s.__own") + F.col("p.__shift")).alias(into))


def row_numbers(rows: DataFrame, within: list[str], order: list[Column], into: str) -> DataFrame:
    """rows with their place in the group, from 1, as running() finds it."""
    return running(rows, within, order, None, into)
