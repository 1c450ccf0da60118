"""One ranking from scores on unlike scales: problem 6.

Both forms start from rank-transformed scores, so no score weighs more by its range. `fused_places` adds reciprocal
ranks, which is what the problem's statement fixes value by value; `component_places` projects the rank-transformed
scores on their first principal component, from a distributed correlation matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.running import row_numbers
from ..operators.skew import hot_keys, join_hot
from ..session import staged

K = 60


def best_scores(hits: DataFrame, score: str, higher_is_better: bool) -> DataFrame:
    """(query_id, symbol_id, goodness double): the best usable score of each hit; null and NaN scores do not count.

    Combined on the map side. Null query_id or symbol_id: no hit.
    """
    value = F.col(score).cast("double")
    usable = hits.where(F.col("query_id").isNotNull() & F.col("symbol_id").isNotNull() & value.isNotNull() & ~F.isnan(value))
    return usable.groupBy("query_id", "symbol_id").agg(F.max(value if higher_is_better else -value).alias("goodness"))


def rank_tables(tables: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Full outer join of the tables' positions: (query_id, symbol_id, position_0, position_1, ...); null where absent."""
    joined = None
    for i, (hits, score, higher) in enumerate(tables):
        best = best_scores(hits, score, higher)
        ranked = row_numbers(best, ["query_id"], [F.desc("goodness"), F.col("symbol_id")], f"position_{i}").drop("goodness")
        joined = ranked if joined is None else joined.join(ranked, ["query_id", "symbol_id"], "full_outer")
    return joined


def _first(ranked: DataFrame, value: Column, top: int) -> DataFrame:
    """The first `top` of each query by value, ties by smaller symbol_id: (query_id, place, symbol_id).

    Two steps: the best of each of 32 salts within a query, then the best of those, so a hot query is split.
    """
    order = [F.col("value").desc(), F.col("symbol_id")]
    rows = ranked.select("query_id", "symbol_id", F.round(value, 12).alias("value"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(32)))
    inner = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("r") <= top)
    outer = inner.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top)
    return outer.select("query_id", "place", "symbol_id")


def fused_places(tables: list[tuple[DataFrame, str, bool]], top: int = 10, k: int = K) -> DataFrame:
    """(query_id, place, symbol_id) by the sum of 1 / (k + position) over the tables that hold the hit.

    tables: (hits, score column, higher is better); hits hold query_id, symbol_id and the score. A query without a usable
    hit has no rows; empty tables give an empty result.
    """
    ranked = rank_tables(tables)
    value = sum(F.coalesce(1 / (F.lit(float(k)) + F.col(f"position_{i}")), F.lit(0.0)) for i in range(len(tables)))
    return _first(ranked, value, top)


def component(ranked: DataFrame, names: list[str], directions: list[int]) -> np.ndarray:
    """Loadings of the first principal component of the columns' correlation matrix, one pass over all rows.

    A correlation is taken over the rows that hold both columns. The sign is oriented so that the loadings agree with
    the declared directions on the whole; where scores contradict each other a single loading can stay against its own,
    and if they cancel out the first column decides. A constant column loads 0; without rows, with all columns constant
    or without any correlation, every column that varies (or every one) weighs the same.
    """
    goal = np.asarray(directions, float)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    row = ranked.agg(*[F.var_pop(n).alias(f"v{i}") for i, n in enumerate(names)], *[
        x for i, j in pairs for x in (
            F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}"),
            F.var_pop(F.when(F.col(names[j]).isNotNull(), F.col(names[i]))).alias(f"a{i}_{j}"), F.var_pop(F.when(F.col(names[i]).isNotNull(), F.col(names[j]))).alias(f"b{i}_{j}"))
    ]).first()
    usable = np.array([(row[f"v{i}"] or 0.0) > 1e-24 for i in range(len(names))])
    corr = np.diag(usable.astype(float))
    for i, j in pairs:
        spread = (row[f"a{i}_{j}"] or 0.0) * (row[f"b{i}_{j}"] or 0.0)
        if usable[i] and usable[j] and spread > 1e-48:
            corr[i, j] = corr[j, i] = row[f"c{i}_{j}"] / np.sqrt(spread)
    if not usable.any():
        return goal / np.sqrt(len(names))
    if np.abs(corr - np.diag(np.diag(corr))).max(initial=0.0) < 1e-9:
        return goal * usable / np.sqrt(usable.sum())
    first = np.linalg.eigh(corr)[1][:, -1]
    agree = first @ goal
    if abs(agree) < 1e-9:
        agree = next(x * g for x, g in zip(first, goal) if abs(x) > 1e-9)
    return first * (1 if agree > 0 else -1)


def component_places(tables: list[tuple[DataFrame, str, bool]], top: int = 10) -> DataFrame:
    """(query_id, place, symbol_id) by the first principal component of the rank-transformed scores.

    The rank transform maps the position p of n hits of a query to (n - p + 0.5) / n. The correlation is that of the
    hits that both tables hold; in the projection a table without the hit gives 0, below its last hit.
    """
    names = [f"score_{i}" for i in range(len(tables))]
    ranked = staged(rank_tables(tables), "ranked")
    counts = ranked.groupBy("query_id").agg(*[F.count(f"position_{i}").alias(f"n_{i}") for i in range(len(tables))])
    joined = join_hot(ranked, counts, ["query_id"], hot_keys(ranked, ["query_id"]), ["symbol_id"])
    scored = joined.select("query_id", "symbol_id", *[((F.col(f"n_{i}") - F.col(f"position_{i}") + 0.5) / F.col(f"n_{i}")).alias(n) for i, n in enumerate(names)])
    loadings = component(scored, names, [1] * len(names))
    return _first(scored, sum(F.lit(float(w)) * F.coalesce(n, F.lit(0.0)) for w, n in zip(loadings, names)), top)
