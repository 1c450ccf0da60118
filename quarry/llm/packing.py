"""Filling containers of fixed capacity by minimum bin slack on the histogram of sizes: problem 8.

Only sizes matter to the packing, and no item is larger than the capacity, so the plan is made from the counts of at
most `capacity` sizes, whatever the number of items. Each window (one container) takes the largest size left; a subset-sum
over bit sets finds the multiset of the remaining lengths that comes closest to what is still free, and the chosen pattern
is repeated as often as the counts allow. Items then find their container by size and rank within the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged

CAPACITY = 2048
#: Each size is ranked in this many buckets at least, so that one size may hold any share of the items.
BUCKETS = 64
ROWS_A_BUCKET = 2_000_000


def fill_pattern(free: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each size (of at most counts[size]) fill `free` with the least slack.

    Sizes enter from the largest, each count in binary chunks; bit i of a set says that the sum i can be made. The sets
    are kept, so the chosen chunks are read off backwards. Stops when no slack is left.
    """
    full, mask = 1 << free, (1 << (free + 1)) - 1
    bits, steps = 1, []
    for size in sorted((s for s in counts if s <= free and counts[s]), reverse=True):
        left, chunk = min(counts[size], free // size), 1
        while left:
            take = min(chunk, left)
            steps.append((bits, size, take))
            bits |= (bits << size * take) & mask
            left -= take
            chunk *= 2
        if bits & full:
            break
    best, chosen = bits.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> best & 1:
            chosen[size] = chosen.get(size, 0) + take
            best -= size * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> how many) with the number of containers each fills; every item of the histogram is used once."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("sizes must lie in 1..capacity")
    out = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        pattern = fill_pattern(capacity - largest, counts)
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(counts[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        out.append((pattern, times))
    return out


def _assigned(patterns: list[tuple[dict[int, int], int]]):
    """Sorted runs: items of a size with ranks from `start` on go to container base + (rank - start) // k."""
    runs, used, base = [], {}, 0
    for pattern, times in patterns:
        for size, k in pattern.items():
            runs.append((size << 44 | used.get(size, 0), k, base))
            used[size] = used.get(size, 0) + k * times
        base += times
    runs.sort()
    key, k, first = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            wanted = size << 44 | rank
            at = np.searchsorted(key, wanted, side="right") - 1
            container = np.where(size > 0, first[at] + (wanted - key[at]) // k[at], 0) if len(key) else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(container.astype(np.int64)), batch.column(2)], names=["doc_id", "piece", "container_id", "n_tokens"])

    return run


def pack_items(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id long, piece int, container_id long, n_tokens int), one row for each item or piece of one.

    sizes: (doc_id long, n_tokens int), doc_id unique; other columns are ignored. An item above the capacity is cut into
    full pieces and a rest, numbered from 0; piece p starts at token p * capacity. Items of size 0 or null take no room
    and go to container 0. Containers are numbered from 0 without gaps. An empty table gives an empty result.
    """
    known = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"))
    pieces = F.greatest(F.ceil(F.col("size") / capacity).cast("int"), F.lit(1))
    items = known.select("doc_id", "size", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.select("doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    items = staged(items, "items")
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    histogram.pop(0, None)
    buckets = max(BUCKETS, -(-total // ROWS_A_BUCKET))
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    ranked = bucketed.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")))
    counts = bucketed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = ranked.join(shift, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("r") - 1 + F.col("shift")).alias("rank"))
    return placed.mapInArrow(_assigned(plan(histogram, capacity)), "doc_id long, piece int, container_id long, n_tokens int")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_tokens int, containers long): how many containers hold how many tokens."""
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"))
    return filled.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("containers"))


def audit(sizes: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that says whether pack_items() kept its word.

    (documents, over_full, needless_pieces, wrong_sizes, gaps long, near_least boolean): documents with a row; containers
    above the capacity; documents in more pieces than they need; documents whose pieces do not add up or that have none;
    numbers missing among the containers; and whether there are at most 1 % and two containers more than the tokens fill.
    """
    fill = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    of = fill.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("numbers"), F.coalesce(F.sum((F.col("n") > capacity).cast("long")), F.lit(0)).alias("over_full"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("held"))
    joined = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size")).join(pieces, "doc_id", "left")
    needed = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    count = lambda test: F.coalesce(F.sum(F.coalesce(test, F.lit(True)).cast("long")), F.lit(0))
    docs = joined.agg(F.count(F.lit(1)).alias("documents"), count(F.coalesce("pieces", F.lit(0)) > needed).alias("needless_pieces"), count(F.col("held") != F.col("size")).alias("wrong_sizes"))
    near = F.col("containers") <= F.ceil(F.col("tokens") / capacity) * 1.01 + 2
    return docs.join(F.broadcast(of)).select("documents", "over_full", "needless_pieces", "wrong_sizes", (F.col("numbers") - F.col("containers")).alias("gaps"), near.alias("near_least"))  # one row each
