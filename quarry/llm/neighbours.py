"""The k most similar vectors for every vector, by learned partitions: problem 4.

1. Vectors equal bit for bit form a class. Only a class's k + 1 smallest ids can be among anyone's k nearest, so a class
   is one query and one target whatever its size.
2. On a bounded sample a k-nearest-neighbour graph is built and cut into balanced partitions: a few rounds in which each
   vector moves to the partition of most of its neighbours, against a price on large partitions. A linear softmax
   classifier learns the partition from the vector.
   Of more than two million classes, partitions have two levels, each fitted like that.
3. Every class is indexed in the partition the classifier finds most probable and searched in the PROBES most probable
   ones. A partition larger than TILE is cut into tiles, to each of which its queries go.
4. Within a tile, products of blocks of vectors; what may be among the k best is rescored in double precision.
Only the fit sees a sample; every vector is indexed and searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import slots, staged

#: Rows on which the graph and the classifier are fitted, at most: 8 MB of vectors of 128 numbers.
SAMPLE = 16_384
#: Vectors to a partition, on average; above ONE_LEVEL partitions there are two levels of them.
PARTITION, ONE_LEVEL = 1024, 2048
#: Partitions that each query searches; with two levels, upper ones, and leaves in each of them.
PROBES, UPPER_PROBES, LEAF_PROBES = 6, 4, 3
TILE = 4096
#: Rows of an upper partition that one task routes.
ROWS_A_SALT = 200_000
#: Cosines closer than this are equal.
SAME = 1e-6


def usable_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """(symbol_id, embedding) of the vectors of `dimension` finite numbers that are not all zero, one for each id."""
    e = F.col("embedding")
    fine = F.coalesce((F.size(e) == dimension) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    kept = rows.select("symbol_id", "embedding").where(F.col("symbol_id").isNotNull() & fine)
    return kept.groupBy("symbol_id").agg(F.first("embedding").alias("embedding"))


def balanced_partition(x: np.ndarray, parts: int, neighbours: int = 10, rounds: int = 8) -> np.ndarray:
    """Partition number of each row: the k-nearest-neighbour graph of x, cut into `parts` parts of about equal size."""
    n, rng = len(x), np.random.default_rng(7)
    if parts <= 1:
        return np.zeros(n, np.int64)
    k = min(neighbours, n - 1)
    near = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        near[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    seeds = x[rng.choice(n, parts, replace=False)]
    goal, price = n / parts, np.zeros(parts, np.float32)
    for _ in range(rounds):  # where the graph starts from: the nearest seed, priced by size
        score = x @ seeds.T
        for _ in range(6):
            part = np.argmax(score - price, axis=1)
            price += (0.02 * (np.bincount(part, minlength=parts) - goal) / goal).clip(-0.05, 0.05).astype(np.float32)
        sums = np.zeros_like(seeds)
        np.add.at(sums, part, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        seeds = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), seeds)
    for _ in range(rounds):  # moves along the graph: votes of the neighbours against the price of crowding
        crowd = np.bincount(part, minlength=parts) / goal
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), k), part[near].ravel()), 1.0 / k)
        votes[np.arange(n), part] += 0.3
        wanted = np.argmax(votes - 0.4 * crowd.astype(np.float32), axis=1)
        moving = (wanted != part) & (rng.random(n) < 0.5)
        part = np.where(moving, wanted, part)
    return part


def fit_classifier(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a linear softmax from vector to partition: from the partitions' means, then Adam on batches."""
    rng = np.random.default_rng(11)
    w = np.zeros((parts, x.shape[1]), np.float32)
    np.add.at(w, part, x)
    w *= 10 / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-6)
    b = np.zeros(parts, np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(2048, len(x)))
        z = x[rows] @ w.T + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(rows)), part[rows]] -= 1
        z /= len(rows)
        for value, grad, one, two, rate in ((w, z.T @ x[rows], m, v, 0.1), (b, z.sum(axis=0), mb, vb, 0.02)):
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            value -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return w, b


def _unit(batch: pa.RecordBatch, column: int, dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column(column).to_pylist()), "<f4").reshape(-1, dimension)
    x64 = x.astype(np.float64)
    x64 /= np.abs(x64).max(axis=1, keepdims=True)  # before squares, which could overflow or vanish
    return x64 / np.linalg.norm(x64, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        n = len(lists)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        size = len(flat) // n if n else 0
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * max(size, 1)), n, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary()) if n else pa.array([], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["cls", "vec"])


def _fitted(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the classifier of `parts` balanced partitions; one partition takes everything."""
    if parts <= 1 or len(sample) <= parts:
        return np.zeros((1, sample.shape[1]), np.float32), np.zeros(1, np.float32)
    return fit_classifier(sample, balanced_partition(sample, parts), parts)


def _sent(batch: pa.RecordBatch, x: np.ndarray, own: np.ndarray, w: np.ndarray, b: np.ndarray, tiles: np.ndarray, probes: int, base: int) -> pa.RecordBatch:
    """Index rows (kind 0, of the rows in `own`) and query rows (kind 1) of a batch (cls, vec) by tile, numbered from base."""
    first = np.cumsum(tiles) - tiles
    cls = batch.column(0).to_numpy()
    score = x.astype(np.float32) @ w.T + b
    k = min(probes, len(w))
    parts = np.argpartition(-score, k - 1, axis=1)[:, :k].ravel()
    at = np.flatnonzero(own)
    home = np.argmax(score[at], axis=1)
    mixed = (cls[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    tile = first[home] + (mixed % tiles[home].astype(np.uint64)).astype(np.int64)
    each = tiles[parts]
    asked = np.repeat(first[parts], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    row = np.repeat(np.repeat(np.arange(len(cls)), k), each)
    rows, kind = np.r_[at, row], np.r_[np.zeros(len(at), np.int8), np.ones(len(row), np.int8)]
    return pa.RecordBatch.from_arrays([pa.array(base + np.r_[tile, asked]), pa.array(kind), pa.array(cls[rows]), batch.column(1).take(pa.array(rows))], names=["tile", "kind", "cls", "vec"])


_SENT = "tile long, kind byte, cls long, vec binary"


def _parted(w: np.ndarray, b: np.ndarray, dimension: int):
    """(cls, part): the most probable partition of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                score = _unit(batch, 1, dimension).astype(np.float32) @ w.T + b
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.argmax(score, axis=1).astype(np.int32))], names=["cls", "part"])

    return run


def _routed(w: np.ndarray, b: np.ndarray, tiles: np.ndarray, probes: int, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                yield _sent(batch, _unit(batch, 1, dimension), np.ones(batch.num_rows, bool), w, b, tiles, probes, 0)

    return run


def _to_tops(w: np.ndarray, b: np.ndarray, probes: int, dimension: int):
    """(top, own, cls, vec): each class once for each of its `probes` most probable upper partitions; own: the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                score = _unit(batch, 1, dimension).astype(np.float32) @ w.T + b
                k = min(probes, len(w))
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), k))
                own = (top == np.argmax(score, axis=1)[:, None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), pa.array(own), batch.column(0).take(rows), batch.column(1).take(rows)], names=["top", "own", "cls", "vec"])

    return run


def _fit_top(partition: int, dimension: int):
    """The classifier of one upper partition from its sample (top, members, vec): weights, bias, and tiles of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        x = np.concatenate([_unit(b, 2, dimension) for b in table.to_batches() if b.num_rows]).astype(np.float32)
        members = table.column("members")[0].as_py()
        w, b = _fitted(x, min(round(members / partition), len(x) // 8))
        held = np.bincount(np.argmax(x @ w.T + b, axis=1), minlength=len(w)) * (members / len(x))
        tiles = np.maximum(1, np.ceil(1.25 * held / TILE)).astype("<i8")
        return pa.table({"top": [table.column("top")[0].as_py()], "w": [w.tobytes()], "b": [b.tobytes()], "tiles": [tiles.tobytes()]}, schema=pa.schema([("top", pa.int32()), ("w", pa.binary()), ("b", pa.binary()), ("tiles", pa.binary())]))

    return run


def _to_leaves(probes: int, dimension: int):
    """Rows sorted by upper partition, its model first: sends each class to the tiles of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            tops, models = whole.column(0).to_numpy(), whole.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (tops[1:] != tops[:-1]) | (models[1:] != models[:-1])])
            for a, z in zip(edges, np.r_[edges[1:], len(tops)]):
                if models[a]:
                    w, b, tiles = (whole.column(i)[int(a)].as_py() for i in (5, 6, 7))
                    model = np.frombuffer(w, "<f4").reshape(-1, dimension), np.frombuffer(b, "<f4"), np.frombuffer(tiles, "<i8")
                    continue
                for at in range(a, z, 2048):
                    part = whole.slice(at, min(2048, z - at))
                    batch = pa.RecordBatch.from_arrays([part.column(4), part.column(5)], names=["cls", "vec"])
                    yield _sent(batch, _unit(batch, 1, dimension), part.column(3).to_numpy(zero_copy_only=False).astype(bool), *model, probes, int(tops[a]) << 32)

    return run


def _searched(k: int, least: float, dimension: int):
    def search(index_cls, index, queries_cls, queries):
        i32 = index.astype(np.float32)
        out = []
        for at in range(0, len(queries), 1024):
            q = queries[at : at + 1024]
            s = q.astype(np.float32) @ i32.T
            floor = np.full(len(q), np.float32(least - 1e-5))
            if s.shape[1] > k:  # the (k + 1)-th best class: what lies below it by more than rounding can't matter
                floor = np.maximum(floor, np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] - np.float32(2e-5))
            row, col = np.nonzero(s >= floor[:, None])
            for cut in range(0, len(row), 20_000):
                r, c = row[cut : cut + 20_000], col[cut : cut + 20_000]
                cos = (q[r] * index[c]).sum(axis=1)
                keep = cos >= least - 1e-12
                out.append((queries_cls[at:][r[keep]], index_cls[c[keep]], cos[keep]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held_cls, held, index_cls, index = None, [], [], None, None
        for batch in batches:
            tiles, kinds, cls = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(edges, np.r_[edges[1:], len(tiles)]):
                if tiles[a] != tile:
                    tile, held_cls, held, index_cls = tiles[a], [], [], None
                x = _unit(batch.slice(a, b - a), 3, dimension)
                if kinds[a] == 0:
                    held_cls.append(cls[a:b])
                    held.append(x)
                    continue
                if index_cls is None:
                    index_cls, index = (np.concatenate(held_cls), np.concatenate(held)) if held else (np.zeros(0, np.int64), np.zeros((0, dimension)))
                if not len(index_cls):
                    continue
                for q, t, cos in search(index_cls, index, cls[a:b], x):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(t), pa.array(cos)], names=["q", "t", "cos"])

    return run


def _sample(vectors: DataFrame, n: int, dimension: int) -> np.ndarray:
    """At most SAMPLE of n classes, the same in every run."""
    cell = F.pmod(F.xxhash64(F.lit(3), "cls"), F.lit(1 << 30))
    picked = vectors.where(cell < int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 30)) + 1).limit(SAMPLE).select("vec").toArrow()
    parts = [_unit(b, 0, dimension) for b in picked.to_batches() if b.num_rows]
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, dimension), np.float32)


def _sent_by_levels(vectors: DataFrame, n: int, dimension: int, partition: int) -> DataFrame:
    """The tiles of two levels of partitions, for more classes than one level takes.

    About as many upper partitions as each has leaves, so both grow with the root of n and every leaf stays at about
    `partition` classes: a query meets UPPER_PROBES * LEAF_PROBES of them at any n. Each upper partition is fitted on a
    sample of its own, in a task of its own; its model goes to the rows, no model to the driver.
    """
    spark = vectors.sparkSession
    tops = max(2, round((n / partition) ** 0.5))
    w, b = _fitted(_sample(vectors, n, dimension), tops)
    sizes = vectors.mapInArrow(_parted(w, b, dimension), "cls long, part int").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row an upper partition
    plan = spark.createDataFrame([(r.part, r.n, int(min(1.0, SAMPLE / r.n) * (1 << 30)), -(-r.n // ROWS_A_SALT)) for r in sizes], "top int, members long, below long, salts int")
    placed = vectors.mapInArrow(_to_tops(w, b, UPPER_PROBES, dimension), "top int, own boolean, cls long, vec binary").join(F.broadcast(plan), "top")
    cell = F.pmod(F.xxhash64(F.lit(5), "cls"), F.lit(1 << 30))
    own = placed.where("own").where(cell <= F.col("below")).select("top", "members", "vec")
    models = staged(own.groupBy("top").applyInArrow(_fit_top(partition, dimension), "top int, w binary, b binary, tiles binary"), "models")
    none = F.lit(None).cast("binary")
    copies = models.join(F.broadcast(plan), "top").select("top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("model"), F.lit(False).alias("own"), F.lit(0).cast("long").alias("cls"), F.col("w").alias("vec"), "b", "tiles")
    rows = placed.select("top", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("model"), "own", "cls", "vec", none.alias("b"), none.alias("tiles"))
    together = rows.unionByName(copies).repartition(max(slots(spark), -(-UPPER_PROBES * n // ROWS_A_SALT)), "top", "salt").sortWithinPartitions("top", "salt", F.desc("model"))
    return together.mapInArrow(_to_leaves(LEAF_PROBES, dimension), _SENT)


def nearest_classes(vectors: DataFrame, k: int, least: float, dimension: int, probes: int = PROBES, partition: int = PARTITION) -> DataFrame:
    """(q long, t long, cos double): for each class (cls long, vec binary) the classes found near it, itself included."""
    spark = vectors.sparkSession
    n = vectors.count()
    parts = max(1, round(n / partition))
    if parts > ONE_LEVEL:
        sent = _sent_by_levels(vectors, n, dimension, partition)
        width = max(slots(spark), -(-parts // 8))
    else:
        w, b = _fitted(_sample(vectors, n, dimension) if parts > 1 else np.zeros((0, dimension), np.float32), parts)
        tiles = np.ones(len(w), np.int64)
        for r in vectors.mapInArrow(_parted(w, b, dimension), "cls long, part int").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a partition
            tiles[r.part] = -(-r.n // TILE)
        sent = vectors.mapInArrow(_routed(w, b, tiles, probes, dimension), _SENT)
        width = max(slots(spark), int(tiles.sum()) // 8)
    return sent.repartition(width, "tile").sortWithinPartitions("tile", "kind").mapInArrow(_searched(k, least, dimension), "q long, t long, cos double")


def nearest_pairs(rows: DataFrame, k: int = 5, least: float = 0.8, dimension: int = 128, probes: int = PROBES, partition: int = PARTITION) -> DataFrame:
    """(symbol_a, symbol_b), smaller first: pairs of which at least one is among the k most similar of the other.

    rows: (symbol_id long, embedding array<float>), other columns ignored. Similarity: cosine of at least `least`; cosines
    less than SAME apart are equal and the smaller id goes first. Null, all-zero, infinite, NaN vectors and those of
    another length take no part; repeated rows (same id) count once; an empty table gives an empty result.
    """
    usable = usable_vectors(rows, dimension).withColumn("cls", F.xxhash64("embedding"))
    usable = usable.withColumn("cls2", F.xxhash64(F.lit(17), "embedding"))
    usable = usable.withColumn("cls", F.col("cls").bitwiseXOR(F.shiftleft("cls2", 1))).select("symbol_id", "cls", "embedding")
    usable = staged(usable, "usable")
    members = usable.select("cls", "symbol_id")
    by_id = Window.partitionBy("cls", "salt").orderBy("symbol_id")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(32)))
    some = salted.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    heads = some.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("symbol_id")), 1, k + 1).alias("ids"))  # at most 32 * (k + 1) each
    vectors = staged(usable.groupBy("cls").agg(F.first("embedding").alias("embedding")).mapInArrow(_packed, "cls long, vec binary"), "vectors")
    near = nearest_classes(vectors, k, least, dimension, probes, partition)

    hits = near.join(heads.withColumnRenamed("cls", "t"), "t").select("q", "cos", F.explode("ids").alias("id"))
    down = Window.partitionBy("q").orderBy(F.desc("cos"), "id")
    stepped = hits.withColumn("apart", F.coalesce((F.lag("cos").over(down) - F.col("cos") >= SAME).cast("int"), F.lit(0)))
    runs = stepped.withColumn("run", F.sum("apart").over(down))
    ranked = runs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("run", "id"))).where(F.col("place") <= k + 1)
    best = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("best"))
    lists = best.select(F.col("q").alias("cls"), F.transform("best", lambda x: x["id"]).alias("best"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    own = members.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(16)).cast("int"))
    others = F.slice(F.filter("best", lambda x: x != F.col("symbol_id")), 1, k)
    pairs = own.join(lists, ["cls", "salt"]).select("symbol_id", F.explode(others).alias("other"))
    return pairs.select(F.least("symbol_id", "other").alias("symbol_a"), F.greatest("symbol_id", "other").alias("symbol_b")).distinct()
