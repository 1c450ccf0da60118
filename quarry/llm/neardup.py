"""Near-duplicate blocks: every pair of word bags with a weighted Jaccard of at least `threshold` (problem 1).

Steps, all lossless:
1. A block becomes its word bag: sorted 64-bit word hashes with counts, and the bag's own hash. Equal bags form one
   class; only its representative (smallest id) goes on, so copies never meet each other.
2. Bags are multisets, seen as sets of occurrences (word, 1st), (word, 2nd)... The fingerprint is a parity sketch:
   every occurrence flips one of 256 bits. The Hamming distance of two sketches is at most the symmetric difference
   of the sets, and weighted Jaccard >= t means a difference of at most (1-t)/(1+t) * (n_a + n_b). So a distance above
   that bound proves that a pair fails. The counts of long bags are also summed over 64 cells, up to 255 in each: the
   sums of two bags differ by no more than the sets do, so they prove by the same bound.
3. Index shards: two sets with that similarity share one of the first n - ceil(t*n) + 1 occurrences in any common
   order; rare words go first, by a fixed-size counting sketch over all bags. An occurrence that no other bag holds
   needs no entry. Each shard is a Gray-order hierarchical index: entries sorted by Gray rank of the fingerprint,
   neighbours factored into nodes (mask of the bits in which all agree, their pattern), nodes of nodes above, and
   whole groups pruned by the differences that their masks already prove.
4. Surviving pairs are verified exactly against the bags.

Null block: an empty bag; bags under `min_words` take no part. Repeated rows (same id) count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import bloom
from ..operators.skew import hot_keys, join_hot
from ..session import slots, spread, staged

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Counters of the word-frequency sketch: 2**21 of 4 bytes, a broadcast of 8 MB at most.
SKETCH_LOG2 = 21
#: Shards with more entries than this are cut into tiles of pairs of salts.
HOT = 4096
FP_WORDS = 4
#: Bags of so many words fill the fingerprint, so it proves little; they carry a sketch of their counts too.
LONG, CELLS = 128, 64
LEAF = 16
#: Classes of more copies than this are spread over salts where they are joined.
HOT_CLASS = 20_000
#: Pairs of nodes or entries compared at once, of some 100 bytes each; one pair of nodes opens to LEAF**2 at most.
PAIRS = 1 << 18
#: Pairs found that are kept until repeats are dropped and the rest is given out.
FOUND = 1 << 19

_BAG = "id long, bag_hi long, bag_lo long, n int, words binary, counts binary"


def _bags(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, his, los, ns, words, counts = [], [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = WORD.findall(text or "")
                if row is None or len(found) < min_words:
                    continue
                bag = Counter(found)
                keys = np.empty(len(bag), np.uint64)
                for i, w in enumerate(bag):
                    h = known.get(w)
                    if h is None:
                        h = xxhash.xxh3_64_intdigest(w)
                        if len(known) < 200_000:
                            known[w] = h
                    keys[i] = h
                many = np.fromiter(bag.values(), np.uint16 if len(found) < 65536 else np.uint32, len(bag))
                order = np.argsort(keys)
                keys, many = keys[order], many[order]
                wide = many.astype("<u4")
                digest = xxhash.xxh3_128_digest(keys.tobytes() + wide.tobytes())
                ids.append(row)
                his.append(int.from_bytes(digest[:8], "little", signed=True))
                los.append(int.from_bytes(digest[8:], "little", signed=True))
                ns.append(len(found))
                words.append(keys.tobytes())
                counts.append(wide.tobytes() if wide.max() > 255 else many.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ns, pa.int32()), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["id", "bag_hi", "bag_lo", "n", "words", "counts"])

    return run


def _unpack(words: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(words, "<u8")
    return keys, np.frombuffer(counts, np.uint8 if len(counts) == len(keys) else "<u4").astype(np.int64)


def word_bags(blocks: DataFrame, min_words: int) -> DataFrame:
    """(id, bag_hi, bag_lo, n, words, counts) of the blocks (id long, code_block string) with at least min_words words."""
    return spread(blocks.select("id", "code_block")).mapInArrow(_bags(min_words), _BAG)


def _frequencies(bags: DataFrame) -> np.ndarray:
    """How many bags hold a word of each sketch cell, over all bags; cells of one bag or none are 1."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_LOG2, np.int64)
        for batch in batches:
            joined = b"".join(x for x in batch.column(0).to_pylist())
            total += np.bincount((np.frombuffer(joined, "<u8") >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    merged = bags.select("words").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    table = merged.select("cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.ones(1 << SKETCH_LOG2, np.uint32)
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return counts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _entries(frequency: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_out, ids_out, ns_out, fps_out, sizes_out = [], [], [], [], []
            for row, n, words, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys, many = _unpack(words, counts)
                rep = np.repeat(keys, many)
                first = np.repeat(np.cumsum(many) - many, many)
                nth = np.arange(len(rep)) - first
                occurrence = _mix(rep + _mix(nth.astype(np.uint64) + np.uint64(1)))
                bits = (occurrence >> np.uint64(40)).astype(np.int64) % (64 * FP_WORDS)
                odd = (np.bincount(bits, minlength=64 * FP_WORDS) & 1).astype(np.uint8)
                fp = np.packbits(odd).tobytes()
                if n >= LONG:
                    cells = np.bincount((keys & np.uint64(CELLS - 1)).astype(np.int64), many, CELLS)
                    fp += np.minimum(cells, 255).astype(np.uint8).tobytes()
                often = frequency[(rep >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)].astype(np.int64)
                order = np.lexsort((occurrence, often))
                chosen = order[: n - math.ceil(threshold * n - 1e-9) + 1]
                chosen = chosen[often[chosen] > 1]
                key, freq = occurrence[chosen], often[chosen]
                hot = freq > HOT
                if hot.any():
                    cold = key[~hot]
                    tiles = [cold]
                    for k, f in zip(key[hot], freq[hot]):
                        r = -(-int(f) // HOT)
                        own = int(_mix(np.array([row], np.int64).view(np.uint64))[0]) % r
                        a, b = np.minimum(own, np.arange(r)), np.maximum(own, np.arange(r))
                        tiles.append(_mix(k + _mix((a * r + b + 1).astype(np.uint64))))
                    key = np.concatenate(tiles)
                keys_out.append(key)
                ids_out.append(np.full(len(key), row, np.int64))
                ns_out.append(np.full(len(key), n, np.int32))
                fps_out.append(fp * len(key))
                sizes_out.append(np.full(len(key), len(fp), np.int32))
            if keys_out:
                ends = np.cumsum(np.r_[np.zeros(1, np.int32), *sizes_out], dtype=np.int32)
                fps = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(fps_out))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys_out).view(np.int64)), pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(ns_out)), fps], names=["shard", "id", "n", "fp"])

    return run


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each row in the reflected Gray sequence, as words from the highest: neighbours there differ in one bit.

    Every bit of the rank is the parity of the bits from the highest to its own, over all words of the row.
    """
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for i in range(1, rank.shape[1]):  # the lowest bit of a word's rank is the parity of all before
        rank[:, i] ^= np.uint64(0) - (rank[:, i - 1] & np.uint64(1))
    return rank


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _blocks(many: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the rows of `many` whose sums are no more than `most`, or that are one row."""
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class GrayIndex:
    """Entries of several shards, sorted by (shard, Gray rank), under nodes of LEAF entries and nodes of LEAF nodes.

    A lower node ends where the next entry differs in more bits than a similar one may, so what lies under it shares a
    pattern; or after LEAF entries. A node holds the mask of the bits in which all below agree, their common pattern, and the greatest size below.
    found() descends from pairs of upper nodes to pairs of entries and drops a pair of nodes as soon as the bits that
    both masks fix differ in more places than any pair below may. It goes down to the entries block by block, so at no
    time more than PAIRS pairs of a level are held, whatever the size of a shard and however little the masks prove.
    """

    def __init__(self, shard: np.ndarray, n: np.ndarray, fp: np.ndarray, threshold: float, cells: np.ndarray | None = None):
        self.order = np.lexsort((*gray_rank(fp).T[::-1], shard))
        self.shard, self.n, self.fp = shard[self.order], n[self.order].astype(np.int64), fp[self.order]
        self.levels = []
        far = _distance(self.fp[1:], self.fp[:-1]) > self._bound(self.n[1:] + self.n[:-1], threshold)
        owner, low, high, most, least = self.shard, self.fp, self.fp, self.n, self.n
        for level in range(2):
            starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | far] if level == 0 else np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            heads = np.flatnonzero(place % LEAF == 0)
            ends = np.r_[heads[1:], len(owner)]
            low = np.bitwise_and.reduceat(low, heads, axis=0)
            high = np.bitwise_or.reduceat(high, heads, axis=0)
            most, least = np.maximum.reduceat(most, heads), np.minimum.reduceat(least, heads)
            owner = owner[heads]
            self.levels.append({"owner": owner, "start": heads, "end": ends, "mask": np.ascontiguousarray(~(low ^ high).T), "pattern": np.ascontiguousarray(low.T), "most": most, "least": least})
        self.words = np.ascontiguousarray(self.fp.T)
        self.cells = None if cells is None else cells[self.order]

    @staticmethod
    def _within(sizes_start: np.ndarray, sizes_end: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (child of left, child of right), one row each; for left == right each unordered pair once, self included."""
        a, b = sizes_end[left] - sizes_start[left], sizes_end[right] - sizes_start[right]
        many = a * b
        which = np.repeat(np.arange(len(left)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        x, y = sizes_start[left][which] + k // b[which], sizes_start[right][which] + k % b[which]
        keep = (left[which] != right[which]) | (x <= y)
        return x[keep], y[keep]

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (in the order given) of the pairs within a shard that may be similar enough."""
        found = list(self.found(threshold))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2

    def found(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, in blocks of PAIRS pairs at most."""
        lower, upper = self.levels
        starts = np.flatnonzero(np.r_[True, upper["owner"][1:] != upper["owner"][:-1]])
        ends = np.r_[starts[1:], len(upper["owner"])]
        nodes = np.arange(len(upper["owner"]))
        many = np.repeat(ends, ends - starts) - nodes  # each upper node meets itself and those after it in its shard
        for part in _blocks(many, PAIRS):
            a = np.repeat(nodes[part], many[part])
            b = a + np.arange(len(a)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            a, b = self._prune(upper, a, b, threshold)
            for a, b in self._opened(upper, a, b):
                a, b = self._prune(lower, a, b, threshold)
                for x, y in self._opened(lower, a, b):
                    yield tuple(self.order[z] for z in self._near(x, y, threshold))

    def _opened(self, nodes: dict, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start, end = nodes["start"], nodes["end"]
        for part in _blocks((end[a] - start[a]) * (end[b] - start[b]), PAIRS):
            yield self._within(start, end, a[part], b[part])

    def _near(self, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of different entries whose sizes and fingerprints do not prove that they fail."""
        low, high = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        keep = (x < y) & (low >= threshold * high - 1e-9)
        x, y, most = x[keep], y[keep], self._bound(low[keep] + high[keep], threshold)
        differ = np.zeros(len(x), np.int64)
        for words in self.words:  # most pairs fail by the first words
            differ += np.bitwise_count(words[x] ^ words[y])
            keep = differ <= most
            x, y, most, differ = x[keep], y[keep], most[keep], differ[keep]
        if self.cells is not None:
            both = np.flatnonzero((self.n[x] >= LONG) & (self.n[y] >= LONG))
            keep = np.ones(len(x), bool)
            for part in (both[at : at + PAIRS // CELLS] for at in range(0, len(both), PAIRS // CELLS)):
                differ = np.abs(self.cells[x[part]].astype(np.int16) - self.cells[y[part]]).sum(axis=1, dtype=np.int64)
                keep[part] = differ <= most[part]
            x, y = x[keep], y[keep]
        return x, y

    @staticmethod
    def _bound(total: np.ndarray, threshold: float) -> np.ndarray:
        return np.floor((1 - threshold) / (1 + threshold) * total + 1e-9).astype(np.int64)

    def _prune(self, nodes: dict, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        keep = np.minimum(nodes["most"][a], nodes["most"][b]) >= threshold * np.maximum(nodes["least"][a], nodes["least"][b]) - 1e-9
        a, b = a[keep], b[keep]
        most, differ = self._bound(nodes["most"][a] + nodes["most"][b], threshold), np.zeros(len(a), np.int64)
        for mask, pattern in zip(nodes["mask"], nodes["pattern"]):
            differ += np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            keep = differ <= most
            a, b, most, differ = a[keep], b[keep], most[keep], differ[keep]
        return a, b


def _shard_pairs(threshold: float):
    def batch_of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def solve(shard, ids, n, fp, cells) -> Iterator[pa.RecordBatch]:
        pairs, held = [], 0
        for x, y in GrayIndex(shard, n, fp, threshold, cells).found(threshold):
            a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            pairs.append(np.stack([a, b], axis=1)[a != b])
            held += len(pairs[-1])
            if held >= FOUND:
                yield batch_of(pairs)
                pairs, held = [], 0
        yield batch_of(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(i).to_numpy() for i in range(3)]
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            long = part[2] >= LONG
            starts = np.cumsum(np.r_[0, 8 * FP_WORDS + CELLS * long[:-1]])
            part.append(prints[starts[:, None] + np.arange(8 * FP_WORDS)].view(">u8").astype(np.uint64))
            cells = np.zeros((len(long), CELLS), np.uint8)
            cells[long] = prints[starts[long][:, None] + 8 * FP_WORDS + np.arange(CELLS)]
            part.append(cells)
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # sorted by shard: the last one may go on
            if last >= 50_000:
                yield from solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield from solve(*held)

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep_a, keep_b, score = [], [], []
            for i, j, wa, ca, wb, cb in zip(a, b, *(batch.column(k).to_pylist() for k in range(2, 6))):
                ka, na = _unpack(wa, ca)
                kb, nb = _unpack(wb, cb)
                _, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                low = int(np.minimum(na[x], nb[y]).sum())
                high = int(na.sum() + nb.sum()) - low
                if low >= threshold * high - 1e-9:
                    keep_a.append(i)
                    keep_b.append(j)
                    score.append(low / high)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_duplicates(blocks: DataFrame, threshold: float = 0.8, min_words: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the blocks (id long, code_block string).

    members: (rep long, id long), one row for each id with enough words; rep is the smallest id with an equal bag.
    links: (a long, b long, similarity double), a < b: representatives of different bags with at least `threshold`.
    """
    spark = blocks.sparkSession
    bags = staged(word_bags(blocks, min_words), "bags")
    members = bags.groupBy("bag_hi", "bag_lo", "id").agg(F.lit(1)).select("bag_hi", "bag_lo", "id")
    heads = members.groupBy("bag_hi", "bag_lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    frequency = _frequencies(bags)
    reps = bags.groupBy("bag_hi", "bag_lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("words").alias("words"), F.first("counts").alias("counts"))
    entries = reps.select("id", "n", "words", "counts").mapInArrow(_entries(frequency, threshold), "shard long, id long, n int, fp binary")
    parts = slots(spark)
    sharded = entries.repartition(parts, "shard").sortWithinPartitions("shard")
    pairs = staged(sharded.mapInArrow(_shard_pairs(threshold), "a long, b long").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    size = bloom.words_for(2 * pairs.count())
    named = bloom.flag(bags.select("id", "words", "counts"), F.col("id"), bloom.build(ids, "id", size), "named", size).where("named")
    needed = named.groupBy("id").agg(F.first("words").alias("words"), F.first("counts").alias("counts"))
    left = needed.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("counts").alias("ca"))
    right = needed.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("counts").alias("cb"))
    with_a = join_hot(pairs, left, ["a"], hot_keys(pairs, ["a"]), ["b"])
    both = join_hot(with_a, right, ["b"], hot_keys(pairs, ["b"]), ["a"]).select("a", "b", "wa", "ca", "wb", "cb")
    links = both.mapInArrow(_verify(threshold), "a long, b long, similarity double")
    named = join_hot(members, heads.drop("copies"), ["bag_hi", "bag_lo"], heads.where(F.col("copies") > HOT_CLASS), ["id"])
    return staged(named.select("rep", "id"), "members"), links


def expanded_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(symbol_a, symbol_b), smaller first: all pairs of ids that the classes and their links stand for.

    Grows with the square of a class; use members and links where copies are many.
    """
    hot = hot_keys(members, ["rep"], HOT_CLASS)
    x = members.select("rep", F.col("id").alias("x"))
    y = members.select("rep", F.col("id").alias("y"))
    within = join_hot(x, y, ["rep"], hot, ["x"]).where("x < y").select(F.col("x").alias("symbol_a"), F.col("y").alias("symbol_b"))
    of_a = join_hot(x.withColumnRenamed("rep", "a"), links.select("a", "b"), ["a"], hot.withColumnRenamed("rep", "a"), ["x"])
    across = join_hot(y.withColumnRenamed("rep", "b"), of_a, ["b"], hot.withColumnRenamed("rep", "b"), ["y"])
    return within.unionByName(across.select(F.least("x", "y").alias("symbol_a"), F.greatest("x", "y").alias("symbol_b")))
