"""Stretches of text that occur word for word in other documents: problem 9.

The statement asks for every run of exactly `RUN` characters that another text holds, which banding of paragraph
MinHashes cannot promise. Instead each run of a text is named by an anchor chosen from its own characters alone, so
equal runs have equal anchors wherever they stand:
1. The anchor of a run is the leftmost of its GRAM-character substrings with the smallest hash (winnowing). Neighbouring
   runs mostly share it, so a text becomes few groups of runs: (anchor, span of the group).
2. Groups are counted by (anchor, span hash), combined on the map side: only the smallest and the largest document
   matter, so a passage in a third of all documents is one row. An anchor in one document only ends there. A group
   whose whole span another document holds is shared as a whole.
3. What remains are groups at the edges of shared passages. One representative of each kind of group hashes its runs
   one by one; a run is shared if two documents stand behind its hash.
Equality is that of 64-bit hashes of the same length: of all equal pairs reported, one in 10^10 at 10^9 runs may be false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import bloom
from ..operators.skew import HOT, hot_keys, join_hot
from ..session import spread, staged

RUN, GRAM = 128, 65
#: Runs that one anchor can name: with 64, a group fits the bits of a long.
WINDOW = RUN - GRAM + 1
BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substrings of one text in O(1) each, from prefix sums of a polynomial modulo 2**64.

    Characters are first mixed to 64-bit values, the sums are mixed again; the powers are kept between texts.
    """

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            size = max(n, 2 * len(cls.powers), 4096)
            cls.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE & _M, np.uint64)], dtype=np.uint64)
            cls.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)], dtype=np.uint64)

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = n = len(codes)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes + np.uint64(0x632BE59BD9B4E019)) * self.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverses[start])


#: Bits of a gram's key that hold its place; the others are those of its hash. Equal keys but for the place are taken as
#: equal grams; which of them is the leftmost may turn at a multiple of 2**PLACE, which only makes another group.
PLACE = 20


def run_groups(h: Hashes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first run, runs, place of the anchor in the first run, text) of the groups of all texts behind each other.

    sizes: their characters, in the order in which h was made of them. First runs count from the start of h.
    """
    last = h.n - RUN + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 5
    grams = h.of(np.arange(h.n - GRAM + 1), np.arange(GRAM, h.n + 1))
    low = np.uint64((1 << PLACE) - 1)
    key = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    width = 1
    while width < WINDOW:  # the least of every WINDOW neighbours, by doubling
        step = min(width, WINDOW - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    end = np.cumsum(sizes)
    within = np.flatnonzero(np.repeat(end, sizes)[:last] - np.arange(last) >= RUN)  # runs that lie in one text
    if not len(within):
        return (np.zeros(0, np.int64),) * 5
    place = within + ((key[within].astype(np.int64) - within) & ((1 << PLACE) - 1))
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (within[1:] != within[:-1] + 1)])
    first = within[new]
    return grams[place[new]], first, np.diff(np.r_[new, len(within)]), place[new] - first, np.searchsorted(end, first, side="right")


#: Characters that are worked on at once.
AT_ONCE = 1 << 18


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [a, z) of AT_ONCE characters in all, or one longer text."""
    a = held = 0
    for z, n in enumerate(sizes.tolist()):
        if held and held + n > AT_ONCE:
            yield a, z
            a, held = z, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "span", "doc_id", "first", "runs"]
    for batch in batches:
        rows = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d is not None and t is not None and len(t) >= RUN]
        doc, every = np.array([d for d, _ in rows], np.int64), np.array([len(t) for _, t in rows], np.int64)
        for a, z in _chunks(every):
            sizes = every[a:z]
            h = Hashes("".join(t for _, t in rows[a:z]))
            anchor, first, runs, offset, text = run_groups(h, sizes)
            span = h.of(first, first + runs + RUN - 1) ^ _mix((offset * 128 + runs).astype(np.uint64))
            start = np.cumsum(sizes) - sizes
            columns = anchor.view(np.int64), span.view(np.int64), doc[a:z][text], (first - start[text]).astype(np.int32), runs.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _flat(lists: pa.Array, *fields: str) -> list[np.ndarray]:
    """The row of each element of lists of structs, and the fields."""
    values = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return [row, *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)]


def _single_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes each run of the wanted groups of a text: (span, nth run of its group, hash)."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        row, span, first, runs, low, high = _flat(batch.column(1), "span", "first", "runs", "low", "high")
        every = np.array([len(t) for t in texts], np.int64)
        for a, z in _chunks(every):
            h = Hashes("".join(texts[a:z]))
            start = np.cumsum(every[a:z]) - every[a:z]
            x, y = np.searchsorted(row, [a, z])
            many = runs[x:y].astype(np.int64)
            which = np.repeat(np.arange(x, y), many)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            at = start[row[which] - a] + first[which] + nth
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (span[which], nth.astype(np.int32), h.of(at, at + RUN).view(np.int64), low[which], high[which])], names=["span", "nth", "run", "low", "high"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the shared runs of each document, given as (first, mask) lists, to maximal stretches."""
    for batch in batches:
        row, first, mask = _flat(batch.column(1), "first", "mask")
        bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        group, nth = np.nonzero(bits)
        at = np.unique(row[group] << 40 | first[group].astype(np.int64) + nth)  # by document, then place
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, np.diff(at) > RUN])  # another document lies far beyond
        last = at[np.r_[new[1:] - 1, len(at) - 1]]
        place = lambda v: (v & (1 << 40) - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[new] >> 40)), pa.array(place(at[new])), pa.array(place(last) + np.int32(RUN))], names=["doc_id", "start_char", "end_char"])


def shared_stretches(documents: DataFrame) -> DataFrame:
    """(doc_id long, start_char int, end_char int): the maximal stretches made of runs that another doc_id holds too.

    documents: (doc_id long, text string); other columns are ignored. Null, empty and shorter texts have no stretch;
    rows that repeat a doc_id are the same document and do not count as another. Touching or overlapping runs join.
    """
    groups = staged(spread(documents.select("doc_id", "text").where(F.char_length("text") >= RUN)).mapInArrow(_groups, "anchor long, span long, doc_id long, first int, runs int"), "runs")
    # most anchors stand in one document: a filter of the others' lets few of their groups go on, before anything wide is shuffled
    shared = staged(groups.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor"), "anchors")
    size = bloom.words_for(shared.count())
    groups = staged(bloom.flag(groups, F.col("anchor"), bloom.build(shared, "anchor", size), "open", size).where("open").drop("open"), "open")
    kinds = staged(groups.groupBy("anchor", "span", "runs").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("first", "doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    # an anchor goes on if two documents hold it; several kinds of one anchor may still share single runs
    by_anchor = kinds.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.count(F.lit(1)).alias("kinds"))
    several = by_anchor.where("a < z and kinds > 1").select("anchor")
    whole = kinds.where("low < high").select("span", "runs", F.lit(-1).cast("long").alias("mask"))

    wanted = join_hot(kinds, several, ["anchor"], hot_keys(kinds, ["anchor"]), ["span"]).select(F.col("low").alias("doc_id"), F.struct("span", "first", "runs", "low", "high").alias("g"))
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list("g").alias("groups"))  # groups of one text each
    texts = documents.select("doc_id", "text").where(F.char_length("text") >= RUN)
    single = texts.join(per_doc, "doc_id").select("text", "groups").mapInArrow(_single_runs, "span long, nth int, run long, low long, high long")
    single = staged(single, "single")
    found = single.groupBy("run").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    found = staged(found.select("run", "n"), "found")
    edges = join_hot(single.where("low = high"), found.select("run"), ["run"], found.where(F.col("n") > HOT), ["span", "nth"])
    edges = edges.groupBy("span").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nth"))).alias("mask"))
    masks = whole.select("span", "mask").unionByName(edges)
    hot = kinds.groupBy("span").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    own = F.col("mask").bitwiseAND(F.expr(f"shiftrightunsigned(-1L, {WINDOW} - runs)"))
    placed = join_hot(groups, masks, ["span"], hot, ["doc_id"]).select("doc_id", "first", own.alias("mask"))
    per_doc = placed.groupBy("doc_id").agg(F.collect_list(F.struct("first", "mask")).alias("groups"))  # groups of one text each
    return per_doc.mapInArrow(_stretches, "doc_id long, start_char int, end_char int")


def shared_share(documents: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, n_chars int, shared_chars long, share double): how much of each document is shared; 0 without text."""
    sizes = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    sums = stretches.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    joined = sizes.join(sums, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
