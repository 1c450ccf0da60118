"""Near-duplicate paragraphs by MinHash banding, exact verification and components: the named method of problem 9.

1. A text is cut into paragraphs at blank lines. A paragraph becomes the set of its five-word shingles (lower-cased
   words; of fewer words the whole is one shingle). Equal sets are one class, of which one representative goes on.
2. BANDS bands of ROWS minimal hashes, tuned for recall: two sets of similarity s meet in a band with probability
   1 - (1 - s**ROWS)**BANDS, 0.995 at 0.8. Bands that one class alone holds end before anything wide is shuffled.
3. The classes that meet in a band are verified by their exact Jaccard similarity. A pair counts in the first band in which it
   meets, so links are counted once; a band does not list its pairs but gives each class's links and a spanning forest.
   A band of more than TILE classes is cut into tiles of pairs of salts.
4. Components of the forest edges are the clusters; of each the first paragraph is kept, the others are removals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import bloom
from ..operators.skew import HOT, join_hot
from ..session import slots, spread, staged

BANDS, ROWS = 10, 4
SHINGLE, THRESHOLD = 5, 0.8
TILE = 1024
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n\s*")
_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs of a text, blank ones left out."""
    cuts = [0, *(x for m in _BLANK_LINE.finditer(text) for x in (m.start(), m.end())), len(text)]
    return [(a, z) for a, z in zip(cuts[::2], cuts[1::2]) if text[a:z].strip()]


def shingles(paragraph: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none without words."""
    words = _WORD.findall(paragraph.lower())
    runs = [" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, min(len(words), 1)))]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(r) for r in runs], np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): the band keys of each set, all of which hold something."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        h = (flat ^ (flat >> np.uint64(29))) * _FACTOR[i] + _SHIFT[i]
        least = np.minimum.reduceat(h ^ (h >> np.uint64(32)), at)
        out[:, i // ROWS] = (out[:, i // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i // ROWS + 1)
    return out


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for cut in range(0, whole.num_rows, 2000):
            batch = whole.slice(cut, 2000)
            rows = [(d, n, a, z, shingles(t[a:z])) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d is not None and t for n, (a, z) in enumerate(pieces(t))]
            rows = [r for r in rows if len(r[4])]
            if not rows:
                continue
            raw = [r[4].tobytes() for r in rows]
            keys = bands([r[4] for r in rows]).view(np.int64)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            cls = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in raw]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cls, pa.int64()), lists, pa.array(raw, pa.binary())], names=["doc_id", "paragraph", "start_char", "end_char", "cls", "bands", "shingles"])


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that it is connected with."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float):
    def solve(band: int, cls: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[np.ndarray]:
        """Links of each class and edges to the smallest class of its tree, over the pairs that meet here first.

        side: -1 in a tile of one salt; in one of two salts, whose pairs within a salt meet elsewhere, the salt.
        """
        order = np.unique(cls, return_index=True)[1]
        cls, keys, sets, side = cls[order], keys[order], [sets[i] for i in order], side[order]
        n = len(cls)
        shared, size = np.zeros((n, n), np.float32), np.array([len(s) for s in sets])
        owner, (_, column) = np.repeat(np.arange(n), size), np.unique(np.concatenate(sets), return_inverse=True)
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        at = 0
        while at < len(column):  # the incidence of 4,096 shingles at a time
            z = int(np.searchsorted(column, column[at] + 4096))
            block = np.zeros((n, 4096), np.float32)
            block[owner[at:z], column[at:z] - column[at]] = 1
            shared += block @ block.T
            at = z
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
        np.fill_diagonal(linked, False)
        linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
        first = np.ones((n, n), bool)
        for b in range(band):
            first &= keys[:, b][:, None] != keys[:, b][None, :]
        linked &= first & (keys[:, band][:, None] == keys[:, band][None, :])
        root = _forest(linked)
        return [cls, cls[root], linked.sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done() -> pa.RecordBatch:
            cls, root, links = solve(held[0][1], np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64), [h[4] for h in held], np.array([h[5] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(root), pa.array(links.astype(np.int64))], names=["cls", "root", "links"])

        for batch in batches:
            for tile, band, cls, keys, raw, side in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and held[0][0] != tile:
                    yield done()
                    held = []
                held.append((tile, band, cls, keys, np.frombuffer(raw, "<u8"), side))
        if held:
            yield done()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; edges(a, b) both ways or one.

    Each round every node takes the least label of its neighbours, then the label of its label, so long chains shrink by
    half; rounds are written, and end when no label changes.
    """
    both = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node <> other").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")).where("node <> other")).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("least"))
        stepped = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("new"))
        jumped = stepped.join(labels.select(F.col("node").alias("new"), F.col("root").alias("further")), "new", "left")
        new = staged(jumped.select("node", F.coalesce(F.least("new", "further"), F.col("new")).alias("root"), (F.coalesce(F.least("new", "further"), F.col("new")) != F.col("root")).alias("changed")), "labels")
        labels = new.select("node", "root")
        if new.where("changed").isEmpty():
            return labels


def near_duplicate_paragraphs(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, paragraph int, start_char int, end_char int, class_id long, links long, kept boolean), one row a paragraph.

    documents: (doc_id long, text string); other columns are ignored. class_id: the cluster, of paragraphs whose shingle
    sets are equal or linked through pairs of at least `threshold`. links: how many other distinct sets a paragraph is
    linked to itself. kept: the first of its cluster by (doc_id, paragraph). A paragraph without words, an empty or null
    text and a null doc_id have no rows; rows that repeat a doc_id count once. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    once = documents.select("doc_id", "text").where("text is not null").groupBy("doc_id").agg(F.first("text").alias("text"))
    rows = staged(spread(once).mapInArrow(_paragraphs, "doc_id long, paragraph int, start_char int, end_char int, cls long, bands array<long>, shingles binary"), "paragraphs")
    members = rows.select("doc_id", "paragraph", "start_char", "end_char", "cls")
    keyed = rows.select("cls", F.posexplode("bands").alias("band", "key")).distinct()
    counts = staged(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    size = bloom.words_for(counts.count())
    met = bloom.flag(keyed, F.xxhash64("band", "key"), bloom.build(counts.select(F.xxhash64("band", "key").alias("k")), "k", size), "met", size).where("met")
    # tiles: a band of n classes has ceil(n / TILE) salts, and every pair of salts is one tile
    shared = met.join(counts, ["band", "key"]).withColumn("salts", F.ceil(F.col("n") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")
    tiled = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    tile = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other"))
    wanted = tiled.select("cls", "band", tile.alias("tile"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    sets = rows.groupBy("cls").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    full = wanted.join(sets, "cls").select("tile", "band", "cls", "bands", "shingles", "side")
    found = full.repartition(slots(spark), "tile").sortWithinPartitions("tile").mapInArrow(_verified(threshold), "cls long, root long, links long")
    found = staged(found, "found")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = links.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    copies = staged(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "classes")
    known = copies.join(info, "cls", "left").select("cls", F.coalesce("root", "cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    named = join_hot(members, known, ["cls"], copies.where(F.col("n") > HOT), ["doc_id"]).select("doc_id", "paragraph", "start_char", "end_char", "class_id", "links")
    named = staged(named, "named")
    firsts = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts, "firsts")
    kept = F.struct("doc_id", "paragraph") == F.col("first")
    found = join_hot(named, firsts.drop("n"), ["class_id"], firsts.where(F.col("n") > HOT), ["doc_id"])
    return found.select("doc_id", "paragraph", "start_char", "end_char", "class_id", "links", kept.alias("kept"))
