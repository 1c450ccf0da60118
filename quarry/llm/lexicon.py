"""A transducer lexicon: frequent words with their token ids in one minimal acyclic automaton, shared by memory map."""

from __future__ import annotations

import atexit
import heapq
import io
import json
import mmap
import os
import uuid

import numpy as np
from pyspark.sql import SparkSession

from ..session import mounted, shared_dir


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words (sorted, distinct), numbered for perfect hashing.

    Built word by word from sorted input: the branch that can no longer change is folded into an equal state met before,
    so common suffixes are shared. Each edge holds the number of words that sort before those it leads to; the sum along
    a path is the word's place in the sorted list, which indexes the outputs. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    done: list[tuple] = []  # signature of each finished state: (final, ((label, target), ...))
    path: list[list] = [[False, []]]  # unfinished states along the last word: [final, [(label, target), ...]]
    last = b""

    def fold(state: list) -> int:
        signature = (state[0], tuple(state[1]))
        found = register.get(signature)
        if found is None:
            found = register[signature] = len(done)
            done.append(signature)
        return found

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            target = fold(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        for _ in word[shared:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        target = fold(path.pop())
        path[-1][1].append((last[len(path) - 1], target))
    start = fold(path[0])

    below = np.zeros(len(done), np.int64)
    for i, (final, edges) in enumerate(done):  # targets are finished before their sources
        below[i] = final + sum(below[t] for _, t in edges)
    name = np.arange(len(done))
    name[start], name[0] = 0, start
    keys, targets, skips = [], [], []
    for i, (final, edges) in enumerate(done):
        skip = int(final)
        for label, t in edges:
            keys.append(int(name[i]) << 8 | label)
            targets.append(name[t])
            skips.append(skip)
            skip += int(below[t])
    order = np.argsort(keys) if keys else np.zeros(0, np.int64)
    final = np.zeros(len(done), np.uint8)
    final[name] = [f for f, _ in done]
    return {"key": np.asarray(keys, np.int64)[order], "to": np.asarray(targets, np.int32)[order], "skip": np.asarray(skips, np.int32)[order], "final": final}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays in one block that can be mapped: a JSON head of names, kinds and places, then the values."""
    body, head = io.BytesIO(), {}
    for name, a in arrays.items():
        body.write(b"\0" * (-body.tell() % 16))
        head[name] = [a.dtype.str, len(a), body.tell()]
        body.write(a.tobytes())
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 16)
    return len(text).to_bytes(8, "little") + text + body.getvalue()


def unpack(block) -> dict[str, np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    head = json.loads(bytes(block[8 : 8 + size]))
    return {name: np.frombuffer(block, np.dtype(kind), n, 8 + size + at) for name, (kind, n, at) in head.items()}


def build(words: dict[bytes, list[int]]) -> bytes:
    """The packed lexicon of words and their ids."""
    ordered = sorted(words)
    sizes = np.array([len(words[w]) for w in ordered], np.int64)
    arrays = minimal_automaton(ordered)
    arrays["out_at"] = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    arrays["out"] = np.array([i for w in ordered for i in words[w]], np.int32)
    return pack(arrays)


class Lexicon:
    """Read side: looks up many words at once, one automaton step for all of them per byte."""

    def __init__(self, block):
        self.a = unpack(block)

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        key, to, skip = self.a["key"], self.a["to"], self.a["skip"]
        if not words or not len(key):
            return [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, place, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), sizes > 0
        for step in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(alive & (sizes > step))
            if not len(on):
                break
            wanted = state[on] << 8 | flat[starts[on] + step]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            good = key[at] == wanted
            alive[on[~good]] = False
            on, at = on[good], at[good]
            state[on] = to[at]
            place[on] += skip[at]
        alive &= self.a["final"][state] == 1
        out_at, out = self.a["out_at"], self.a["out"]
        return [tuple(out[out_at[p] : out_at[p + 1]].tolist()) if ok else None for ok, p in zip(alive.tolist(), place.tolist())]


#: Words up to so many bytes are merged over a plain list of ranks, which is quadratic but quicker there than a heap.
SHORT = 64


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, none = len(word), len(ranks) + 1 << 32
    get = ranks.get
    cuts, rank = list(range(n + 1)), [get(word[i : i + 2], none) for i in range(n - 1)]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        del cuts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            rank[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[a:z]] for a, z in zip(cuts, cuts[1:])]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one word: the adjacent pair of lowest rank first, leftmost of equals; n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT:
        return _merge_short(word, ranks)
    end = list(range(1, n + 1))
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i] = stop
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def publish(spark: SparkSession, block: bytes):
    """A function without arguments that gives the block on any executor, mapped into memory and shared by its workers.

    The block is a file in the shared folder; where that folder is no mounted path, it is a broadcast of the same bytes.
    """
    local = mounted(spark, shared_dir(spark))
    if local:
        os.makedirs(local, exist_ok=True)
        path = f"{local}/quarry-lexicon-{uuid.uuid4().hex[:12]}"
        with open(path, "wb") as f:
            f.write(block)
        atexit.register(lambda: os.path.exists(path) and os.unlink(path))

        def opened():
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

        return opened
    shared = spark.sparkContext.broadcast(block)

    def copied():
        held = mmap.mmap(-1, len(shared.value))
        held.write(shared.value)
        return held

    return copied
