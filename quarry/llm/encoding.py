"""Encoding of a whole corpus with a public byte-level BPE tokenizer: problem 7.

One pass counts the words of all texts; the frequent ones become a minimal acyclic transducer with their ids as outputs,
which workers map into memory. The second pass looks words up there and merges the others exactly, so the result does
not depend on which words are in the lexicon.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from . import lexicon

#: The most frequent words that become part of the lexicon: with 8 bytes and 3 ids each, a few MB.
LEXICON_WORDS = 65_536
#: Words longer than this are merged each time they occur; they would only widen the lexicon.
LONGEST = 64
#: Words a worker remembers between texts.
MEMO = 400_000
NAME = "byte_bpe_50k"


def rank_file(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# Characters of plain texts: tab to carriage return, printable ASCII, Latin letters with marks, and marks that are
# neither letters, numbers nor space.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = f"[\t-\r -~{_LETTERS}\u00a1\u00a7\u00ab\u00b0\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]*"
_SPACE = r" \t\n\r\f\v"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from text to the words of the tokenizer's pattern.

    Plain texts are split by the pattern with its Unicode classes written out for the few characters they hold, which
    takes a quarter of the time; the words are the same. Other texts are split by the pattern itself.
    """
    every = regex.compile(pattern).findall
    written = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}0-9{_LETTERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
    written = written.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    if r"\p" in written or "(?i" in written:  # a pattern with other classes has no such form
        return every
    plain, few = re.compile(_PLAIN).fullmatch, re.compile(written).findall
    return lambda text: few(text) if plain(text) else every(text)


def _counted(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(pattern)

        def flush(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            counts.update(itertools.chain.from_iterable(words(t) for t in batch.column(0).to_pylist() if t))
            if len(counts) > 200_000:
                yield flush(counts)
                counts = Counter()
        yield flush(counts)

    return run


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of the tokenizer's split occurs, over all texts."""
    return spread(texts.select(text)).mapInArrow(_counted(split_pattern()), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The `most` most frequent words that occur twice and are not too long; ties by word. Bounded by `most`."""
    counted = word_counts(texts, text).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


def compile_lexicon(words: list[str], ranks: dict[bytes, int]) -> bytes:
    encoded = {w.encode(): None for w in words}
    return lexicon.build({w: lexicon.merge(w, ranks) for w in encoded})


class Encoder:
    """Encodes texts on a worker: words are remembered, else found in the lexicon, else merged.

    What is remembered is a word's number; ids lie behind each other in one array, so texts become ids by gathering.
    """

    def __init__(self, block, ranks: dict[bytes, int], pattern: str):
        self.words = splitter(pattern)
        self.lexicon, self.ranks = lexicon.Lexicon(block), ranks
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros((1 << 14) + 1, np.int64)

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
        found = dict(zip(short, self.lexicon.find([raw[i] for i in short])))
        ids = [found.get(i) or lexicon.merge(w, self.ranks) for i, w in enumerate(raw)]
        known = len(self.number)
        ends = self.at[known] + np.cumsum([len(x) for x in ids])
        while len(self.at) <= known + len(ids):
            self.at = np.r_[self.at, np.zeros_like(self.at)]
        while len(self.ids) < ends[-1]:
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.at[known] : ends[-1]] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1] - self.at[known]))
        self.at[known + 1 : known + 1 + len(ids)] = ends
        self.number.update(zip(new, range(known, known + len(ids))))

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word of all texts, how many words each text has)."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.number) > MEMO:
            self._forget()
        if new := list(set(itertools.chain.from_iterable(split)).difference(self.number)):
            self._learn(new)
        many = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(many.sum())), many

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind each other, where each text begins, and the end)."""
        word, many = self._numbers(texts)
        start, size = self.at[word], self.at[word + 1] - self.at[word]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(many)]]

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        word, many = self._numbers(texts)
        return np.diff(np.r_[0, np.cumsum(self.at[word + 1] - self.at[word])][np.r_[0, np.cumsum(many)]])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, at = self.flat(texts)
        return [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])]


def _column(texts: DataFrame, key: str, text: str, opened, path: str, made: Callable[[Encoder, list], pa.Array], name: str, kind: str) -> DataFrame:
    """(key, name): what made() gives for the texts of each thousand rows, with one encoder a task."""
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(opened(), load_ranks(path), pattern)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), made(encoder, part.column(1).to_pylist())], names=[key, name])

    of_key = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, text)).mapInArrow(run, f"`{key}` {of_key}, {name} {kind}")


def encode_corpus(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>), one row for each row of texts; an empty or null text gives an empty list.

    path: the rank file; by default that of byte_bpe_50k. Strings of special tokens are ordinary text. No shuffle but
    that of the word counts.
    """
    path = path or rank_file()
    opened = lexicon.publish(texts.sparkSession, compile_lexicon(frequent_words(texts, text), load_ranks(path)))

    def ids(encoder: Encoder, batch: list) -> pa.Array:
        flat, at = encoder.flat(batch)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))

    return _column(texts, key, text, opened, path, ids, "ids", "array<int>")


def token_sizes(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens int) of each text; 0 for an empty or null one.

    One pass: there is no lexicon, so every word is merged once by each worker that meets it, and no id leaves one.
    """
    empty = compile_lexicon([], {})
    return _column(texts, key, text, lambda: empty, path or rank_file(), lambda encoder, batch: pa.array(encoder.sizes(batch).astype(np.int32)), "n_tokens", "int")
