"""Text to vector: a hashing embedder, a WordPiece tokenizer, static token vectors and an optional ONNX model."""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..schema import DIMENSION

# FNV-1a with 64 bits, and the steps of the linear congruential generator.
_FNV_OFFSET, _FNV_PRIME = 14695981039346656037, 1099511628211
_LCG_FACTOR, _LCG_STEP = 6364136223846793005, 1442695040888963407
_M64 = (1 << 64) - 1
# Ids of the special tokens where a vocabulary does not name them.
SPECIAL = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102}
MAX_TOKENS, MAX_WORD = 128, 100


def normalize_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.where(norm < 1e-12, x, x / np.maximum(norm, 1e-12)).astype(np.float32)


def hash_vectors(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors that depend on the text alone: a seed by FNV-1a, spread over the dimensions by the generator."""
    seeds = np.empty(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h = _FNV_OFFSET
        for byte in (text or "").encode():
            h = (h ^ byte) * _FNV_PRIME & _M64
        seeds[i] = h
    out = np.empty((len(texts), dimension), np.float32)
    for d in range(dimension):
        seeds = seeds * np.uint64(_LCG_FACTOR) + np.uint64(_LCG_STEP)
        out[:, d] = (seeds.view(np.int64) >> 32).astype(np.float32) / np.float32(2**31 - 1)
    return normalize_rows(out)


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors(texts.tolist(), dimension)))

    return embed(text)


class WordPiece:
    """Greedy longest-match tokenizer over a vocabulary of words and `##` continuations."""

    def __init__(self, vocabulary: dict[str, int], max_tokens: int = MAX_TOKENS, max_word: int = MAX_WORD):
        self.vocabulary, self.max_tokens, self.max_word = vocabulary, max_tokens, max_word
        self.special = {name: vocabulary.get(name, otherwise) for name, otherwise in SPECIAL.items()}

    @classmethod
    def from_lines(cls, text: str, **options) -> WordPiece:
        """One token a line; its number is its id."""
        return cls({line.rstrip("\r"): i for i, line in enumerate(text.split("\n")) if line.strip()}, **options)

    @classmethod
    def from_json(cls, text: str, **options) -> WordPiece:
        """The `model` part of a tokenizer file, which must be of type WordPiece."""
        model = json.loads(text)["model"]
        if model.get("type", "WordPiece") != "WordPiece":
            raise ValueError(f"not a WordPiece model: {model['type']}")
        return cls(model["vocab"], max_word=model.get("max_input_chars_per_word") or MAX_WORD, **options)

    @staticmethod
    def words(text: str) -> list[str]:
        """Lower-cased words; each punctuation mark or symbol is a word of its own."""
        out, word = [], ""
        for c in text.lower():
            if c.isspace() or unicodedata.category(c)[0] in "PS":
                if word:
                    out.append(word)
                word = ""
                if not c.isspace():
                    out.append(c)
            else:
                word += c
        return out + [word] if word else out

    def pieces(self, word: str) -> list[int]:
        unknown = [self.special["[UNK]"]]
        if len(word.encode()) > self.max_word:
            return unknown
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                found = self.vocabulary.get(("##" if at else "") + word[at:end])
                if found is not None:
                    break
            else:
                return unknown
            out.append(found)
            at = end
        return out

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ids, mask, types), each of max_tokens numbers: start, pieces cut to fit, end, zeros."""
        ids = [p for w in self.words(text or "") for p in self.pieces(w)][: self.max_tokens - 2]
        ids = [self.special["[CLS]"], *ids, self.special["[SEP]"]]
        pad = self.max_tokens - len(ids)
        return ids + [0] * pad, [1] * len(ids) + [0] * pad, [0] * self.max_tokens


def wordpiece_ids(text: Column, tokenizer: WordPiece) -> Column:
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenizer.encode(t)[0])

    return ids(text)


def static_vectors(texts: list[str], tokenizer: WordPiece, matrix: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Mean of the token vectors without start, end and ids beyond the matrix; unknown words count. No token: zeros."""
    out = np.zeros((len(texts), matrix.shape[1]), np.float32)
    skip = (tokenizer.special["[CLS]"], tokenizer.special["[SEP]"])
    for i, text in enumerate(texts):
        ids, mask, _ = tokenizer.encode(text)
        kept = [t for t, m in zip(ids, mask) if m and t not in skip and 0 <= t < len(matrix)]
        if kept:
            out[i] = matrix[kept].mean(axis=0)
    return normalize_rows(out) if normalize else out


def static_embedding(text: Column, tokenizer: WordPiece, matrix: np.ndarray, normalize: bool = True) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(static_vectors(texts.tolist(), tokenizer, matrix, normalize)))

    return embed(text)


@functools.lru_cache(maxsize=4)
def _onnx_session(model_path: str):
    """One loaded model a process: workers live on between tasks and batches."""
    import onnxruntime

    return onnxruntime.InferenceSession(model_path)


def onnx_vectors(texts: list[str], tokenizer: WordPiece, model_path: str) -> np.ndarray:
    """Mean over all unmasked positions of the model's last states, at unit length."""
    session = _onnx_session(model_path)
    encoded = [tokenizer.encode(t) for t in texts]
    feed = dict(zip(("input_ids", "attention_mask", "token_type_ids"), (np.array(x, np.int64) for x in zip(*encoded))))
    states = session.run(None, {x.name: feed[x.name] for x in session.get_inputs()})[0]
    mask = feed["attention_mask"][:, :, None].astype(np.float32)
    return normalize_rows((states * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9))


def onnx_embedding(text: Column, tokenizer: WordPiece, model_path: str) -> Column:
    """onnx_vectors() as a column; needs onnxruntime and the model file on the workers."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(onnx_vectors(texts.tolist(), tokenizer, model_path)), dtype=object)

    return embed(text)


@dataclass(frozen=True)
class Embedder:
    """One way from text to vector for the index and the search: a column for tables, vectors for a tool's query.

    name and dimension are stored with the vectors, which only the same embedder can search.
    """

    name: str
    dimension: int
    column: Callable[[Column], Column]
    vectors: Callable[[list[str]], np.ndarray]


def hash_embedder(dimension: int = DIMENSION) -> Embedder:
    return Embedder("hash", dimension, lambda text: hash_embedding(text, dimension), lambda texts: hash_vectors(texts, dimension))


def static_embedder(tokenizer: WordPiece, matrix: np.ndarray, normalize: bool = True, name: str = "static") -> Embedder:
    return Embedder(name, matrix.shape[1], lambda text: static_embedding(text, tokenizer, matrix, normalize), lambda texts: static_vectors(texts, tokenizer, matrix, normalize))


def onnx_embedder(tokenizer: WordPiece, model_path: str, dimension: int, name: str = "onnx") -> Embedder:
    return Embedder(name, dimension, lambda text: onnx_embedding(text, tokenizer, model_path), lambda texts: onnx_vectors(texts, tokenizer, model_path))


def _vocabulary(folder: str) -> WordPiece:
    """The tokenizer of a model folder: tokenizer.json, else vocab.txt."""
    for name, read in (("tokenizer.json", WordPiece.from_json), ("vocab.txt", WordPiece.from_lines)):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return read(f.read())
    raise FileNotFoundError(f"{folder} holds neither tokenizer.json nor vocab.txt")


@functools.lru_cache(maxsize=4)
def load_embedder(choice: str = "hash") -> Embedder:
    """The embedder that a setting names: `hash`, `static:FOLDER` (model.safetensors with the tensor `embeddings`, and
    config.json with `normalize` if it is there) or `onnx:FOLDER` (model.onnx); folders hold the vocabulary too.

    Loaded once a process. A folder that lacks something raises, each time it is asked for.
    """
    kind, _, folder = choice.partition(":")
    if kind in ("", "hash"):
        return hash_embedder()
    if kind == "static":
        from ..sources.tensors import float_tensor, read_tensors

        with open(os.path.join(folder, "model.safetensors"), "rb") as f:
            matrix = float_tensor(read_tensors(f.read()), "embeddings")
        settings = os.path.join(folder, "config.json")
        normalize = True
        if os.path.exists(settings):
            with open(settings, encoding="utf-8") as f:
                normalize = bool(json.load(f).get("normalize", True))
        return static_embedder(_vocabulary(folder), matrix, normalize, choice)
    if kind == "onnx":
        tokenizer, path = _vocabulary(folder), os.path.join(folder, "model.onnx")
        return onnx_embedder(tokenizer, path, onnx_vectors(["x"], tokenizer, path).shape[1], choice)
    raise ValueError(f"unknown embedder {choice!r}")
