"""Full-text search: an inverted index as two tables, kept up by file and by repository, and BM25 over it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import params, scalars
from ..functions.stemmer import stem

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; everything else, underscores too, separates."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str, stemmed: bool = False) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return [stem(w) for w in words] if stemmed else words


def documents(symbols: DataFrame, callees: DataFrame | None = None) -> DataFrame:
    """(symbol_id, repo_name, file_path, column int, text): the indexed texts of each symbol.

    Columns: name, qualified name, kind, signature, keywords. callees: (caller_id, names array) adds to the keywords.
    """
    rows = symbols
    names = F.array().cast("array<string>")
    if callees is not None:
        rows = rows.join(callees.select(F.col("caller_id").alias("id"), "names"), "id", "left")
        names = F.coalesce("names", names)
    words = scalars.keywords(F.col("code_block"), F.col("kind"), names)
    texts = F.array("name", "qualified_name", "kind", scalars.signature(F.col("code_block")), words)
    return rows.select(F.col("id").alias("symbol_id"), "repo_name", "file_path", F.posexplode(texts).alias("column", "text"))


def _stems(lists: Column) -> Column:
    """Porter stems of each list's words; a worker stems a word once a batch."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda words: [known.setdefault(w, stem(w)) for w in words])

    return run(lists)


def postings(texts: DataFrame, stemmed: bool = False) -> DataFrame:
    """(term, symbol_id, repo_name, file_path, column, place int): one row for each term in documents(), places from 0.

    No shuffle: a column's terms become rows where they are.
    """
    rows = texts.select("symbol_id", "repo_name", "file_path", "column", terms(F.col("text")).alias("terms"))
    if stemmed:
        rows = rows.withColumn("terms", _stems(F.col("terms")))
    return rows.select("symbol_id", "repo_name", "file_path", "column", F.posexplode("terms").alias("place", "term")).select("term", "symbol_id", "repo_name", "file_path", "column", "place")


def arranged(index: DataFrame) -> DataFrame:
    """postings() as they are to be written: in ranges of terms, each sorted, so a search skips all row groups but those
    of its terms by their statistics; a term that most documents hold spans as many files as it needs."""
    return index.repartitionByRange(F.col("term"), F.col("symbol_id")).sortWithinPartitions("term", "symbol_id")


def lengths(texts: DataFrame) -> DataFrame:
    """(symbol_id, repo_name, file_path, length long): the terms of each document; one without terms has length 0."""
    return texts.groupBy("symbol_id", "repo_name", "file_path").agg(F.sum(F.size(terms(F.col("text")))).alias("length"))


def search(index: DataFrame, sizes: DataFrame, repo: str | None, query: str, limit: int | None = 10, stemmed: bool = False) -> DataFrame:
    """(symbol_id, rank double): documents that hold the query as one phrase in a column, by BM25, lower is better; ties by id.

    index: postings(), sizes: lengths(), both with the same stemming. The scan is filtered by the query's terms.
    Counts and mean length are over all repositories; the repository filter (None: all) comes after the match. limit
    None is 10; a query without a term matches nothing.
    """
    words = query_terms(query, stemmed)
    if not words:
        return index.sparkSession.createDataFrame([], "symbol_id long, rank double")
    wanted = index.where(F.col("term").isin(sorted(set(words))))
    if len(words) > 1:  # the n-th word stands n places after the phrase's start, which as many rows must name as it has words
        offsets = index.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, nth int")
        starts = wanted.join(F.broadcast(offsets), "term").groupBy("symbol_id", "column", (F.col("place") - F.col("nth")).alias("start"))
        wanted = starts.agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == len(words))
    hits = wanted.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("tf"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    holding = hits.agg(F.count(F.lit(1)).alias("n_hits"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5)), F.lit(1e-6))
    score = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    own = sizes if repo is None else sizes.where(F.col("repo_name") == repo)
    ranked = hits.join(own, "symbol_id").join(F.broadcast(totals)).join(F.broadcast(holding))  # one row each
    return ranked.select("symbol_id", score.alias("rank")).orderBy("rank", "symbol_id").limit(params.limit_or(limit, 10, 1 << 30))


def fts_search(texts: DataFrame, repo: str | None, query: str, limit: int | None = 10, stemmed: bool = False) -> DataFrame:
    """search() over documents() that are not stored: they are read once for the postings and once for the lengths."""
    return search(postings(texts, stemmed), lengths(texts), repo, query, limit, stemmed)
