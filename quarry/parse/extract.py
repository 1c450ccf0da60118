"""Rows of symbols and raw edges from files, one task a batch of files; also as table functions for SQL."""

from __future__ import annotations

import contextlib
import hashlib
import signal
import threading
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from . import languages
from .text import Source

SYMBOL_ROW = "repo_name string, name string, qualified_name string, kind string, file_path string, content_hash string, code_block string, start_line int, end_line int, language string"
EDGE_ROW = "repo_name string, file_path string, kind string, symbol string, line int"


def symbols_of(text: str, language: str) -> list[dict]:
    """The symbols of a file in the order of their lines; of equal (qualified name, first line) the first wins.

    A function inside a class becomes a method and is named Class.name. An unknown language has no symbols; a Python file
    that does not parse has those that its headers and indents show.
    """
    if language == "python":
        tree = languages.python_tree(text)
        found = languages.python_symbols(text, tree) if tree else languages.broken_python_symbols(text)
    elif language in languages.SYMBOLS:
        src = Source(text, language)
        raw = sorted(languages.SYMBOLS[language](src), key=lambda s: (s.start, -s.end))
        holders = [s for s in raw if s.holds]
        found = []
        for s in raw:
            if not s.kind:
                continue
            around = [h for h in holders if h is not s and h.start <= s.start and s.end <= h.end and (h.start, h.end) != (s.start, s.end)]
            parent = s.container or (min(around, key=lambda h: h.end - h.start).name if around else "")
            kind = "method" if parent and s.kind == "function" else s.kind
            found.append((s.name, kind, parent, src.line(s.start), src.line(max(s.start, s.end - 1)), text[s.start : s.end]))
    else:
        found = []
    out, seen = [], set()
    for name, kind, parent, first, last, code in found:
        qualified = f"{parent}.{name}" if parent else name
        if (qualified, first) not in seen:
            seen.add((qualified, first))
            digest = hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()
            out.append({"name": name, "qualified_name": qualified, "kind": kind, "content_hash": digest, "code_block": code, "start_line": first, "end_line": last})
    return sorted(out, key=lambda r: r["start_line"])


def edges_of(text: str, language: str) -> list[dict]:
    """(kind, symbol, line) of a file: import, call, extends, implements; repeats kept."""
    if language == "python":
        tree = languages.python_tree(text)
        found = languages.python_edges(tree) if tree else languages.broken_python_edges(text)
        return [{"kind": k, "symbol": s, "line": line} for k, s, line in found]
    if language not in languages.EDGES:
        return []
    src = Source(text, language)
    return [{"kind": e.kind, "symbol": e.symbol, "line": src.line(e.at)} for e in languages.EDGES[language](src)]


#: Seconds that the parsing of one file may take; a file that takes longer has no rows and counts as an error.
FILE_SECONDS = 5.0


class TooSlow(Exception):
    """A file was not parsed in time."""


@contextlib.contextmanager
def time_limit(seconds: float):
    """Ends the block with TooSlow after so many seconds; without effect outside a process's main thread."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TooSlow

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parsed(content, language: str, seconds: float = FILE_SECONDS) -> tuple[list[dict], list[dict], str | None]:
    """(symbols, edges, error) of one file; a file nested beyond all measure or too slow has an error and no rows."""
    try:
        with time_limit(seconds):
            text = _text(content)
            return symbols_of(text, language), edges_of(text, language), None
    except TooSlow:
        return [], [], "timeout"
    except (RecursionError, MemoryError) as e:
        return [], [], type(e).__name__


def _text(content) -> str:
    return content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")


def _rows(one, columns: list[str], with_language: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, path, language, content in zip(batch.repo_name, batch.path, batch.language, batch.content):
                try:
                    with time_limit(FILE_SECONDS):
                        found = one(_text(content), language)
                except (RecursionError, TooSlow):  # a file nested beyond all measure, or too slow, has no rows
                    found = []
                more = {"language": language} if with_language else {}
                out += [{"repo_name": repo, "file_path": path, **more, **row} for row in found]
            yield pd.DataFrame(out, columns=columns)

    return run


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


_SYMBOL_FIELDS = "name string, qualified_name string, kind string, content_hash string, code_block string, start_line int, end_line int"
_EDGE_FIELDS = "kind string, symbol string, line int"
PARSED_ROW = f"repo_name string, file_path string, language string, symbols array<struct<{_SYMBOL_FIELDS.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{_EDGE_FIELDS.replace(' ', ':').replace(',:', ',')}>>, error string"


def _arrow(fields: str) -> pa.DataType:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.list_(pa.struct([pa.field(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]))


def parse_files(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, language, symbols array, edges array, error): one row a file, which is read and parsed once.

    files: (repo_name, path, language, content string or binary). error: null, `timeout` or what went wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repo, path, language, content = (batch.column(i).to_pylist() for i in range(4))
            found = [parsed(c, lang) for c, lang in zip(content, language)]
            arrays = [pa.array([f[0] for f in found], _arrow(_SYMBOL_FIELDS)), pa.array([f[1] for f in found], _arrow(_EDGE_FIELDS)), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(repo, pa.string()), pa.array(path, pa.string()), pa.array(language, pa.string()), *arrays], names=["repo_name", "file_path", "language", "symbols", "edges", "error"])

    return files.select("repo_name", "path", "language", "content").mapInArrow(run, PARSED_ROW)


def symbol_rows(files: DataFrame) -> DataFrame:
    """The symbols of parse_files() as rows of SYMBOL_ROW."""
    rows = files.select("repo_name", "file_path", "language", F.explode("symbols").alias("s"))
    return rows.select("repo_name", "s.name", "s.qualified_name", "s.kind", "file_path", "s.content_hash", "s.code_block", "s.start_line", "s.end_line", "language")


def edge_rows(files: DataFrame) -> DataFrame:
    """The raw edges of parse_files() as rows of EDGE_ROW."""
    return files.select("repo_name", "file_path", F.explode("edges").alias("e")).select("repo_name", "file_path", "e.kind", "e.symbol", "e.line")


def imports_of_files(edges: DataFrame) -> DataFrame:
    """(repo_name, file_path, symbol): what each file imports, each once; of edge_rows() or extract_edges()."""
    return edges.where("kind = 'import'").select("repo_name", "file_path", "symbol").distinct()


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(repo_name, path, language, content string or binary)."""
    return files.select("repo_name", "path", "language", "content").mapInPandas(_rows(symbols_of, _names(SYMBOL_ROW), True), SYMBOL_ROW)


def extract_edges(files: DataFrame) -> DataFrame:
    """Raw edges of files(repo_name, path, language, content); imports are listed but never resolved to symbols."""
    return files.select("repo_name", "path", "language", "content").mapInPandas(_rows(edges_of, _names(EDGE_ROW), False), EDGE_ROW)


@udtf(returnType="name string, qualified_name string, kind string, code_block string, start_line int, end_line int")
class CodeSymbols:
    """code_symbols(content, language): the symbols of one text, for LATERAL joins in SQL."""

    def eval(self, content: str, language: str):
        for r in symbols_of(content or "", language or ""):
            yield r["name"], r["qualified_name"], r["kind"], r["code_block"], r["start_line"], r["end_line"]


@udtf(returnType="kind string, symbol string, line int")
class CodeEdges:
    """code_edges(content, language): the raw edges of one text."""

    def eval(self, content: str, language: str):
        for r in edges_of(content or "", language or ""):
            yield r["kind"], r["symbol"], r["line"]


def register(spark: SparkSession) -> None:
    """Makes code_symbols and code_edges available to SQL."""
    spark.udtf.register("code_symbols", CodeSymbols)
    spark.udtf.register("code_edges", CodeEdges)
