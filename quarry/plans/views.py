"""The model's tables over the input tables, rows that came twice counted once; in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lookup import latest
from ..session import table

#: The repository of the registered queries; it holds a tenth of the symbols.
REPO = "harbor-monorepo"
#: What all rows of an id agree in (TESTDATA.md: repeated rows share their fields but the moment; a symbol's language may be null in one).
CONSTANT = {
    "files": ("repo_name", "path", "content_hash", "size_bytes"),
    "symbols": ("repo_name", "name", "qualified_name", "kind", "file_path", "content_hash", "code_block", "start_line", "end_line"),
    "memories": ("symbol_id", "note", "author", "is_stale", "stale_reason", "last_known_symbol", "last_known_file", "created_at"),
    "routes": ("repo_name", "method", "path_pattern", "normalized_path", "handler_symbol_id", "file_path", "start_line", "framework", "kind"),
}
MOMENTS = {"files": "last_indexed", "symbols": "indexed_at", "memories": "updated_at", "routes": "indexed_at"}
SYMBOL = ["id", "repo_name", "name", "qualified_name", "kind", "file_path", "start_line", "end_line"]


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each id, the latest; only the columns asked for are read, and filters on them reach the scan."""
    rows = table(spark, sf_dir, name)
    if name == "dependencies":
        return rows.distinct()
    if name == "vec_symbols":
        return rows.groupBy("symbol_id", "repo_name").agg(F.first("embedding").alias("embedding"))
    moment = MOMENTS[name]
    kept = [*dict.fromkeys(["id", *(columns or rows.columns), moment])]
    once = latest(rows.select(*kept), "id", moment, kept, CONSTANT[name])
    return once.select(*(columns or kept))


def symbols(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The narrow columns of the symbols, and more of them by name."""
    return view(spark, sf_dir, "symbols", [*SYMBOL, *more])


def _once(name: str, key: str, moment: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {moment} DESC) AS rn FROM {name}) WHERE rn = 1)"


SQL_VIEWS = {
    "fil": _once("files", "id", "last_indexed"),
    "sym": _once("symbols", "id", "indexed_at"),
    "mem": _once("memories", "id", "updated_at"),
    "rou": _once("routes", "id", "indexed_at"),
    "dep": "(SELECT DISTINCT caller_id, callee_id, kind FROM dependencies)",
    "vec": "(SELECT symbol_id, any_value(repo_name) AS repo_name, any_value(embedding) AS embedding FROM vec_symbols GROUP BY symbol_id)",
}


def sql(body: str, **more: str) -> str:
    """body with the views it names, and more tables, in front."""
    import re

    names = [n for n in SQL_VIEWS if re.search(rf"\b{n}\b", " ".join([body, *more.values()]))]
    parts = [f"{n} AS {SQL_VIEWS[n]}" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body.replace("$REPO", f"'{REPO}'")
