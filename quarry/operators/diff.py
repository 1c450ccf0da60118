"""Differences: trees against the store, and changed lines against symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars


def incremental(disk: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(path, state): new, changed, unchanged or deleted, for each path of either side (path, content_hash).

    force: every file on disk that is stored counts as changed, deletions are found as ever. Null hashes are equal to
    each other only.
    """
    a = disk.select("path", F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    b = stored.select("path", F.col("content_hash").alias("then"), F.lit(True).alias("there"))
    same = F.lit(False) if force else F.col("now").eqNullSafe(F.col("then"))
    state = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


#: Lines to a bin of the interval join.
BIN = 64


def overlaps(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, first, last) for each symbol and hunk(repo_name, file_path, start_line, line_count) that share lines.

    Hunks of no lines and null keys drop out. Both sides are put into bins of BIN lines, so the join's key is
    (repository, file, bin) and a file of very many symbols and hunks is no single key; a pair that shares several bins
    is taken in the first of them.
    """
    h = hunks.where("line_count > 0").select("repo_name", "file_path", F.col("start_line").alias("h_first"), (F.col("start_line") + F.col("line_count") - 1).alias("h_last"))
    s = symbols.where("start_line <= end_line").select("id", "repo_name", "file_path", F.col("start_line").alias("s_first"), F.col("end_line").alias("s_last"))
    bins = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(z) / BIN)))
    met = s.withColumn("bin", bins("s_first", "s_last")).join(h.withColumn("bin", bins("h_first", "h_last")), ["repo_name", "file_path", "bin"])
    first = F.greatest("s_first", "h_first")
    shared = met.where((F.col("s_first") <= F.col("h_last")) & (F.col("s_last") >= F.col("h_first")) & (F.floor(first / BIN) == F.col("bin")))
    return shared.select("id", first.alias("first"), F.least("s_last", "h_last").alias("last"))


def modified_symbols(symbols: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, qualified_name, file_path, start_line, end_line, changed_lines array<int>, change_type).

    files: (repo_name, file_path, status). A symbol comes once however many hunks touch it; lines are listed hunk by
    hunk, in order. The list is bounded by the lines of one symbol and the hunks on them.
    """
    lines = overlaps(symbols, hunks).groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda r: F.sequence(r["first"], r["last"]))).alias("changed_lines"))
    rows = symbols.select("id", "repo_name", "qualified_name", "file_path", "start_line", "end_line").join(lines, "id").join(files.select("repo_name", "file_path", "status"), ["repo_name", "file_path"], "left")
    kind = scalars.change_type(F.col("status"), F.col("end_line") - F.col("start_line") + 1, F.size("changed_lines"))
    return rows.select(F.col("id").alias("symbol_id"), "qualified_name", "file_path", "start_line", "end_line", "changed_lines", kind.alias("change_type"))


def index_stats(states: DataFrame) -> DataFrame:
    """One row with the counts of files by state: (scanned, new, changed, unchanged, deleted)."""
    n = lambda *names: F.coalesce(F.sum(F.col("state").isin(*names).cast("long")), F.lit(0))
    return states.agg(n("new", "changed", "unchanged").alias("scanned"), n("new").alias("new"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), n("deleted").alias("deleted"))
