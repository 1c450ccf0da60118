"""Changes of a working tree as tables. One git command gives the whole diff; plans take it apart.

The text is that of `git diff --patch-with-raw -z --unified=0`: NUL-separated records of the changed files, an empty
record, and the patches of all files. Texts may also come from a table, one row a repository.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The head of a raw record, the line that names a patch's new file, and the head of a hunk.
RAW = r":[0-7]+ [0-7]+ [0-9a-f.]+ [0-9a-f.]+ (?:([RC][0-9]*)\x00[^\x00]*\x00([^\x00]*)|([A-Z][0-9]*)\x00([^\x00]*))(?:\x00|\z)"
NEW_FILE = r"(?d)\n--- [^\n]*\n\+\+\+ (?:b/([^\n\t]*)|/dev/null)"
HUNK = r"(?dm)^@@ -[0-9,]+ \+([0-9]+)(?:,([0-9]+))? @@"


def _zipped(text: Column, pattern: str, groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)])


def name_status(diffs: DataFrame) -> DataFrame:
    """(repo_name, file_path, status) of the raw records of diffs(repo_name, text); a null text has none.

    A renamed or copied file keeps its raw status (`R100`) and is listed by its new path.
    """
    raw = F.concat(F.substring_index("text", "\x00\x00", 1), F.lit("\x00"))
    rows = diffs.select("repo_name", F.explode(_zipped(raw, RAW, 4)).alias("r"))
    moved = F.col("r.g1") != ""
    return rows.select("repo_name", F.when(moved, F.col("r.g2")).otherwise(F.col("r.g4")).alias("file_path"), F.when(moved, F.col("r.g1")).otherwise(F.col("r.g3")).alias("status"))


def hunks(diffs: DataFrame) -> DataFrame:
    """(repo_name, file_path, start_line int, line_count int): the new side of each hunk of diffs(repo_name, text).

    A missing count is 1; pure deletions (0) and deleted files have no lines on the new side and drop out.
    """
    patch = F.element_at(F.split("text", "\x00\x00", 2), -1)
    files = diffs.select("repo_name", F.explode(F.split(F.concat(F.lit("\n"), patch), "(?d)\ndiff --git ", -1)).alias("section"))
    named = files.select("repo_name", F.regexp_extract("section", NEW_FILE, 1).alias("file_path"), F.explode(_zipped(F.col("section"), HUNK, 2)).alias("h"))
    count = F.when(F.col("h.g2") == "", 1).otherwise(F.col("h.g2").cast("int"))
    return named.select("repo_name", "file_path", F.col("h.g1").cast("int").alias("start_line"), count.alias("line_count")).where("file_path <> '' and line_count > 0")


def combined(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, hunks): a file without hunks is listed only if it was deleted."""
    lines = hunks(diffs)
    touched = lines.select("repo_name", "file_path").distinct().withColumn("touched", F.lit(True))
    files = name_status(diffs).join(touched, ["repo_name", "file_path"], "left").where("touched or status = 'D'")
    return files.select("repo_name", "file_path", "status"), lines


def _git(root: str, *args: str) -> str:
    run = subprocess.run(["git", "-c", "core.quotePath=false", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return run.stdout if run.returncode == 0 else ""


def working_diff(spark: SparkSession, root: str, repo: str, base: str = "HEAD", staged: bool = True) -> DataFrame:
    """(repo_name, text): the diff of the tree under root against base; without staged, nothing is compared with HEAD."""
    text = _git(root, "diff", "--no-color", "--no-ext-diff", "--patch-with-raw", "-z", "--unified=0", base, "--") if staged or base != "HEAD" else ""
    return spark.createDataFrame([(repo, text)], "repo_name string, text string")


def changed_files(spark: SparkSession, root: str, repo: str, base: str = "HEAD", staged: bool = True) -> DataFrame:
    """(repo_name, file_path, status): what the diff lists, and files git does not know yet as `A`."""
    new = [(repo, p) for p in _git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\x00") if p]
    rows = spark.createDataFrame(new, "repo_name string, file_path string").withColumn("status", F.lit("A"))
    return name_status(working_diff(spark, root, repo, base, staged)).join(rows, ["repo_name", "file_path"], "left_anti").unionByName(rows)


def diff_tables(spark: SparkSession, root: str, repo: str, base: str = "HEAD", staged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, hunks) of a working tree: (repo_name, file_path, status) and (repo_name, file_path, start_line, line_count)."""
    return combined(working_diff(spark, root, repo, base, staged))
