"""Source trees as tables: the scan of a directory and the ignore rules."""

from __future__ import annotations

import fnmatch
import os
import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import MAX_FILE_BYTES

# Directories that a scan never enters.
SKIPPED_DIRS = ["node_modules", "dist", "build", ".git", ".next", ".nuxt", "coverage", "__pycache__", "vendor"]

# File extension to language.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".jsx": "tsx", ".go": "go", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".rs": "rust", ".java": "java", ".c": "c",
    ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hxx": "cpp", ".hh": "cpp", ".cs": "csharp",
}


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, case kept; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def language(path: Column) -> Column:
    """The language of a path by its extension, which is case-sensitive; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension(path))


def in_skipped_dir(path: Column, skipped: list[str] = SKIPPED_DIRS) -> Column:
    """Does a directory of the path (not the file itself) have one of the names?"""
    return path.rlike("(^|/)(" + "|".join(re.escape(d) for d in skipped) + ")/")


def _glob(pattern: str) -> str:
    """A shell pattern whose `*` and `?` do not cross `/`, as the body of a regular expression."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"\1", body, flags=re.S)
    return body.replace("(?>.*?", "(?>[^/]*?").replace(".*", "[^/]*")


def ignore_regex(pattern: str) -> str | None:
    """One line of an ignore file as a regular expression for the whole path; None if it never matches.

    Negation never matches; a leading slash is dropped and does not anchor; a trailing slash matches what lies in that
    directory from the root. Otherwise: the path itself, any component if there is no slash, or anything below it.
    """
    if pattern.startswith("!"):
        return None
    pattern = pattern.removeprefix("/")
    literal = re.escape(pattern.removesuffix("/"))
    if pattern.endswith("/"):
        return f"^{literal}/.*$"
    choices = [f"{literal}(/.*)?", _glob(pattern)]
    if "/" not in pattern:
        choices.append(f"(.*/)?{_glob(pattern)}(/.*)?")
    return "^(" + "|".join(choices) + ")$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Does any ignore line match? The lines become expressions once, on the driver."""
    found = F.lit(False)
    for regex in filter(None, map(ignore_regex, patterns)):
        found = found | path.rlike(regex)
    return found


def load_ignore(root: str) -> list[str]:
    """The lines of the root's ignore file without blanks and comments; [] if there is none."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            lines = [line.strip() for line in f]
    except OSError:
        return []
    return [line for line in lines if line and not line.startswith("#")]


def indexable(path: Column, size: Column, patterns: list[str] = ()) -> Column:
    """May a file be indexed: known extension, at most 1 MiB, not in a skipped directory, not ignored?"""
    return language(path).isNotNull() & (size <= MAX_FILE_BYTES) & ~in_skipped_dir(path) & ~ignored(path, list(patterns))


#: Paths that read_files() hands to the reader by name; of more it reads the tree and keeps the wanted ones.
NAMED_PATHS = 10_000


def _base(root: str) -> tuple[str, str]:
    """(root as the reader takes it, the part of its paths in front of the relative ones)."""
    base = root if "://" in root or root.startswith("file:") else "file:" + os.path.abspath(root)
    prefix = re.sub(r"^file:/*", "/", base).rstrip("/") if base.startswith("file:") else base.rstrip("/")
    return base, prefix


def _hidden(spark: SparkSession, root: str) -> list[str]:
    """Paths below root that Spark's listing passes over, as a name in them begins with `_` or `.`; known extensions only.

    Skipped directories are not entered. Only names are looked at, directory by directory.
    """
    base, prefix = _base(root)
    jvm, found, todo = spark._jvm, [], [("", False)]
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    local = prefix if base.startswith("file:") else None
    while todo:
        below, hidden = todo.pop()
        if local is not None:
            entries = [(e.name, e.is_dir(follow_symlinks=False)) for e in os.scandir(os.path.join(local, below)) if e.is_dir(follow_symlinks=False) or e.is_file()]
        else:
            entries = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{below}"))]
        for name, folder in entries:
            path, out = f"{below}{name}", hidden or name[0] in "_."
            if folder and name not in SKIPPED_DIRS:
                todo.append((path + "/", out))
            elif not folder and out and os.path.splitext(name)[1] in LANGUAGES:
                found.append(path)
    return found


_FILE_ROW = "path string, modificationTime timestamp, length long, content binary"


def _opened(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """The reader's rows of files whose own name begins with `_` or `.`, which the reader never gives; there are few.

    In a mounted file system the workers open them, elsewhere the driver does, one after another.
    """
    full = [f"{base.rstrip('/')}/{p}" for p in paths]
    if base.startswith("file:"):

        def read(batches):
            for batch in batches:
                found = []
                for path in batch.path:
                    plain = re.sub("^file:/*", "/", path)
                    info = os.stat(plain)
                    with open(plain, "rb") as f:
                        found.append((path, pd.Timestamp(int(info.st_mtime * 1000), unit="ms"), info.st_size, f.read() if info.st_size <= MAX_FILE_BYTES else b""))
                yield pd.DataFrame(found, columns=["path", "modificationTime", "length", "content"])

        return spark.createDataFrame([(p,) for p in full], "path string").mapInPandas(read, _FILE_ROW)
    fs_path, rows = spark._jvm.org.apache.hadoop.fs.Path, []
    for p in full:
        fs = fs_path(p).getFileSystem(spark._jsc.hadoopConfiguration())
        info, stream = fs.getFileStatus(fs_path(p)), fs.open(fs_path(p))
        try:
            content = bytes(stream.readAllBytes()) if info.getLen() <= MAX_FILE_BYTES else b""
        finally:
            stream.close()
        rows.append((p, datetime.fromtimestamp(info.getModificationTime() / 1000, timezone.utc), info.getLen(), content))
    return spark.createDataFrame(rows, _FILE_ROW)


def _listed(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """The reader's rows with `rel`, the path below root; only names with a known extension are listed."""
    base, prefix = _base(root)

    def named(some: list[str]) -> DataFrame:
        odd = [p for p in some if os.path.basename(p)[0] in "_."]
        even = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", f"{base.rstrip('/')}/{p}") for p in some if os.path.basename(p)[0] not in "_."]
        parts = ([spark.read.format("binaryFile").load(even)] if even else []) + ([_opened(spark, base, odd)] if odd else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    if paths is None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e[1:] for e in LANGUAGES) + "}").load(base)
        if hidden := _hidden(spark, root):
            raw = raw.unionByName(named(hidden))
    else:
        raw = named(paths)
    plain = F.regexp_replace("path", "^file:/+", "/") if base.startswith("file:") else F.col("path")
    return raw.withColumn("p", plain).withColumn("rel", F.expr(f"substring(p, {len(prefix) + 2})"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, modified) of the files under root that may be indexed; no content is read."""
    rows = _listed(spark, root).where(indexable(F.col("rel"), F.col("length"), load_ignore(_base(root)[1])))
    return rows.select(F.col("rel").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def skipped(spark: SparkSession, root: str) -> int:
    """How many files with a known extension the rules leave out."""
    return _listed(spark, root).where(~indexable(F.col("rel"), F.col("length"), load_ignore(_base(root)[1]))).count()


def scan(spark: SparkSession, root: str, repo_name: str, with_content: bool = True) -> DataFrame:
    """(repo_name, path, content_hash, size_bytes, language[, content]) of the files under root that may be indexed.

    The listing is filtered before contents are read where Spark can push it; files too large are never read.
    """
    rows = _listed(spark, root).where(F.col("length") <= MAX_FILE_BYTES)
    kept = rows.where(indexable(F.col("rel"), F.col("length"), load_ignore(_base(root)[1])))
    columns = [F.lit(repo_name).alias("repo_name"), F.col("rel").alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), language(F.col("rel")).alias("language")]
    return kept.select(*columns, *([F.col("content")] if with_content else []))


def read_files(spark: SparkSession, root: str, repo_name: str, paths: DataFrame) -> DataFrame:
    """scan() with contents of the files in paths(path) alone.

    Up to NAMED_PATHS of them are opened by name; of more, the whole tree is read and the others are dropped.
    """
    named = [r.path for r in paths.select("path").distinct().limit(NAMED_PATHS + 1).collect()]
    if len(named) > NAMED_PATHS:
        return scan(spark, root, repo_name).join(paths.select("path").distinct(), "path", "left_semi")
    if not named:
        return scan(spark, root, repo_name).limit(0)
    rows = _listed(spark, root, named).where(F.col("length") <= MAX_FILE_BYTES)
    return rows.select(F.lit(repo_name).alias("repo_name"), F.col("rel").alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), language(F.col("rel")).alias("language"), "content")
