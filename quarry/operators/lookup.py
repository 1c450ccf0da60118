"""Scans, point lookups, filters and simple counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars


def latest(rows: DataFrame, key: str, moment: str, columns: list[str] | None = None, constant: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the one with the greatest moment. Rows that came twice count once; null keys are dropped.

    constant: columns that all rows of a key agree in. They are grouped by, so a filter on them reaches the scan, and
    what remains is a hash aggregate if nothing but the moment differs. A key that breaks the promise keeps a row for
    each of its values.
    """
    keep = columns or rows.columns
    same = [c for c in keep if c in constant and c not in (key, moment)]
    rest = [c for c in keep if c not in (key, moment, *same)]
    groups = rows.where(F.col(key).isNotNull()).groupBy(key, *same)
    if not rest:
        return groups.agg(F.max(moment).alias(moment)).select(*keep)
    best = groups.agg(F.max(F.struct(moment, *rest)).alias("best"))
    return best.select(*[F.col(c) if c == key or c in same else F.col(f"best.{c}").alias(c) for c in keep])


def file_by_path(files: DataFrame, repo: str, path: str) -> DataFrame:
    return files.where((F.col("repo_name") == repo) & (F.col("path") == path))


def list_files(files: DataFrame, repo: str) -> DataFrame:
    return files.where(F.col("repo_name") == repo).orderBy("path")


def hash_index(files: DataFrame, repo: str) -> DataFrame:
    """(path, content_hash) of a repository: the stored side of the incremental diff; never collected."""
    return files.where(F.col("repo_name") == repo).select("path", "content_hash")


def symbol_by(symbols: DataFrame, repo: str, column: str, value: str) -> DataFrame:
    """The symbol with the smallest id whose name or qualified name is the value; at most one row."""
    hits = symbols.where((F.col("repo_name") == repo) & (F.col(column) == value))
    return hits.orderBy("id").limit(1)


def symbols_of_file(symbols: DataFrame, repo: str, path: str) -> DataFrame:
    return symbols.where((F.col("repo_name") == repo) & (F.col("file_path") == path)).orderBy("start_line", "id")


def skeleton(symbols: DataFrame, repo: str, paths: DataFrame) -> DataFrame:
    """(file_path, symbol_id, name, qualified_name, kind, signature, start_line, end_line) of the files in paths(file_path)."""
    own = symbols.where(F.col("repo_name") == repo).join(paths.select("file_path").distinct(), "file_path", "left_semi")
    return own.select("file_path", F.col("id").alias("symbol_id"), "name", "qualified_name", "kind", scalars.signature(F.col("code_block")).alias("signature"), "start_line", "end_line")


def symbols_by_ids(symbols: DataFrame, repo: str, ids: DataFrame) -> DataFrame:
    """The repository's symbols whose id is in ids(id)."""
    return symbols.where(F.col("repo_name") == repo).join(ids.select("id").distinct(), "id", "left_semi")


def outline(symbols: DataFrame, repo: str) -> DataFrame:
    """(file_path, n long, names): the names of each file in the order of their lines, joined by commas.

    A file is at most MAX_FILE_BYTES long, which bounds its names.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "id", "name")))
    rows = symbols.where(F.col("repo_name") == repo).groupBy("file_path")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda s: s["name"]), ",").alias("names"))


def name_index(symbols: DataFrame, repo: str) -> DataFrame:
    """(key, id): names and qualified names in one index; of several symbols the last stored (greatest id) wins."""
    own = symbols.where(F.col("repo_name") == repo)
    keys = own.select(F.explode(F.array("name", "qualified_name")).alias("key"), "id")
    return keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("id").alias("id"))


def edges_of(edges: DataFrame, node: int, side: str = "caller_id") -> DataFrame:
    return edges.where(F.col(side) == node)


def first_symbols(symbols: DataFrame) -> DataFrame:
    """(repo_name, file_path, id) of the first symbol of each file by line, the owner of the file's edges."""
    return symbols.groupBy("repo_name", "file_path").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))


def count_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo_name").agg(F.count(F.lit(1)).alias("symbols"))


def count_memories(memories: DataFrame) -> DataFrame:
    """(symbol_id, memories); a symbol without notes has no row."""
    return memories.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("memories"))


def unexported(name: Column) -> Column:
    return ~scalars.exported(name)


def file_bytes(paths: DataFrame, files: DataFrame, repo: str) -> DataFrame:
    """(total_bytes long): the sizes of the distinct files named in paths(file_path); unknown files add nothing."""
    own = files.where(F.col("repo_name") == repo).select(F.col("path").alias("file_path"), "size_bytes")
    return paths.select("file_path").distinct().join(own, "file_path").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def savings(total_bytes: DataFrame, response_bytes: int) -> DataFrame:
    """(file_tokens, response_tokens, saved, cost_avoided) for one answer."""
    size, response = F.col("total_bytes"), F.lit(response_bytes)
    saved = scalars.saved_tokens(size, response)
    return total_bytes.select(scalars.estimate_tokens(size).alias("file_tokens"), scalars.estimate_tokens(response).alias("response_tokens"), saved.alias("saved"), scalars.format_cost(saved).alias("cost_avoided"))
