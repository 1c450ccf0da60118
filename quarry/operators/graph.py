"""Bounded traversals and one-hop questions over the edge table (caller_id, callee_id, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import params, scalars
from ..session import staged

MAX_DEPTH, MAX_EDGES = 3, 100
ENTRY_POINTS = ["main", "init", "Init", "Main"]
NOT_CODE = ["variable", "import"]

# LIKE patterns of test files and test names; `_` is a wildcard in them.
TEST_PATHS = ["%_test.go", "%test_%", "%.test.ts", "%.test.tsx", "%.test.js", "%.test.jsx", "%.spec.ts", "%.spec.tsx", "%.spec.js", "%.spec.jsx", "%/tests/%", "%/test/%", "%/__tests__/%", "%_spec.rb"]
TEST_NAMES = ["test_%", "Test%"]


def _like(column: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | column.ilike(p)
    return found


def bfs(edges: DataFrame, root: DataFrame, depth: int, direction: str = "callees", deepest: int = MAX_DEPTH) -> DataFrame:
    """(node long, depth int, kind string): each node within `depth` steps of the root ids, once, at its least depth.

    root: (id). Roots are no result. kind: the smallest kind of the edges from the level before. Depth is clamped to
    0..deepest (3, as the tools ask) and 0 gives no rows. Each level is one join of the edges with the frontier, which is broadcast only if the
    adaptive plan finds it small; levels are written once, so none is computed again.
    """
    if direction not in ("callees", "callers"):
        raise ValueError(f"direction must be callees or callers, not {direction!r}")
    depth = params.clamp(depth, 0, deepest)
    src, dst = ("caller_id", "callee_id") if direction == "callees" else ("callee_id", "caller_id")
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("node"), "kind").where("src is not null and node is not null")
    seen = frontier = root.select(F.col("id").alias("node")).distinct()
    found = None
    for level in range(1, depth + 1):
        step = links.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").groupBy("node").agg(F.min("kind").alias("kind"))
        new = step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("depth"), "kind")
        if level < depth:
            new = staged(new, f"level{level}")
        frontier = new.select("node")
        seen = seen.unionByName(frontier)
        found = new if found is None else found.unionByName(new)
    return found if found is not None else edges.sparkSession.createDataFrame([], "node long, depth int, kind string")


def bfs_many(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "callees", deepest: int = MAX_DEPTH) -> DataFrame:
    """(root long, node long, depth int): bfs() of each of a batch of roots(id), in one traversal."""
    if direction not in ("callees", "callers"):
        raise ValueError(f"direction must be callees or callers, not {direction!r}")
    src, dst = ("caller_id", "callee_id") if direction == "callees" else ("callee_id", "caller_id")
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("node")).where("src is not null and node is not null").distinct()
    seen = frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    found = None
    for level in range(1, params.clamp(depth, 0, deepest) + 1):
        step = links.join(frontier.withColumnRenamed("node", "src"), "src").select("root", "node").distinct()
        new = staged(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)), f"level{level}")
        frontier = new.select("root", "node")
        seen = seen.unionByName(frontier)
        found = new if found is None else found.unionByName(new)
    return found if found is not None else edges.sparkSession.createDataFrame([], "root long, node long, depth int")


def call_tree(edges: DataFrame, symbols: DataFrame, root: DataFrame, depth: int = 1, direction: str = "callees", cap: int | None = MAX_EDGES, deepest: int = MAX_DEPTH) -> DataFrame:
    """(depth, symbol_id, qualified_name, kind, edge_kind, file_path, start_line): the first `cap` by depth and id.

    cap None: all, in no order. Nodes without a symbol do not show but are passed through.
    """
    nodes = bfs(edges, root, depth, direction, deepest).withColumnRenamed("kind", "edge_kind")
    shown = symbols.select(F.col("id").alias("node"), "qualified_name", "kind", "file_path", "start_line").join(nodes, "node")
    rows = shown.select("depth", F.col("node").alias("symbol_id"), "qualified_name", "kind", "edge_kind", "file_path", "start_line")
    return rows if cap is None else rows.orderBy("depth", "symbol_id").limit(cap)


def blast_radius(edges: DataFrame, symbols: DataFrame, root: DataFrame, depth: int = 2, cap: int | None = None, deepest: int = MAX_DEPTH) -> DataFrame:
    """All callers up to `depth` (clamped to 1..deepest) as call_tree rows; cap cuts the list as call_tree does."""
    return call_tree(edges, symbols, root, params.clamp(depth, 1, deepest), "callers", cap, deepest)


def blast_by_file(affected: DataFrame) -> DataFrame:
    return affected.groupBy("file_path").agg(F.count(F.lit(1)).alias("affected"))


def blast_by_depth(affected: DataFrame) -> DataFrame:
    return affected.groupBy("depth").agg(F.count(F.lit(1)).alias("affected"))


def usages(edges: DataFrame, symbols: DataFrame, repo: str, target: DataFrame) -> DataFrame:
    """(symbol_id, qualified_name, file_path, start_line, edge_kind): one row for each edge into target(id).

    Callers that are missing or of another repository drop out; two kinds from one caller are two rows.
    """
    own = symbols.where(F.col("repo_name") == repo).select(F.col("id").alias("caller_id"), "qualified_name", "file_path", "start_line")
    hits = edges.join(target.select(F.col("id").alias("callee_id")), "callee_id", "left_semi").withColumnRenamed("kind", "edge_kind")
    return hits.join(own, "caller_id").select(F.col("caller_id").alias("symbol_id"), "qualified_name", "file_path", "start_line", "edge_kind").orderBy("file_path", "start_line", "symbol_id", "edge_kind")


def neighbours(edges: DataFrame, symbols: DataFrame, ids: DataFrame, direction: str = "callees") -> DataFrame:
    """(src, id, qualified_name, edge_kind): one-hop join from ids(id), in either direction."""
    src, dst = ("caller_id", "callee_id") if direction == "callees" else ("callee_id", "caller_id")
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("id"), F.col("kind").alias("edge_kind"))
    return links.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(symbols.select("id", "qualified_name"), "id").select("src", "id", "qualified_name", "edge_kind")


def callee_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, name, times long): the names of a caller's callees and how many edges lead to each.

    Rows and no list, as a caller may have any number of callees; counted on the map side first.
    """
    named = edges.join(symbols.select(F.col("id").alias("callee_id"), "name"), "callee_id")
    return named.groupBy("caller_id", "name").agg(F.count(F.lit(1)).alias("times"))


def callee_words(edges: DataFrame, symbols: DataFrame, most: int = scalars.MAX_KEYWORDS) -> DataFrame:
    """(caller_id, names array): the first `most` callees' names that can become keywords, lower-cased, distinct, sorted.

    Keywords are the first 30 words of a sorted set, so no later name can be among them. The first of each of 16 salts
    are found before a caller's names meet.
    """
    words = callee_names(edges, symbols).select("caller_id", F.lower("name").alias("name")).where(F.octet_length("name") > 2).distinct()
    salted = words.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(16)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("caller_id", "salt").orderBy("name"))).where(F.col("r") <= most)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("caller_id").orderBy("name"))).where(F.col("r") <= most)
    return best.groupBy("caller_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def dead_code(edges: DataFrame, symbols: DataFrame, repo: str, file_path: str = "", kind: str = "", exclude_exported: bool = True, limit: int | None = 50) -> DataFrame:
    """The repository's symbols that no edge points to, by file, line and id.

    Entry points, variables and imports are left out, and exported names by default. An edge of any origin, a loop too,
    keeps a symbol alive. limit: 50 if 0 or less, 200 at most; None gives all of them.
    """
    rows = symbols.where((F.col("repo_name") == repo) & ~F.col("kind").isin(NOT_CODE) & ~F.col("name").isin(ENTRY_POINTS))
    if file_path:
        rows = rows.where(F.col("file_path") == file_path)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if exclude_exported:
        rows = rows.where(~scalars.exported(F.col("name")))
    called = edges.select(F.col("callee_id").alias("id")).where("id is not null")
    dead = rows.join(called, "id", "left_anti").orderBy("file_path", "start_line", "id")
    return dead if limit is None else dead.limit(params.limit_or(limit, 50, 200))


def is_test() -> Column:
    """Does (file_path, name) look like a test?"""
    return _like(F.col("file_path"), TEST_PATHS) | _like(F.col("name"), TEST_NAMES)


def tests_for_symbol(edges: DataFrame, symbols: DataFrame, repo: str, target: DataFrame, name: str) -> DataFrame:
    """(symbol_id, name, file_path, start_line, match_reason): tests of target(id), by file, line and id.

    `dependency`: direct callers of kind function or method in test files or with a test name. Only if there are none,
    `name_heuristic`: tests whose name holds the last part of `name`.
    """
    code = symbols.where((F.col("repo_name") == repo) & F.col("kind").isin("function", "method"))
    callers = edges.join(target.select(F.col("id").alias("callee_id")), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct()
    in_test = _like(F.col("file_path"), TEST_PATHS)
    direct = code.where(is_test()).join(callers, "id", "left_semi").withColumn("match_reason", F.lit("dependency"))
    base = name.rsplit(".", 1)[-1]
    guessed = code.where(in_test & scalars.like_any(F.col("name"), base)).withColumn("match_reason", F.lit("name_heuristic"))
    none = direct.limit(1).select(F.lit(1).alias("hit")).agg(F.count("hit").alias("hits")).where("hits = 0")  # one row or none
    fallback = guessed.join(F.broadcast(none.select(F.lit("name_heuristic").alias("match_reason"))), "match_reason", "left_semi")
    columns = [F.col("id").alias("symbol_id"), "name", "file_path", "start_line", "match_reason"]
    return direct.select(*columns).unionByName(fallback.select(*columns)).orderBy("file_path", "start_line", "symbol_id")


def resolved(raw: DataFrame, symbols: DataFrame, repo: str, attribution: str = "file") -> DataFrame:
    """(caller_id, callee_id, kind) from raw edges (file_path, kind, symbol[, line]), one row for each that resolves.

    The callee is found by name or qualified name in the whole repository; what is not found drops out. The caller is
    the first symbol of the file (`file`), or the narrowest symbol whose lines hold the edge's line (`enclosing`).
    """
    from .lookup import first_symbols, name_index

    own = symbols.where(F.col("repo_name") == repo)
    callee = name_index(symbols, repo).select(F.col("key").alias("symbol"), F.col("id").alias("callee_id"))
    known = raw.join(callee, "symbol")
    if attribution == "file":
        owners = first_symbols(own).select("file_path", F.col("id").alias("caller_id"))
        return known.join(owners, "file_path").select("caller_id", "callee_id", "kind")
    spans = own.select("file_path", F.col("id").alias("caller_id"), "start_line", "end_line")
    once = known.groupBy("file_path", "symbol", "callee_id", "kind", "line").agg(F.count(F.lit(1)).alias("times"))
    inside = once.join(spans, "file_path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    narrow = inside.groupBy("file_path", "symbol", "callee_id", "kind", "line", "times").agg(F.min_by("caller_id", F.struct(F.col("end_line") - F.col("start_line"), "caller_id")).alias("caller_id"))
    return narrow.select("caller_id", "callee_id", "kind", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("n")).drop("n")


def resolve_edges(raw: DataFrame, symbols: DataFrame, repo: str, attribution: str = "file") -> DataFrame:
    """resolved() with each edge once."""
    return resolved(raw, symbols, repo, attribution).distinct()
