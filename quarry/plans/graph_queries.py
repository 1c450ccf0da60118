"""Graph, join, note, route, mutation and stream operators as registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import diff, graph, memories, mutations, routes
from ..session import table
from .views import REPO, sql, symbols, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text.replace("$REPO", f"'{REPO}'"), **{k: v.replace("$REPO", f"'{REPO}'") for k, v in more.items()})
        return f

    return add


def _root(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """The node that the most edges name on that side, the smallest of equals; one row."""
    edges = table(spark, sf, "dependencies").distinct()
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


_ROOT = "SELECT {0} AS id FROM dep GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1"


def _walk(src: str, dst: str, depth: int) -> dict[str, str]:
    """Paths of at most `depth` steps by recursion, then the least depth of each node: another way than the operator's."""
    return {
        "root": _ROOT.format(src),
        "walk": f"SELECT id AS node, 0 AS depth FROM root UNION SELECT d.{dst}, w.depth + 1 FROM walk w JOIN dep d ON d.{src} = w.node WHERE w.depth < {depth}",
        "best": "SELECT node, min(depth) AS depth FROM walk GROUP BY node",
        "reached": f"SELECT b.node, b.depth::INTEGER AS depth, min(d.kind) AS kind FROM best b JOIN dep d ON d.{dst} = b.node JOIN best p ON p.node = d.{src} AND p.depth = b.depth - 1 WHERE b.depth > 0 GROUP BY b.node, b.depth",
    }


_NODES = "SELECT node, depth, kind FROM reached"


@query(_NODES, **_walk("caller_id", "callee_id", 1))
def bfs_depth1(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(view(spark, sf, "dependencies"), _root(spark, sf, "caller_id"), 1)


@query(_NODES, **_walk("caller_id", "callee_id", 2))
def bfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(view(spark, sf, "dependencies"), _root(spark, sf, "caller_id"), 2)


@query(_NODES, **_walk("caller_id", "callee_id", 3))
def bfs_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(view(spark, sf, "dependencies"), _root(spark, sf, "caller_id"), 3)


_TREE = "SELECT r.depth, r.node AS symbol_id, s.qualified_name, s.kind, r.kind AS edge_kind, s.file_path, s.start_line FROM reached r JOIN sym s ON s.id = r.node ORDER BY r.depth, r.node LIMIT 100"


@query(_TREE, **_walk("caller_id", "callee_id", 3))
def call_tree_callees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_tree(view(spark, sf, "dependencies"), symbols(spark, sf), _root(spark, sf, "caller_id"), 3)


@query(_TREE, **_walk("callee_id", "caller_id", 2))
def call_tree_callers_cap100(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_tree(view(spark, sf, "dependencies"), symbols(spark, sf), _root(spark, sf, "callee_id"), 2, "callers")


def _blast(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blast_radius(view(spark, sf, "dependencies"), symbols(spark, sf), _root(spark, sf, "callee_id"))


@query("SELECT s.file_path, count(*)::BIGINT AS affected FROM reached r JOIN sym s ON s.id = r.node GROUP BY s.file_path", **_walk("callee_id", "caller_id", 2))
def blast_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blast_by_file(_blast(spark, sf))


@query("SELECT r.depth, count(*)::BIGINT AS affected FROM reached r JOIN sym s ON s.id = r.node GROUP BY r.depth", **_walk("callee_id", "caller_id", 2))
def blast_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blast_by_depth(_blast(spark, sf))


@query("SELECT d.caller_id, d.callee_id, s.name, s.kind FROM dep d JOIN sym s ON s.id = d.callee_id")
def callee_join(spark: SparkSession, sf: str) -> DataFrame:
    names = symbols(spark, sf).select(F.col("id").alias("callee_id"), "name", "kind")
    return view(spark, sf, "dependencies").select("caller_id", "callee_id").join(names, "callee_id")


@query("SELECT caller_id, s.name, count(*)::BIGINT AS times FROM dep d JOIN sym s ON s.id = d.callee_id GROUP BY caller_id, s.name")
def callee_names(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callee_names(view(spark, sf, "dependencies"), symbols(spark, sf))


@query("SELECT caller_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list(s.name), lambda n: lower(n)), lambda n: octet_length(encode(n)) > 2)))[1:30], ',') AS names FROM dep d JOIN sym s ON s.id = d.callee_id GROUP BY caller_id HAVING max(octet_length(encode(s.name))) > 2")
def callee_words(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.callee_words(view(spark, sf, "dependencies"), symbols(spark, sf))
    return found.select("caller_id", F.array_join("names", ",").alias("names"))


_MANY = {
    "roots": "SELECT min(id) AS id FROM sym WHERE repo_name = $REPO GROUP BY kind",
    "walk": "SELECT id AS root, id AS node, 0 AS depth FROM roots UNION SELECT w.root, d.callee_id, w.depth + 1 FROM walk w JOIN dep d ON d.caller_id = w.node WHERE w.depth < 2",
    "best": "SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node",
}


@query("SELECT root, node, depth FROM best WHERE depth > 0", **_MANY)
def bfs_of_a_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels from the first symbol of each kind, in one traversal."""
    roots = symbols(spark, sf).where(F.col("repo_name") == REPO).groupBy("kind").agg(F.min("id").alias("id"))
    return graph.bfs_many(view(spark, sf, "dependencies"), roots, 2)


@query("SELECT d.caller_id, count(*)::BIGINT AS callees, count(DISTINCT s.id)::BIGINT AS known FROM dep d LEFT JOIN sym s ON s.id = d.callee_id WHERE d.caller_id IN (SELECT id FROM sym WHERE repo_name = $REPO) GROUP BY d.caller_id")
def neighbours_of_repo(spark: SparkSession, sf: str) -> DataFrame:
    """One hop from every symbol of the repository: its edges, and how many different symbols they reach."""
    edges, rows = view(spark, sf, "dependencies"), symbols(spark, sf)
    own = rows.where(F.col("repo_name") == REPO).select("id")
    hops = graph.neighbours(edges, rows, own).groupBy(F.col("src").alias("caller_id")).agg(F.count_distinct("id").alias("known"))
    out = edges.join(own.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").groupBy("caller_id").agg(F.count(F.lit(1)).alias("callees"))
    return out.join(hops, "caller_id", "left").select("caller_id", "callees", F.coalesce("known", F.lit(0)).alias("known"))


@query("SELECT d.caller_id AS symbol_id, s.qualified_name, s.file_path, s.start_line, d.kind AS edge_kind FROM dep d JOIN sym s ON s.id = d.caller_id JOIN root ON root.id = d.callee_id WHERE s.repo_name = $REPO", root=_ROOT.format("callee_id"))
def usages_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.usages(view(spark, sf, "dependencies"), symbols(spark, sf), REPO, _root(spark, sf, "callee_id"))


@query("SELECT id, qualified_name, file_path, start_line FROM sym WHERE repo_name = $REPO AND kind NOT IN ('variable', 'import') AND name NOT IN ('main', 'init', 'Init', 'Main') AND NOT regexp_matches(name, '^[A-Z]') AND id NOT IN (SELECT callee_id FROM dep)")
def dead_code_anti(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dead_code(view(spark, sf, "dependencies"), symbols(spark, sf), REPO, limit=None).select("id", "qualified_name", "file_path", "start_line")


@query("SELECT repo_name, count(*)::BIGINT AS dead FROM sym WHERE kind NOT IN ('variable', 'import') AND id NOT IN (SELECT callee_id FROM dep) GROUP BY repo_name")
def dead_code_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf).where(~F.col("kind").isin(graph.NOT_CODE))
    return rows.join(view(spark, sf, "dependencies").select(F.col("callee_id").alias("id")), "id", "left_anti").groupBy("repo_name").agg(F.count(F.lit(1)).alias("dead"))


_IN_TEST = "(" + " OR ".join(f"{{0}} ILIKE '{p}'" for p in graph.TEST_PATHS) + ")"
_TESTS = "kind IN ('function', 'method') AND repo_name = $REPO"
_DIRECT = f"SELECT id, name, file_path, start_line FROM sym WHERE {_TESTS} AND ({_IN_TEST.format('file_path')} OR name ILIKE 'test_%' OR name ILIKE 'Test%') AND id IN (SELECT caller_id FROM dep WHERE callee_id IN (SELECT id FROM root))"


@query(
    "SELECT id AS symbol_id, name, file_path, start_line, 'dependency' AS match_reason FROM direct UNION ALL SELECT id, name, file_path, start_line, 'name_heuristic' FROM sym"
    f" WHERE {_TESTS} AND {_IN_TEST.format('file_path')} AND name ILIKE '%ma%' AND NOT EXISTS (SELECT 1 FROM direct)",
    root=_ROOT.format("callee_id"), direct=_DIRECT,
)
def tests_for_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tests_for_symbol(view(spark, sf, "dependencies"), symbols(spark, sf), REPO, _root(spark, sf, "callee_id"), "Store.ma")


@query(
    f"SELECT id AS symbol_id, name, file_path, start_line, 'name_heuristic' AS match_reason FROM sym WHERE {_TESTS} AND {_IN_TEST.format('file_path')} AND name ILIKE '%ma%'",
)
def tests_for_symbol_fallback(spark: SparkSession, sf: str) -> DataFrame:
    nobody = spark.createDataFrame([(-1,)], "id long")
    return graph.tests_for_symbol(view(spark, sf, "dependencies"), symbols(spark, sf), REPO, nobody, "Store.ma")


@query("SELECT file_path, id AS symbol_id, name, kind, start_line, end_line, split_part(code_block, chr(10), 1) AS signature FROM sym WHERE repo_name = $REPO")
def file_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf, "code_block").where(F.col("repo_name") == REPO)
    return rows.select("file_path", F.col("id").alias("symbol_id"), "name", "kind", "start_line", "end_line", scalars.signature(F.col("code_block")).alias("signature"))


# changed lines

_HUNKS = "SELECT repo_name, file_path, (id % 60 + 1)::INTEGER AS start_line, (id % 5)::INTEGER AS line_count FROM rou WHERE file_path IS NOT NULL"
_MET = "SELECT s.id, greatest(s.start_line, h.start_line) AS a, least(s.end_line, h.start_line + h.line_count - 1) AS z FROM sym s JOIN hunks h ON s.repo_name = h.repo_name AND s.file_path = h.file_path AND h.line_count > 0 AND s.start_line <= h.start_line + h.line_count - 1 AND s.end_line >= h.start_line"


def _hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Changed ranges made from the routes: a few lines of each route's file."""
    rows = view(spark, sf, "routes", ["id", "repo_name", "file_path"]).where("file_path is not null")
    return rows.select("repo_name", "file_path", (F.col("id") % 60 + 1).cast("int").alias("start_line"), (F.col("id") % 5).cast("int").alias("line_count"))


@query("SELECT id, a AS \"first\", z AS \"last\" FROM met", hunks=_HUNKS, met=_MET)
def hunk_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    return diff.overlaps(symbols(spark, sf), _hunks(spark, sf))


@query(
    "SELECT s.id AS symbol_id, s.qualified_name, l.changed AS changed_lines, CASE WHEN st.status = 'A' THEN 'added' WHEN st.status = 'D' THEN 'deleted' WHEN l.n >= s.end_line - s.start_line + 1 THEN 'added' ELSE 'modified' END AS change_type"
    " FROM sym s JOIN lines l ON l.id = s.id LEFT JOIN status st ON st.repo_name = s.repo_name AND st.file_path = s.file_path",
    hunks=_HUNKS, met=_MET, status="SELECT repo_name, file_path, CASE WHEN min(id) % 4 = 0 THEN 'A' ELSE 'M' END AS status FROM rou WHERE file_path IS NOT NULL GROUP BY repo_name, file_path",
    flat="SELECT id, a, z, row_number() OVER (ORDER BY id, a, z) AS hit, unnest(range(a, z + 1)) AS line FROM met", lines="SELECT id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY a, z, hit, line) AS changed FROM flat GROUP BY id",
)
def modified_symbols(spark: SparkSession, sf: str) -> DataFrame:
    status = view(spark, sf, "routes", ["id", "repo_name", "file_path"]).where("file_path is not null").groupBy("repo_name", "file_path").agg(F.when(F.min("id") % 4 == 0, "A").otherwise("M").alias("status"))
    found = diff.modified_symbols(symbols(spark, sf), _hunks(spark, sf), status)
    return found.select("symbol_id", "qualified_name", F.array_join(F.col("changed_lines").cast("array<string>"), ",").alias("changed_lines"), "change_type")


# routes


_SCORED = {
    "pairs": "SELECT d.repo_name, d.id AS def_id, c.id AS call_id, d.normalized_path AS dp, c.normalized_path AS cp, string_split(trim(d.normalized_path, '/'), '/') AS ds, string_split(trim(c.normalized_path, '/'), '/') AS cs FROM $SIDE d JOIN $SIDE c ON d.repo_name = c.repo_name AND d.kind = 'definition' AND c.kind = 'call_site' AND (d.method = c.method OR d.method = '*' OR c.method = '*')",
    "scored": "SELECT repo_name, def_id, call_id, (CASE WHEN dp = cp THEN 1.0 WHEN len(ds) = len(cs) AND len(list_filter(range(1, len(ds) + 1), lambda i: ds[i] = cs[i] OR ds[i] LIKE ':%' OR cs[i] LIKE ':%')) = len(ds) THEN 0.9 WHEN starts_with(dp, cp) OR starts_with(cp, dp) THEN 0.5 ELSE 0 END)::DOUBLE AS confidence FROM pairs",
}


_SHORT = "SELECT id, 'all' AS repo_name, upper(method) AS method, kind, regexp_replace(normalized_path, '^(/[a-z0-9]+).*(/[^/]*)$', '\\1\\2') AS normalized_path FROM rou"


def _one_repo(spark: SparkSession, sf: str) -> DataFrame:
    """All routes, with shortened paths, as if they belonged to one repository, so that every confidence occurs."""
    rows = view(spark, sf, "routes", ["id", "method", "normalized_path", "kind"])
    short = F.regexp_replace("normalized_path", "^(/[a-z0-9]+).*(/[^/]*)$", "$1$2")
    return rows.select("id", F.lit("all").alias("repo_name"), F.upper("method").alias("method"), short.alias("normalized_path"), "kind")


@query("SELECT def_id, call_id, confidence FROM scored WHERE confidence > 0", one=_SHORT, **{k: v.replace("$SIDE", "one") for k, v in _SCORED.items()})
def route_match_across(spark: SparkSession, sf: str) -> DataFrame:
    return routes.match(_one_repo(spark, sf)).drop("repo_name")


@query("SELECT repo_name, def_id, call_id, confidence FROM scored WHERE confidence > 0", **{k: v.replace("$SIDE", "rou") for k, v in _SCORED.items()})
def route_match_scored(spark: SparkSession, sf: str) -> DataFrame:
    return routes.match(view(spark, sf, "routes", ["id", "repo_name", "method", "normalized_path", "kind"]))


@query(
    "SELECT s.repo_name, d.method AS dm, d.normalized_path AS dp, c.method AS cm, c.normalized_path AS cp, s.confidence, count(DISTINCT d.id)::BIGINT AS defs, count(DISTINCT c.id)::BIGINT AS calls FROM scored s"
    " JOIN one d ON d.id = s.def_id JOIN one c ON c.id = s.call_id WHERE confidence > 0 GROUP BY ALL", one=_SHORT, **{k: v.replace("$SIDE", "one") for k, v in _SCORED.items()})
def route_match_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of route_match_across between classes of equal routes, with the members of each class counted."""
    return routes.match_classes(_one_repo(spark, sf))


@query("SELECT r.id, r.method, r.path_pattern, coalesce(s.qualified_name, '') AS handler FROM rou r LEFT JOIN sym s ON s.id = r.handler_symbol_id")
def handler_left_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "routes", ["id", "method", "path_pattern", "handler_symbol_id"])
    return routes.with_handler(rows, symbols(spark, sf)).select("id", "method", "path_pattern", "handler")


@query("SELECT id, method, normalized_path FROM rou WHERE repo_name = $REPO AND method = 'GET' AND (path_pattern ILIKE '%/a%' OR normalized_path ILIKE '%/a%')")
def find_routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "routes", ["id", "repo_name", "method", "path_pattern", "normalized_path", "file_path", "kind"])
    return routes.find(rows, REPO, method="get", path="/a", limit=None).select("id", "method", "normalized_path")


# notes

_MEM = ["id", "symbol_id", "note", "author", "is_stale", "stale_reason", "last_known_symbol", "last_known_file", "created_at", "updated_at"]
_STATE = "id, symbol_id, is_stale, stale_reason, last_known_symbol, last_known_file"


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "memories", _MEM)


def _state(rows: DataFrame) -> DataFrame:
    return rows.select("id", "symbol_id", "is_stale", "stale_reason", "last_known_symbol", "last_known_file")


@query("SELECT m.id, m.note, s.qualified_name FROM mem m JOIN sym s ON s.id = m.symbol_id WHERE s.name ILIKE '%re%' OR s.qualified_name ILIKE '%re%' ORDER BY m.created_at DESC, m.id LIMIT 20 OFFSET 5")
def memory_join_paged(spark: SparkSession, sf: str) -> DataFrame:
    named = symbols(spark, sf).where(scalars.like_any(F.col("name"), "re") | scalars.like_any(F.col("qualified_name"), "re"))
    joined = _notes(spark, sf).join(named.select(F.col("id").alias("symbol_id"), "qualified_name"), "symbol_id")
    return memories.paged(joined, 5, 20).select("id", "note", "qualified_name")


_GONE = "SELECT DISTINCT repo_name, path AS file_path FROM fil WHERE id % 5 = 0"


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files", ["id", "repo_name", "path"]).where("id % 5 = 0").select("repo_name", F.col("path").alias("file_path"))


@query(
    "SELECT m.id, CASE WHEN n.symbol_id IS NULL THEN m.symbol_id END AS symbol_id, coalesce(is_stale, false) OR n.symbol_id IS NOT NULL AS is_stale, CASE WHEN n.symbol_id IS NOT NULL AND NOT is_stale THEN 'hash_changed' ELSE stale_reason END AS stale_reason,"
    " CASE WHEN n.symbol_id IS NOT NULL AND NOT is_stale THEN n.qualified_name ELSE last_known_symbol END AS last_known_symbol, CASE WHEN n.symbol_id IS NOT NULL AND NOT is_stale THEN n.file_path ELSE last_known_file END AS last_known_file"
    " FROM mem m LEFT JOIN newly n ON n.symbol_id = m.symbol_id",
    gone=_GONE, newly="SELECT DISTINCT s.id AS symbol_id, s.qualified_name, s.file_path FROM sym s JOIN gone g ON g.repo_name = s.repo_name AND g.file_path = s.file_path JOIN mem ON mem.symbol_id = s.id AND NOT mem.is_stale",
)
def snapshot_stale(spark: SparkSession, sf: str) -> DataFrame:
    return _state(memories.snapshot_stale(_notes(spark, sf), symbols(spark, sf), _gone(spark, sf), "hash_changed"))


@query(
    "SELECT m.id, CASE WHEN m.symbol_id IS NULL AND h.home IS NOT NULL THEN h.home ELSE m.symbol_id END AS symbol_id, CASE WHEN m.symbol_id IS NULL AND h.home IS NOT NULL THEN false ELSE is_stale END AS is_stale,"
    " CASE WHEN m.symbol_id IS NULL AND h.home IS NOT NULL THEN NULL ELSE stale_reason END AS stale_reason, m.last_known_symbol, m.last_known_file FROM mem m LEFT JOIN homes h ON h.q = m.last_known_symbol AND h.f = m.last_known_file",
    homes="SELECT qualified_name AS q, s.file_path AS f, max(s.id) AS home FROM sym s WHERE EXISTS (SELECT 1 FROM fil WHERE fil.repo_name = s.repo_name AND fil.path = s.file_path) GROUP BY qualified_name, s.file_path",
)
def relink_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return _state(memories.relink(_notes(spark, sf), symbols(spark, sf), view(spark, sf, "files", ["repo_name", "path"])))


@query(f"SELECT {_STATE} FROM mem WHERE NOT (coalesce(is_stale, false) AND (symbol_id IS NULL OR symbol_id IN (SELECT id FROM sym WHERE repo_name = $REPO)))")
def purge_stale_all(spark: SparkSession, sf: str) -> DataFrame:
    return _state(memories.purge_stale(_notes(spark, sf), symbols(spark, sf), REPO))


@query(f"SELECT {_STATE} FROM mem WHERE NOT (coalesce(is_stale, false) AND symbol_id IS NULL)")
def purge_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return _state(memories.purge_stale(_notes(spark, sf), symbols(spark, sf), REPO, True))


@query("SELECT id, CASE WHEN symbol_id IN (SELECT s.id FROM sym s JOIN gone g ON g.repo_name = s.repo_name AND g.file_path = s.file_path) THEN NULL ELSE symbol_id END AS symbol_id FROM mem", gone=_GONE)
def detach_memories(spark: SparkSession, sf: str) -> DataFrame:
    hit = symbols(spark, sf).join(_gone(spark, sf), ["repo_name", "file_path"], "left_semi").select("id")
    return memories.detach(_notes(spark, sf), hit).select("id", "symbol_id")


@query("SELECT symbol_id, note, author FROM (SELECT symbol_id, note, CASE WHEN author IN ('agent', 'developer') THEN author ELSE 'agent' END AS author FROM mem UNION ALL SELECT symbol_id, 'again: ' || min(note), 'agent' FROM mem WHERE symbol_id IS NOT NULL GROUP BY symbol_id)")
def save_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Notes after a batch of saves: one new note for each symbol that has notes, and one that it has already."""
    from datetime import datetime

    notes = _notes(spark, sf).withColumn("author", scalars.author(F.col("author")))
    per_symbol = notes.where("symbol_id is not null").groupBy("symbol_id").agg(F.min("note").alias("note"))
    new = per_symbol.select("symbol_id", F.concat(F.lit("again: "), "note").alias("note"), F.lit("somebody").alias("author")).unionByName(per_symbol.withColumn("author", F.lit("agent")))
    return memories.save(notes, new, datetime(2025, 1, 1)).select("symbol_id", "note", "author")


@query("SELECT last_known_symbol, last_known_file, count(*)::BIGINT AS notes, min(id) AS first_id FROM mem WHERE symbol_id IS NULL AND last_known_symbol IS NOT NULL AND last_known_file IS NOT NULL GROUP BY ALL")
def orphan_groups(spark: SparkSession, sf: str) -> DataFrame:
    return memories.orphans_by_key(_notes(spark, sf))


@query("SELECT last_known_symbol, last_known_file, id FROM mem WHERE symbol_id IS NULL AND last_known_symbol IS NOT NULL AND last_known_file IS NOT NULL")
def orphan_members(spark: SparkSession, sf: str) -> DataFrame:
    return memories.orphan_members(_notes(spark, sf))


@query("SELECT id, symbol_id, note FROM mem WHERE symbol_id IN (SELECT id FROM sym WHERE repo_name = $REPO)")
def memories_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    own = symbols(spark, sf).where(F.col("repo_name") == REPO).select("id")
    return memories.of_symbols(_notes(spark, sf), own).select("id", "symbol_id", "note")


@query("SELECT m.id, s.qualified_name FROM mem m JOIN sym s ON s.id = m.symbol_id WHERE s.repo_name = $REPO AND s.file_path = (SELECT min(file_path) FROM sym JOIN mem ON mem.symbol_id = sym.id WHERE repo_name = $REPO)")
def memories_by_file(spark: SparkSession, sf: str) -> DataFrame:
    rows, notes = symbols(spark, sf), _notes(spark, sf)
    noted = rows.where(F.col("repo_name") == REPO).join(notes.select(F.col("symbol_id").alias("id")), "id", "left_semi")
    path = noted.agg(F.min("file_path")).first()[0] or ""  # the parameter of the lookup
    return memories.of_file(notes, rows, REPO, path).select("id", "qualified_name")


# mutations


@query("SELECT repo_name, path, CASE WHEN id % 3 = 0 THEN concat(content_hash, '-new') ELSE content_hash END AS content_hash, CASE WHEN id % 3 = 0 THEN coalesce(size_bytes, 0) + 1 ELSE size_bytes END AS size_bytes FROM fil UNION ALL SELECT 'new-repo', path, content_hash, size_bytes FROM fil WHERE repo_name = $REPO")
def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files", ["id", "repo_name", "path", "content_hash", "size_bytes"])
    changed = files.where("id % 3 = 0").select("repo_name", "path", F.concat("content_hash", F.lit("-new")).alias("content_hash"), (F.coalesce("size_bytes", F.lit(0)) + 1).alias("size_bytes"))
    added = files.where(F.col("repo_name") == REPO).select(F.lit("new-repo").alias("repo_name"), "path", "content_hash", "size_bytes")
    return mutations.upsert(files.drop("id"), changed.unionByName(added), ["repo_name", "path"])


@query("SELECT repo_name, qualified_name, file_path, max(id) AS id, arg_max(content_hash, id) AS content_hash FROM sym GROUP BY repo_name, qualified_name, file_path")
def replace_symbols_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf, "content_hash").select("repo_name", "qualified_name", "file_path", "id", "content_hash", F.col("id").alias("seq"))
    return mutations.last_wins(rows, ["repo_name", "qualified_name", "file_path"], "seq")


@query("SELECT DISTINCT caller_id, callee_id, kind FROM dependencies UNION SELECT DISTINCT callee_id, caller_id, 'call' FROM dependencies")
def ignore_duplicate_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "dependencies")
    back = edges.select(F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("callee_id"), F.lit("call").alias("kind"))
    return mutations.add_edges(edges, back)


@query("SELECT caller_id, callee_id, kind FROM dep WHERE caller_id NOT IN (SELECT s.id FROM sym s JOIN gone g ON g.repo_name = s.repo_name AND g.file_path = s.file_path)", gone=_GONE)
def semi_delete_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.without_edges_of_files(view(spark, sf, "dependencies"), symbols(spark, sf), _gone(spark, sf))


@query("SELECT id, file_path FROM sym s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_name = s.repo_name AND g.file_path = s.file_path)", gone=_GONE)
def delete_symbols_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.without_files(symbols(spark, sf), _gone(spark, sf)).select("id", "file_path")


@query("SELECT repo_name, count(*)::BIGINT AS routes FROM (SELECT repo_name FROM rou WHERE repo_name <> $REPO OR repo_name IS NULL UNION ALL SELECT repo_name FROM rou WHERE kind = 'definition') GROUP BY repo_name")
def routes_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Routes after one repository's were dropped and the definitions of all appended."""
    rows = view(spark, sf, "routes", ["id", "repo_name", "kind"])
    return mutations.append(mutations.without_repo(rows, REPO), rows.where("kind = 'definition'")).groupBy("repo_name").agg(F.count(F.lit(1)).alias("routes"))


@query("SELECT caller_id, callee_id, kind FROM dep WHERE caller_id IN (SELECT id FROM sym) AND callee_id IN (SELECT id FROM sym)")
def live_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.live_edges(view(spark, sf, "dependencies"), symbols(spark, sf))


@query("SELECT len(embedding)::INTEGER AS dimension, count(*)::BIGINT AS vectors FROM vec WHERE embedding IS NOT NULL AND len(embedding) <> 128 GROUP BY 1")
def dimension_check(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.check_dimension(view(spark, sf, "vec_symbols"), 128)


@query(
    "SELECT DISTINCT f.id AS caller_id, n.id AS callee_id, r.kind FROM raws r JOIN names n ON n.key = r.symbol JOIN firsts f ON f.file_path = r.file_path",
    raws="SELECT file_path, 'call' AS kind, name AS symbol FROM sym WHERE repo_name = $REPO",
    names="SELECT key, max(id) AS id FROM (SELECT name AS key, id FROM sym WHERE repo_name = $REPO UNION ALL SELECT qualified_name, id FROM sym WHERE repo_name = $REPO) GROUP BY key",
    firsts="SELECT file_path, arg_min(id, start_line * 10000000000 + id) AS id FROM sym WHERE repo_name = $REPO GROUP BY file_path",
)
def name_index_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw reference of the repository."""
    rows = symbols(spark, sf)
    raw = rows.where(F.col("repo_name") == REPO).select("file_path", F.lit("call").alias("kind"), F.col("name").alias("symbol"))
    return graph.resolve_edges(raw, rows, REPO)


@query(
    "SELECT DISTINCT (SELECT arg_min(o.id, struct_pack(w := o.end_line - o.start_line, id := o.id)) FROM own o WHERE o.file_path = r.file_path AND r.line BETWEEN o.start_line AND o.end_line) AS caller_id, n.id AS callee_id, 'call' AS kind FROM raws r JOIN names n ON n.key = r.symbol WHERE EXISTS (SELECT 1 FROM own o WHERE o.file_path = r.file_path AND r.line BETWEEN o.start_line AND o.end_line)",
    own="SELECT id, name, qualified_name, file_path, start_line, end_line FROM sym WHERE repo_name = $REPO",
    raws="SELECT file_path, name AS symbol, end_line + id % 7 - 3 AS line FROM own",
    names="SELECT key, max(id) AS id FROM (SELECT name AS key, id FROM own UNION ALL SELECT qualified_name, id FROM own) GROUP BY key",
)
def enclosing_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """References from lines about the ends of symbols, each the call of the narrowest symbol around it; some lie between two."""
    rows = symbols(spark, sf)
    raw = rows.where(F.col("repo_name") == REPO).select("file_path", F.lit("call").alias("kind"), F.col("name").alias("symbol"), (F.col("end_line") + F.col("id") % 7 - 3).cast("int").alias("line"))
    return graph.resolve_edges(raw, rows, REPO, "enclosing")


@query("SELECT r.id, coalesce(s.name, '') AS handler_name FROM rou r LEFT JOIN sym s ON s.id = r.handler_symbol_id WHERE r.kind = 'definition'")
def route_handler_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "routes", ["id", "handler_symbol_id", "kind"]).where("kind = 'definition'")
    names = symbols(spark, sf).select("id", F.col("name").alias("qualified_name"))
    return routes.with_handler(rows, names).select("id", F.col("handler").alias("handler_name"))


@query("SELECT symbol_id, repo_name FROM vec WHERE repo_name <> $REPO OR repo_name IS NULL")
def vectors_without_repo(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors after one repository's were deleted."""
    return mutations.without_repo(view(spark, sf, "vec_symbols"), REPO).select("symbol_id", "repo_name")


@query(
    "SELECT symbol_id, repo_name, round(list_sum(list_transform(e, lambda x: x::DOUBLE)), 4) AS total FROM (SELECT v.symbol_id, v.repo_name, CASE WHEN v.symbol_id % 3 = 0 THEN list_reverse(v.embedding) ELSE v.embedding END AS e FROM good v UNION ALL SELECT -symbol_id, 'new', embedding FROM good WHERE symbol_id % 7 = 0)",
    good="SELECT symbol_id, repo_name, embedding FROM vec WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0",
)
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of new vectors, some of them for symbols that have one."""
    good = view(spark, sf, "vec_symbols").where(F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnan))
    new = good.where("symbol_id % 3 = 0").select("symbol_id", "repo_name", F.reverse("embedding").alias("embedding"))
    more = good.where("symbol_id % 7 = 0").select((-F.col("symbol_id")).alias("symbol_id"), F.lit("new").alias("repo_name"), "embedding")
    after = mutations.upsert(good, new.unionByName(more), ["symbol_id"])
    return after.select("symbol_id", "repo_name", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
