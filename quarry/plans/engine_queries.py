"""The index, the store and the tools end to end, as registered queries over trees and stores made from the tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..index_job import forget, index
from ..operators import fulltext, graph
from ..service import MEMORY_TOOLS, TOOLS, Service, enabled
from ..session import mounted, scratch, staged
from ..store import Store
from .source_queries import INDEXED, TREE, tree, tree_of
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


# the index

_FILES = f"SELECT path, sha256(content) AS content_hash, octet_length(encode(content))::BIGINT AS size_bytes FROM (SELECT repo_name || '/' || file_path AS path, content FROM tree) WHERE {INDEXED.format('path')}"


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch(spark, "store"))


_INDEXED: dict[tuple[str, str], Store] = {}


def _indexed(spark: SparkSession, sf: str) -> Store:
    """A new store of the whole tree, which stays for the runs without changes of the same session."""
    store = _INDEXED[spark.sparkContext.applicationId, sf] = _store(spark)
    index(spark, tree(spark, sf), "all", store)
    return store


@query(_FILES, tree=TREE)
def indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The stored files after the first index of the whole tree."""
    store = _indexed(spark, sf)
    return store.read("files", "all").select("path", "content_hash", "size_bytes")


@query(
    "SELECT count(*) FILTER (WHERE NOT gone)::BIGINT AS scanned, count(*) FILTER (WHERE fresh)::BIGINT AS \"new\", count(*) FILTER (WHERE edited)::BIGINT AS changed, count(*) FILTER (WHERE NOT gone AND NOT fresh AND NOT edited)::BIGINT AS unchanged, count(*) FILTER (WHERE gone)::BIGINT AS deleted,"
    " (SELECT count(*) FROM every WHERE NOT keep)::BIGINT AS skipped FROM (SELECT length(path) % 5 = 0 AS gone, length(path) % 5 = 1 AS edited, false AS fresh FROM every WHERE keep UNION ALL SELECT false, false, true FROM every WHERE keep AND length(path) % 7 = 0)",
    tree=TREE, every="SELECT path, path_ok AS keep FROM (SELECT path, content, " + INDEXED.format("path") + " AS path_ok FROM (SELECT file_path AS path, content FROM tree WHERE repo_name = $REPO))",
)
def index_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the second run over a repository reports, after some files went, some changed and some came."""
    root = mounted(spark, scratch(spark, "tree"))
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "id", "code_block")))
    own = symbols(spark, sf, "code_block").where(F.col("repo_name") == REPO).groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(ordered, lambda s: s["code_block"]), "\n").alias("content"))
    files = staged(own, "files")
    tree_of(files, root)
    store = _store(spark)
    index(spark, root, REPO, store)
    kept = store.read("files", REPO).select("path").collect()  # the change set of the fixture, made on the driver
    for r in kept:
        full = os.path.join(root, r.path)
        if len(r.path) % 5 == 0:
            os.unlink(full)
        elif len(r.path) % 5 == 1:
            with open(full, "a") as f:
                f.write("\n")
        if len(r.path) % 7 == 0:
            folder, name = os.path.split(full)
            with open(os.path.join(folder, "fresh" + name), "w") as f:
                f.write("x = 1\n")
    s = index(spark, root, REPO, store)
    return spark.createDataFrame([(s.scanned, s.new, s.changed, s.unchanged, s.deleted, s.skipped)], "scanned long, new long, changed long, unchanged long, deleted long, skipped long")


@query(f"SELECT count(*)::BIGINT AS unchanged, 0::BIGINT AS written FROM ({_FILES})", tree=TREE)
def reindex_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """A run over a tree that is as it was: nothing is read but what is hashed, and nothing is written."""
    store = _INDEXED.get((spark.sparkContext.applicationId, sf)) or _indexed(spark, sf)
    before = store.version("symbols", "all")
    again = index(spark, tree(spark, sf), "all", store)
    return spark.createDataFrame([(again.unchanged, int(store.version("symbols", "all") != before))], "unchanged long, written long")


# the store


def _filled(spark: SparkSession, sf: str, root: str = "/nonexistent") -> Service:
    """A service over a store that holds one repository's rows of the tables."""
    store = _store(spark)
    rows = view(spark, sf, "symbols")
    own = staged(rows.where(F.col("repo_name") == REPO), "own")
    edges = view(spark, sf, "dependencies").join(own.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").select("caller_id", "callee_id", "kind")
    texts = staged(fulltext.documents(own, graph.callee_words(edges, own)), "texts")
    of_repo = lambda name: view(spark, sf, name).where(F.col("repo_name") == REPO)
    store.commit({
        ("symbols", REPO): own, ("dependencies", REPO): edges, ("files", REPO): of_repo("files"), ("routes", REPO): of_repo("routes"), ("vec_symbols", REPO): of_repo("vec_symbols"),
        ("memories", ""): view(spark, sf, "memories"), ("fts_postings", REPO): fulltext.postings(texts, stemmed=True), ("fts_lengths", REPO): fulltext.lengths(texts),
    })
    return Service(spark, store, root, REPO)


@query("SELECT 'files' AS name, count(*)::BIGINT AS n FROM fil WHERE repo_name = $REPO UNION ALL SELECT 'symbols', count(*) FROM sym WHERE repo_name = $REPO UNION ALL SELECT 'vec_symbols', count(*) FROM vec WHERE repo_name = $REPO UNION ALL SELECT 'routes', count(*) FROM rou WHERE repo_name = $REPO UNION ALL SELECT 'memories', count(*) FROM mem UNION ALL SELECT 'bound', count(*) FROM mem WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT id FROM sym WHERE repo_name = $REPO)")
def stored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a store's parts as they were at first, read after a second commit dropped the repository from it.

    A reader keeps the state it began with; `bound` counts the notes that still have a symbol afterwards.
    """
    store = _filled(spark, sf).store
    before = {name: store.read(name, REPO) for name in ("files", "symbols", "vec_symbols", "routes")} | {"memories": store.read("memories")}
    forget(store, REPO)
    counts = [rows.select(F.lit(name).alias("name")) for name, rows in before.items()] + [store.read("memories").where("symbol_id is not null").select(F.lit("bound").alias("name"))]
    assert not store.exists("symbols", REPO)
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# the tools

_OWN = "SELECT * FROM sym WHERE repo_name = $REPO"
_EDGES = "SELECT d.caller_id, d.callee_id, d.kind FROM dep d WHERE d.caller_id IN (SELECT id FROM own)"
_NAMED = "SELECT n.name AS input, (SELECT id FROM own WHERE own.name = n.name ORDER BY id LIMIT 1) AS id FROM (SELECT DISTINCT name FROM own ORDER BY name LIMIT 20) n"


def _names(service: Service, most: int) -> list[str]:
    return [r.name for r in service.symbols.select("name").distinct().orderBy("name").limit(most).collect()]  # the parameter of a tool


@query("SELECT 'ok' AS status, count(*)::BIGINT AS symbols FROM own", own=_OWN)
def tool_ping(spark: SparkSession, sf: str) -> DataFrame:
    answer = _filled(spark, sf).ping()
    return spark.createDataFrame([(answer["status"], answer["symbols"])], "status string, symbols long")


@query(
    "SELECT input, id AS symbol_id, (SELECT count(*) FROM (SELECT node, min(depth) FROM walk w JOIN own o ON o.id = w.node WHERE w.root = n.id AND w.depth > 0 AND w.node <> n.id GROUP BY node))::BIGINT AS dependencies, (SELECT count(*) FROM mem WHERE mem.symbol_id = n.id)::BIGINT AS memories FROM named n",
    own=_OWN, edges=_EDGES, named=_NAMED, walk="SELECT id AS root, id AS node, 0 AS depth FROM named UNION SELECT w.root, e.callee_id, w.depth + 1 FROM walk w JOIN edges e ON e.caller_id = w.node WHERE w.depth < 2",
)
def tool_code_of_a_batch(spark: SparkSession, sf: str) -> DataFrame:
    """get_code_by_symbol for twenty names at once: the symbol, how many it depends on in two steps, its notes."""
    service = _filled(spark, sf)
    answer = service.get_code_by_symbol(_names(service, 20), depth=2)
    found = [(i["input"], i["data"]["symbol"]["id"], len(i["data"]["dependencies"]), len(i["data"]["memories"])) for i in answer["results"]]
    return spark.createDataFrame(found, "input string, symbol_id long, dependencies long, memories long")


@query("SELECT file_path, id AS symbol_id, split_part(code_block, chr(10), 1) AS signature FROM own WHERE file_path IN (SELECT DISTINCT file_path FROM own ORDER BY file_path LIMIT 10)", own=_OWN)
def tool_skeleton_of_a_batch(spark: SparkSession, sf: str) -> DataFrame:
    """get_file_skeleton for ten files at once."""
    root = os.path.join(tree(spark, sf), REPO)
    service = _filled(spark, sf, root)
    paths = [r.file_path for r in service.symbols.select("file_path").distinct().orderBy("file_path").limit(10).collect()]  # the parameter of the tool
    answer = service.get_file_skeleton(paths)
    found = [(i["input"], s["symbol_id"], s["signature"]) for i in answer["results"] if "data" in i for s in i["data"]["symbols"]]
    return spark.createDataFrame(found, "file_path string, symbol_id long, signature string")


@query(
    "SELECT depth::INTEGER AS depth, count(*)::BIGINT AS affected FROM (SELECT w.node, min(w.depth) AS depth FROM walk w JOIN own o ON o.id = w.node WHERE w.node <> (SELECT id FROM target) GROUP BY w.node) GROUP BY depth", own=_OWN, edges=_EDGES,
    hub="SELECT o.name FROM edges e JOIN own o ON o.id = e.callee_id GROUP BY o.name, o.id ORDER BY count(*) DESC, o.id LIMIT 1", target="SELECT min(o.id) AS id FROM own o JOIN hub ON o.name = hub.name",
    walk="SELECT id AS node, 0 AS depth FROM target UNION SELECT e.caller_id, w.depth + 1 FROM walk w JOIN edges e ON e.callee_id = w.node WHERE w.depth < 2",
)
def tool_blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    """get_blast_radius of the symbol with the most callers: the counts, which are of all callers however many are listed."""
    service = _filled(spark, sf)
    named = service.symbols.select(F.col("id").alias("callee_id"), "name")
    hub = service.edges.join(named, "callee_id").groupBy("name", "callee_id").count().orderBy(F.desc("count"), "callee_id").limit(1).collect()
    answer = service.get_blast_radius(hub[0].name if hub else "", depth=2, cap=1)
    return spark.createDataFrame(list(answer.get("by_depth", {}).items()), "depth int, affected long")


@query(
    "SELECT row_number() OVER (ORDER BY file_path)::INTEGER - 1 AS position, title, content FROM (SELECT '' AS file_path, '' AS title, 'Rules' AS content UNION ALL SELECT file_path, file_path, n || ' symbols' FROM (SELECT file_path, count(*) AS n FROM own GROUP BY file_path))",
    own=_OWN,
)
def tool_rules(spark: SparkSession, sf: str) -> DataFrame:
    """read_architecture_rules of a document with a section for each file of the repository."""
    root = mounted(spark, scratch(spark, "rules"))
    service = _filled(spark, sf, root)
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "ARCHITECTURE.md"), "w", encoding="utf-8") as f:
        f.write("Rules\n")
        for r in service.symbols.groupBy("file_path").count().orderBy("file_path").collect():  # the document of the fixture
            f.write(f"## {r.file_path}\n\n{r['count']} symbols\n")
    answer = service.read_architecture_rules()
    assert "error" in service.read_architecture_rules("../" + os.path.basename(root) + "/ARCHITECTURE.md/..") and "error" in service.read_architecture_rules("/etc/hostname")
    return spark.createDataFrame([(i, s["title"], s["content"]) for i, s in enumerate(answer["sections"])], "position int, title string, content string")


_GATES = [(), ("ping",), ("purge_stale_memories", "find_dead_code"), ("nothing",)]


@query(
    "SELECT t.tool, g.gate, CASE g.gate WHEN '' THEN true WHEN 'ping' THEN t.tool = 'ping' WHEN 'nothing' THEN false ELSE t.tool = 'find_dead_code' OR t.tool LIKE '%\\_memor%' ESCAPE '\\' END AS enabled FROM (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in TOOLS) + "]) AS tool) t, (SELECT unnest(['', 'ping', 'purge_stale_memories,find_dead_code', 'nothing']) AS gate) g"
)
def tool_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Which tools each list of allowed ones lets through; any tool of the notes stands for all three."""
    assert all("memor" in t for t in MEMORY_TOOLS)
    return spark.createDataFrame([(t, ",".join(g), enabled(t, g)) for t in TOOLS for g in _GATES], "tool string, gate string, enabled boolean")


@query("SELECT greatest(max(id), 0) + 1 AS memory_id, (SELECT count(*) + 1 FROM mem)::BIGINT AS notes, 1::BIGINT AS \"own\" FROM mem")
def tool_save_memory(spark: SparkSession, sf: str) -> DataFrame:
    """save_symbol_memory, twice: the second is refused. The stored notes are not written again, one is appended."""
    service = _filled(spark, sf)
    name = _names(service, 1)[0]
    first, second = service.save_symbol_memory(name, "kept"), service.save_symbol_memory(name, "kept")
    assert "already" in second["error"]
    return spark.createDataFrame([(first["memory_id"], service.store.read("memories").count(), service.store.read("memories", REPO).count())], "memory_id long, notes long, own long")
