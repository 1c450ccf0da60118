"""The index over a real tree, notes across re-indexing, the service's tools, and the stream of changes."""

import json
import os
import subprocess
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import embedders
from quarry.index_job import forget, index
from quarry.operators import memories
from quarry.service import MAX_ROWS, TOOLS, Service, enabled
from quarry.store import Store
from quarry.streaming import watch

from . import tiny_onnx

MAIN = "package main\n\nfunc main() {\n\tgreet()\n}\n"
GREET = "package main\n\nfunc greet() {\n\tprint(1)\n}\n\nfunc unused() {\n}\n"
CALC = "export class Calc {\n  times(a: number) {\n    return helper(a);\n  }\n}\nexport function helper(a: number) {\n  return a;\n}\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for name, text in {"main.go": MAIN, "greet.go": GREET, "calc.ts": CALC, "ARCHITECTURE.md": "top\n## Rule\nbe kind\n"}.items():
        (root / name).write_text(text)
    return root


def by_name(store):
    return {r.qualified_name: r for r in store.read("symbols").collect()}


def test_index_lifecycle(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = index(spark, str(tree), "demo", store)
    assert (first.scanned, first.new, first.changed, first.deleted, first.symbols) == (3, 3, 0, 0, 6)
    before = by_name(store)
    assert set(before) == {"main", "greet", "unused", "Calc", "Calc.times", "helper"}
    pairs = {(r.caller_id, r.callee_id) for r in store.read("dependencies").collect()}
    assert (before["main"].id, before["greet"].id) in pairs and (before["Calc"].id, before["helper"].id) in pairs
    assert store.read("vec_symbols").count() == 6 and store.read("files").count() == 3

    again = index(spark, str(tree), "demo", store)
    assert (again.unchanged, again.symbols) == (3, 0)

    new = spark.createDataFrame([(before["greet"].id, "says hello", "agent"), (before["Calc.times"].id, "slow", "developer")], "symbol_id long, note string, author string")
    store.write("memories", memories.save(store.read("memories"), new, datetime(2024, 1, 1)))
    (tree / "greet.go").write_text(GREET.replace("print(1)", "print(2)"))
    os.unlink(tree / "calc.ts")
    third = index(spark, str(tree), "demo", store)
    assert (third.changed, third.deleted, third.unchanged, third.memories_staled, third.memories_relinked) == (1, 1, 1, 2, 1)
    notes = {r.note: r for r in store.read("memories").collect()}
    assert notes["says hello"].symbol_id == before["greet"].id and not notes["says hello"].is_stale
    assert notes["slow"].symbol_id is None and notes["slow"].stale_reason == "symbol_deleted" and notes["slow"].last_known_symbol == "Calc.times"
    after = by_name(store)
    assert set(after) == {"main", "greet", "unused"} and after["greet"].id == before["greet"].id
    assert store.read("vec_symbols").count() == 3
    assert {(r.caller_id, r.callee_id) for r in store.read("dependencies").collect()} == {(before["main"].id, before["greet"].id)}

    other = tree.parent / "other"
    other.mkdir()
    (other / "main.go").write_text(MAIN)
    index(spark, str(other), "second", store)
    assert store.read("symbols").groupBy("repo_name").count().count() == 2
    assert index(spark, str(tree), "demo", store, force=True).changed == 2


def test_service(spark, tree, tmp_path):
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("add", "-A")
    git("commit", "-qm", "x")
    s = Service(spark, Store(spark, str(tmp_path / "store")), str(tree), "demo")
    assert s.reindex_project()["new"] == 3
    assert s.ping()["symbols"] == 6
    assert s.read_architecture_rules()["sections"] == [{"title": "", "content": "top"}, {"title": "Rule", "content": "be kind"}]

    code = s.get_code_by_symbol(["main", "nobody", " "], depth=9)
    assert (code["success_count"], code["error_count"]) == (1, 2)
    assert [d["name"] for d in code["results"][0]["data"]["dependencies"]] == ["greet"]
    assert s.get_code_by_symbol([])["results"] == [] and "error" in s.get_code_by_symbol(None)

    assert [u["qualified_name"] for u in s.get_symbol_usages("greet")["usages"]] == ["main"]
    assert s.get_call_tree("main", depth=0)["edge_count"] == 0 and s.get_call_tree("main")["edge_count"] == 1
    assert "direction" in s.get_call_tree("main", "up")["error"]
    assert s.get_blast_radius("greet", 0)["by_depth"] == {1: 1}
    assert {d["name"] for d in s.find_dead_code()["dead_symbols"]} == {"unused", "times"}
    assert "error" in s.find_dead_code(file_path="none.go")
    skeleton = s.get_file_skeleton(["greet.go", "", "../x", "ARCHITECTURE.md"])
    assert (skeleton["success_count"], skeleton["error_count"]) == (1, 3)
    assert skeleton["results"][0]["data"]["symbols"][0]["signature"] == "func greet() {"
    found = s.search_code_patterns(r"print\(\d\)")
    assert found["result_count"] == 1 and found["results"][0]["match_text"] == "print(1)"
    assert "invalid" in s.search_code_patterns("(")["error"]
    search = s.semantic_search_symbols("greet", top_k=99, min_similarity=0)
    assert any(r["name"] == "greet" and r["source"] in ("fts", "both") for r in search["results"])
    assert "error" in s.semantic_search_symbols("  ")
    assert s.find_http_routes()["route_count"] == 0
    assert s.get_tests_for_symbol("greet")["test_count"] == 0

    assert s.save_symbol_memory("greet", "hello")["symbol"] == "greet"
    assert "already" in s.save_symbol_memory("greet", "hello")["error"]
    assert "longer" in s.save_symbol_memory("greet", "x" * 2001)["error"]
    assert s.get_symbol_memories("gre")["count"] == 1 and s.get_symbol_memories(file_path="greet.go")["count"] == 1
    assert "error" in s.get_symbol_memories()
    assert s.purge_stale_memories()["purged"] == 0

    (tree / "greet.go").write_text(GREET.replace("print(1)", "print(3)"))
    changed = s.get_modified_symbols()
    assert [(c["qualified_name"], c["changed_lines"], c["change_type"]) for c in changed["symbols"]] == [("greet", [4], "modified")]
    assert s.session_saved >= 0 and len(TOOLS) == 17


def test_service_batches_and_bounds(spark, tree, tmp_path, monkeypatch):
    (tree / "many.go").write_text("package main\n\n" + "".join(f"func user{i:03}() {{\n\tgreet()\n}}\n\n" for i in range(130)))
    s = Service(spark, Store(spark, str(tmp_path / "store")), str(tree), "demo")
    assert s.reindex_project()["errors"] == 0
    blast = s.get_blast_radius("greet", 1)
    # edges belong to the first symbol of a file
    assert blast["by_depth"] == {1: 2} and not blast["truncated"] and s.get_blast_radius("greet", 1, cap=1)["truncated"]
    batch = s.get_code_by_symbol([f"user{i:03}" for i in range(50)], depth=1)
    assert batch["success_count"] == 50 and [i["input"] for i in batch["results"]] == [f"user{i:03}" for i in range(50)]
    assert [d["name"] for d in batch["results"][0]["data"]["dependencies"]] == ["greet"] and "truncated" not in batch
    assert "error" in s.get_code_by_symbol(["x"] * 51)
    monkeypatch.setattr("quarry.service.MAX_ROWS", 1)
    assert len(s._rows(s.symbols, 1)) == 2
    usages = s.get_symbol_usages("greet")
    assert usages["usage_count"] == 2
    for bad in ("../tree/ARCHITECTURE.md/../../x", "/etc/hostname", "../secret.md"):
        (tmp_path / "secret.md").write_text("## no")
        assert "does not exist" in s.read_architecture_rules(bad)["error"]
    for pattern in (r"(?P<n>greet)\(", r"(e)\1"):
        assert s.search_code_patterns(pattern)["result_count"] > 0


def test_rules_of_more_sections_than_a_list_holds(spark, tree, tmp_path):
    (tree / "ARCHITECTURE.md").write_text("top\n" + "".join(f"## file {i}\n\n{i} symbols\n" for i in range(MAX_ROWS + 5)))
    answer = Service(spark, Store(spark, str(tmp_path / "store")), str(tree), "demo").read_architecture_rules()
    assert answer["sections"] == [{"title": "", "content": "top"}, *({"title": f"file {i}", "content": f"{i} symbols"} for i in range(MAX_ROWS + 5))]


def _folder(path, words, matrix):
    path.mkdir()
    body = matrix.astype("<f4").tobytes()
    head = json.dumps({"embeddings": {"dtype": "F32", "shape": list(matrix.shape), "data_offsets": [0, len(body)]}}).encode()
    (path / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + body)
    (path / "vocab.txt").write_text("\n".join(words))
    (path / "model.onnx").write_bytes(tiny_onnx.model(matrix))
    return path


def test_one_embedder_for_index_and_search(spark, tree, tmp_path):
    """With a static model the nearest symbol is the one that means the query; its vectors are no others'."""
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "greet", "helper", "unused", "calc", "times"]
    matrix = np.zeros((9, 5), np.float32)
    matrix[4:, :] = np.eye(5)
    folder = _folder(tmp_path / "model", words, matrix)
    for kind in ("static", "onnx"):
        store = Store(spark, str(tmp_path / kind))
        s = Service(spark, store, str(tree), "demo", embedder=f"{kind}:{folder}")
        stats = s.reindex_project()
        assert stats["vectors"] == stats["symbols"] == 6
        found = s.semantic_search_symbols("helper", top_k=1, min_similarity=0.2)["results"]
        assert [(r["name"], r["source"]) for r in found] == [("helper", "both")]
        assert {len(r.embedding) for r in store.read("vec_symbols").collect()} == {5}
        other = Service(spark, store, str(tree), "demo")
        assert "index the project" in other.semantic_search_symbols("helper")["error"]
        assert other.reindex_project()["vectors"] == 6  # no file changed, but all vectors are made anew
        assert {len(r.embedding) for r in store.read("vec_symbols").collect()} == {128} and "results" in other.semantic_search_symbols("helper")
    for bad in ("static:/none", "what"):
        with pytest.raises((OSError, ValueError)):
            embedders.load_embedder(bad)


def test_vector_cache_is_read_again_after_a_change(spark, tree, tmp_path):
    s = Service(spark, Store(spark, str(tmp_path / "store")), str(tree), "demo")
    s.reindex_project()
    s.semantic_search_symbols("greet", min_similarity=0)
    first = s.cache._held["demo"]
    s.semantic_search_symbols("main", min_similarity=0)
    assert s.cache._held["demo"] is first
    (tree / "greet.go").write_text(GREET + "\nfunc added() {\n}\n")
    index(spark, str(tree), "demo", s.store)  # by another process, as it were
    assert any(r["name"] == "added" for r in s.semantic_search_symbols("added", min_similarity=0)["results"])
    assert s.cache._held["demo"][0] != first[0]


def test_store_commits_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    edges = lambda n: spark.createDataFrame([(i, i, "call") for i in range(n)], "caller_id long, callee_id long, kind string")
    store.commit({("dependencies", "a"): edges(3), ("dependencies", "b"): edges(2)}, {"k": [1]})
    old = store.read("dependencies")
    store.append("dependencies", edges(1), "a")
    assert store.read("dependencies", "a").count() == 4 and store.read("dependencies").count() == 6 and store.meta("k") == [1]
    store.commit({("dependencies", "a"): None})
    assert store.parts("dependencies") == ["b"] and old.count() == 5  # a reader keeps what it began with
    broken = tmp_path / "s" / "_manifest" / "000000000099.json"
    broken.write_text('{"schema": 2, "tab')  # a writer died here
    assert store.read("dependencies").count() == 2
    store.write("dependencies", edges(7), "b")
    assert store.read("dependencies").count() == 7 and (tmp_path / "s" / "_manifest" / "000000000100.json").exists()
    with pytest.raises(Exception):
        store._put({}, 100)  # the number is taken
    assert store.vacuum() == 0 and store.vacuum(grace_s=-1) >= 3 and store.read("dependencies").count() == 7
    for _ in range(18):
        store.append("dependencies", edges(1), "c")
    assert store.read("dependencies", "c").count() == 18 and len(store.version("dependencies", "c").split(",")) <= 16
    newer = Store(spark, str(tmp_path / "new"))
    newer._put({"schema": 99, "tables": {}, "meta": {}}, 1)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "new"))


def test_store_of_the_first_layout(spark, tmp_path):
    root = tmp_path / "old"
    rows = {"symbols": [(1, "r", "a"), (2, "q", "b")], "dependencies": [(1, 1, "call"), (2, 2, "call"), (9, 9, "call")], "memories": [(5, 1, "n")]}
    from quarry.schema import TABLES
    for name, some in rows.items():
        schema = TABLES[name]
        spark.createDataFrame([(*r, *[None] * (len(schema) - len(r))) for r in some], schema).write.parquet(str(root / name / "v-1"))
        (root / name / "_current").write_text("v-1")
    store = Store(spark, str(root))
    assert store.parts("symbols") == ["q", "r"] and store.read("dependencies", "r").first().caller_id == 1 and store.read("memories", "").count() == 1
    assert Store(spark, str(root)).read("symbols").count() == 2


def test_watcher_feeds_the_index(spark, tree, tmp_path):
    s = Service(spark, Store(spark, str(tmp_path / "store")), str(tree), "demo")
    s.reindex_project()
    watcher = watch.TreeWatcher(spark, str(tree))
    assert watcher.poll() == 0
    (tree / "new.go").write_text("package main\n\nfunc fresh() {\n\tgreet()\n}\n")
    os.unlink(tree / "calc.ts")
    (tree / "notes.md").write_text("no source")
    assert watcher.run(s.flush, polls=3, every_s=0) == 1
    assert set(by_name(s.store)) == {"main", "greet", "unused", "fresh"}
    assert {r.path for r in s.store.read("files").collect()} == {"main.go", "greet.go", "new.go"}
    names = {r.id: r.name for r in s.store.read("symbols").collect()}
    assert ("fresh", "greet") in {(names[e.caller_id], names[e.callee_id]) for e in s.store.read("dependencies").collect()}
    assert watcher.run(s.flush, polls=2, every_s=0) == 0


def test_full_text_follows_the_files(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index(spark, str(tree), "demo", store)
    terms = lambda: {r.term for r in store.read("fts_postings").collect()}
    assert {"calc", "helper", "greet"} <= terms()
    os.unlink(tree / "calc.ts")
    index(spark, str(tree), "demo", store)
    assert not {"calc", "helper"} & terms() and store.read("fts_lengths").count() == 3
    forget(store, "demo")
    assert store.read("fts_postings").count() == store.read("symbols").count() == 0


def test_served_lines(spark, tree, tmp_path):
    from quarry.__main__ import answer, serve

    service = Service(spark, Store(spark, str(tmp_path / "s")), str(tree), "demo")
    lines = ['{"id": 1, "tool": "ping"}', "", "not json", '{"id": 2, "tool": "none"}', '{"id": 3, "tool": "ping", "arguments": {"x": 1}}', "[]"]
    got = [json.loads(x) for x in serve(service, lines)]
    assert got[0]["id"] == 1 and got[0]["result"]["status"] == "ok" and len(got) == 5
    assert "bad request" in got[1]["error"] and "unknown" in got[2]["result"]["error"] and "error" in got[3]["result"] and "bad request" in got[4]["error"]
    assert answer(service, "__init__", {}) == {"error": "unknown tool '__init__'"}


def test_tool_gating(spark, tree, tmp_path):
    assert enabled("ping") and enabled("purge_stale_memories", ("save_symbol_memory",)) and not enabled("ping", ("x",))
    assert "not enabled" in Service(spark, Store(spark, str(tmp_path / "s")), str(tree), "r", ("ping",)).find_dead_code()["error"]


def test_relevant(spark):
    rows = [("a.go", "write", True), ("A.GO", "create", True), ("a.go", "chmod", False), ("a.go", "rename", False), ("dir", "create", False), ("bin/a.go", "write", False), ("x/a.md", "write", False), ("a.py", "remove", True)]
    df = spark.createDataFrame(rows, "path string, op string, want boolean")
    assert df.where(watch.relevant(F.col("path"), F.col("op")) != F.col("want")).count() == 0


def test_debounce(spark):
    t = datetime(2024, 1, 1)
    ms = lambda n: t + timedelta(milliseconds=n)
    df = spark.createDataFrame([("a", ms(0)), ("b", ms(50)), ("a", ms(100)), ("c", ms(800))], "path string, ts timestamp")
    got = watch.debounce(df, "200 milliseconds").orderBy("first_event").collect()
    assert [(r.events, r.paths, r.flush_at) for r in got] == [(3, 2, ms(300)), (1, 1, ms(1000))]
    assert watch.pending(df, "1 second").count() == 3 and watch.debounce(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    src = str(tmp_path / "events")
    df = spark.createDataFrame([(f"p{i % 5}", t + timedelta(seconds=i if i < 50 else i + 3600)) for i in range(100)], "path string, ts timestamp")
    df.write.parquet(src)
    for name, f in (("bursts", lambda d: watch.debounce(d, "10 seconds", "1 minute").drop("paths")), ("pending", lambda d: watch.pending(d, "1 hour", "1 minute"))):
        out, mark = str(tmp_path / name), str(tmp_path / f"{name}-c")
        run = f(watch.read_events(spark, src, df.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        batch = {tuple(r) for r in f(df).collect()}
        streamed = {tuple(r) for r in spark.read.parquet(out).collect()} if name == "pending" else {tuple(r) for r in spark.read.schema("first_event timestamp, flush_at timestamp, events long").parquet(out).collect()}
        assert streamed <= batch and (name == "bursts" or streamed == batch)


def test_flush_skips_empty_batches(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([("a.go",), ("a.go",), ("b.go",)], "path string").write.parquet(src)
    seen = []
    events = watch.read_events(spark, src, spark.read.parquet(src).schema)
    watch.on_flush(events, lambda paths, n: seen.append(sorted(r.path for r in paths.collect())), str(tmp_path / "c"), once=True).awaitTermination()
    watch.on_flush(events.where("path = 'none'"), lambda paths, n: seen.append("empty"), str(tmp_path / "d"), once=True).awaitTermination()
    assert seen == [["a.go", "b.go"]]
