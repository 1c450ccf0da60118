"""Semantics that the tables of the checks do not reach: caps, cycles, ties, nulls, empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import bloom, diff, fulltext, graph, lookup, memories, mutations, orphans, routes, running, search
from quarry.schema import DEPENDENCIES, MEMORIES, ROUTES, SYMBOLS

T0 = datetime(2024, 1, 1)


def syms(spark, *rows):
    """(id, name[, path[, kind[, line[, code[, qualified]]]]])"""
    full = []
    for r in rows:
        i, name, path, kind, line, code, q = (*r, *[None] * 7)[:7]
        full.append((i, "r", name, q or name, kind or "function", path or "a.go", "h", code or "", line or i, (line or i) + 4, "go", T0))
    return spark.createDataFrame(full, SYMBOLS)


def edges(spark, *pairs):
    return spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else "call") for p in pairs], DEPENDENCIES)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@pytest.mark.parametrize("depth, nodes", [(0, set()), (1, {2, 3}), (2, {2, 3, 4}), (3, {2, 3, 4, 5}), (9, {2, 3, 4, 5}), (-1, set())])
def test_bfs_depths(spark, depth, nodes):
    e = edges(spark, (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 1), (1, 1), (1, 2, "extends"))
    rows = graph.bfs(e, ids(spark, 1), depth).collect()
    assert {r.node for r in rows} == nodes and len(rows) == len(nodes)
    assert all(r.kind == "call" for r in rows)


def test_bfs_reverse_and_bad_direction(spark):
    e = edges(spark, (1, 2), (2, 3))
    assert {(r.node, r.depth) for r in graph.bfs(e, ids(spark, 3), 3, "callers").collect()} == {(2, 1), (1, 2)}
    with pytest.raises(ValueError):
        graph.bfs(e, ids(spark, 3), 1, "sideways")


def test_call_tree_cap_and_blast(spark):
    e = edges(spark, *[(0, i) for i in range(1, 151)])
    s = syms(spark, *[(i, f"f{i}", f"p{i % 2}.go") for i in range(151)])
    assert graph.call_tree(e, s, ids(spark, 0)).count() == 100
    many = edges(spark, *[(i, 0) for i in range(1, 151)])
    assert graph.blast_radius(many, s, ids(spark, 0)).count() == 150 and graph.blast_radius(many, s, ids(spark, 0), cap=100).count() == 100
    chain = edges(spark, *[(i, i + 1) for i in range(9)])
    assert {r.node for r in graph.bfs(chain, ids(spark, 0), 9, deepest=6).collect()} == set(range(1, 7))
    assert {(r.root, r.node, r.depth) for r in graph.bfs_many(chain, ids(spark, 0, 3), 2).collect()} == {(0, 1, 1), (0, 2, 2), (3, 4, 1), (3, 5, 2)}
    back = edges(spark, (1, 9), (2, 9), (3, 9))
    hit = graph.blast_radius(back, syms(spark, (1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (9, "t", "z")), ids(spark, 9), 0)
    assert {(r.file_path, r.affected) for r in graph.blast_by_file(hit).collect()} == {("x", 2), ("y", 1)}
    assert [(r.depth, r.affected) for r in graph.blast_by_depth(hit).collect()] == [(1, 3)]


def test_usages(spark):
    e = edges(spark, (1, 9), (1, 9, "extends"), (99999, 9))
    assert graph.usages(e, syms(spark, (1, "a"), (9, "t")), "r", ids(spark, 9)).count() == 2


def test_dead_code(spark):
    s = syms(spark, (1, "main"), (2, "used"), (3, "orphan"), (4, "Exported"), (5, "loop"), (6, "v", "a.go", "variable"), (7, "Äbc"))
    e = edges(spark, (1, 2), (5, 5))
    assert {r.name for r in graph.dead_code(e, s, "r").collect()} == {"orphan", "Äbc"}
    assert {r.name for r in graph.dead_code(e, s, "r", exclude_exported=False).collect()} == {"orphan", "Exported", "Äbc"}
    assert graph.dead_code(e, s, "other").count() == 0
    many = syms(spark, *[(i, f"f{i}") for i in range(300)])
    assert [graph.dead_code(e, many, "r", limit=n).count() for n in (0, 500, None)] == [50, 200, 298]


def test_tests_for_symbol(spark):
    s = syms(spark, (1, "Run"), (2, "checks", "x_test.go"), (3, "TestRun", "b.go"), (4, "TestOther", "pkg/tests/c.go"), (5, "testRunner", "latest/x.go"))
    got = graph.tests_for_symbol(edges(spark, (2, 1), (3, 1)), s, "r", ids(spark, 1), "Job.Run")
    assert {(r.name, r.match_reason) for r in got.collect()} == {("checks", "dependency"), ("TestRun", "dependency")}
    got = graph.tests_for_symbol(edges(spark, (4, 4)), s, "r", ids(spark, 1), "Job.Run")
    assert {(r.name, r.match_reason) for r in got.collect()} == {("testRunner", "name_heuristic")}


def test_resolve_edges(spark):
    s = syms(spark, (1, "A", "f.go", None, 1), (2, "B", "f.go", None, 10), (3, "C", "g.go", None, 1), (4, "C", "h.go", None, 1))
    raw = spark.createDataFrame([("f.go", "call", "C", 11), ("f.go", "call", "C", 12), ("f.go", "call", "nobody", 1)], "file_path string, kind string, symbol string, line int")
    assert [tuple(r) for r in graph.resolve_edges(raw, s, "r").collect()] == [(1, 4, "call")]
    assert [tuple(r) for r in graph.resolve_edges(raw, s, "r", "enclosing").collect()] == [(2, 4, "call")]


def test_search_ranks_and_wildcards(spark):
    s = syms(spark, (1, "xload"), (2, "Load"), (3, "loader"), (4, "z", "a", None, 1, "", "load"), (5, "load"), (6, "l0ad"))
    assert [(r.id, r.match_rank) for r in search.fuzzy(s, "r", "load").collect()] == [(5, 0), (4, 1), (2, 2), (3, 2), (1, 3)]
    assert search.fuzzy(s, "r", "l_ad").count() == 6
    assert search.resolve(s, "r", "load").first().id == 5 and search.resolve(s, "r", "xl").first().id == 1
    assert search.resolve(s, "r", "nothing").count() == 0


def test_resolve_many_names(spark):
    s = syms(spark, *[(i, f"name{i:03}") for i in range(1, 121)], (121, "z", "a", None, 1, "", "q.z"), (122, "Late"))
    asked = [f"name{i:03}" for i in range(1, 121)] + ["q.z", "late", "E1", "nothing", None, "late", "ame_01", "q%z"]
    got = search.resolve_many(s, "r", spark.createDataFrame([(n,) for n in asked], "input string")).collect()
    want = [(n, int(n[4:])) for n in asked[:120]] + [("q.z", 121), ("late", 122), ("E1", 100), ("nothing", None), (None, None), ("late", 122), ("ame_01", 1), ("q%z", 121)]
    assert search.resolve(s, "r", "ame_01").first().id == 1
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_patterns(spark):
    s = syms(spark, (1, "a", "p/a", None, 1, "x" * 30 + "ä😀 foo(1) tail"), (2, "b", "p/b", None, 1, "bar(2)"), (3, "c", "q/c", None, 1, None))
    r = search.search_patterns(s, "r", r"foo\(\d\)").first()
    assert (r.match_text, r.match_start, r.match_end) == ("foo(1)", 37, 43) and r.snippet.endswith("ä😀 foo(1) tail")
    assert search.search_patterns(s, "r", "foo|bar").count() == 2
    assert search.search_patterns(s, "r", "foo|bar", compatible=True).count() == 2  # no word of an alternation is required
    assert search.search_patterns(s, "r", "foo|bar", prefix="P/b").count() == 1
    assert search.search_patterns(s, "r", "foo", limit=0).count() == 0
    assert search.search_patterns(s, "r", "foo", limit=None).count() == 1
    t = syms(spark, (1, "a", "p/a", None, 1, "x aa yy"), (2, "b", "p/b", None, 1, "foo.foo bar.foo"))
    twice = search.search_patterns(t, "r", r"(a)\1").first()
    assert (twice.match_text, twice.match_start, twice.match_end, twice.snippet) == ("aa", 2, 4, "x aa yy")
    named = search.search_patterns(t, "r", r"(?P<word>[[:alpha:]]+)\.(?P=word)\b").first()
    assert (named.id, named.match_text, named.match_start) == (2, "foo.foo", 0)
    empty = search.search_patterns(t, "r", "z*").first()
    assert (empty.match_text, empty.match_start, empty.match_end) == ("", 0, 0)
    for bad in ("(", "(?P=x)", "[[:none:]]", "a{2,1}"):
        with pytest.raises(ValueError):
            search.search_patterns(t, "r", bad)
    long = search.search_patterns(syms(spark, (1, "a", "p", None, 1, "y" * 500)), "r", "y+").first()
    assert long.snippet == "y" * 200 + "..."


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "r", "f", 0, "open_file handle"), (2, "r", "f", 0, "file open"), (3, "q", "f", 0, "open file"), (4, "r", "f", 0, None)], "symbol_id long, repo_name string, file_path string, column int, text string")
    assert [r.symbol_id for r in search.fts_search(docs, "r", "Open File").collect()] == [1]
    assert search.fts_search(docs, "r", "??").count() == 0
    assert [r.symbol_id for r in search.fts_search(docs, "r", "files opening", stemmed=True).collect()] == [2]
    again = spark.createDataFrame([(5, "r", "f", 0, "a b a b a"), (5, "r", "f", 1, "b a")], docs.schema)
    index, sizes = fulltext.postings(again), fulltext.lengths(again)
    assert sizes.first().length == 7 and fulltext.search(index, sizes, None, "a b a").count() == 1 and fulltext.search(index, sizes, None, "b b").count() == 0
    assert fulltext.search(index.limit(0), sizes.limit(0), None, "a").count() == 0
    ranks = search.fts_search(docs, "r", "open").collect()
    assert [r.symbol_id for r in ranks] == [2, 1] and all(r["rank"] < 0 for r in ranks)


def test_knn(spark):
    v = spark.createDataFrame([(1, "r", [1.0, 0.0]), (2, "r", [0.0, 1.0]), (3, "q", [1.0, 0.0]), (4, "r", [1.0]), (5, "r", None), (6, "r", [float("nan"), 1.0])], "symbol_id long, repo_name string, embedding array<float>")
    assert [(r.symbol_id, r.similarity) for r in search.knn(v, [1.0, 0.0], 10, 0.0, "r").collect()] == [(1, 1.0), (2, 0.0), (4, 0.0), (5, 0.0)]
    assert search.knn(v, [1.0, 0.0], 2).count() == 2 and search.knn(v, [1.0, 0.0], 0, 0.5).count() == 2


def test_rrf(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "symbol_id long, similarity double")
    t = spark.createDataFrame([(2, -5.0), (3, -1.0)], "symbol_id long, rank double")
    got = search.rrf(v, t).collect()
    assert [(r.symbol_id, r.source) for r in got] == [(2, "both"), (1, "vector"), (3, "fts")]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[2].similarity == 0


def test_rrf_of_every_search(spark):
    """Three searches, one with nearly all hits, so it spans many parts; equal scores; a search of one list only."""
    v = [(1, i, (i * 7 % 40) / 40) for i in range(400)] + [(2, i, 0.5) for i in range(5)]
    t = [(1, i, -float(i * 11 % 50)) for i in range(200, 600)] + [(3, i, -1.0) for i in range(4)]
    want, places = {}, {}
    for q in (1, 2, 3):
        rv = {s: n for n, (_, s, _) in enumerate(sorted((r for r in v if r[0] == q), key=lambda r: (-r[2], r[1])), 1)}
        rt = {s: n for n, (_, s, _) in enumerate(sorted((r for r in t if r[0] == q), key=lambda r: (r[2], r[1])), 1)}
        own = {s: sum(1 / (60 + x[s]) for x in (rv, rt) if s in x) for s in rv.keys() | rt.keys()}
        want |= {(q, s): (round(x, 9), "both" if s in rv and s in rt else "vector" if s in rv else "fts") for s, x in own.items()}
        places |= {(q, n): s for n, s in enumerate(sorted((s for s in own if s % 3), key=lambda s: (-round(own[s], 12), s))[:10], 1)}
    hits = spark.createDataFrame(v, "query_id long, symbol_id long, similarity double"), spark.createDataFrame(t, "query_id long, symbol_id long, rank double")
    rows = search.rrf_searches(*hits).collect()
    assert len(rows) == len(want) and {(r.query_id, r.symbol_id): (round(r.score, 9), r.source) for r in rows} == want
    s = syms(spark, *[(i, f"n{i}", "a.go", "function" if i % 3 else "class", 1) for i in range(600)])
    notes = spark.createDataFrame([(1, 1), (2, 1)], "id long, symbol_id long")
    shown = search.hybrid_searches(s, notes, *hits, kind="function").collect()
    assert {(r.query_id, r.place): r.symbol_id for r in shown} == places and len(shown) == len(places)
    assert {r.memories for r in shown if r.symbol_id == 1} == {2}


@pytest.mark.parametrize(
    "dm, dp, cm, cp, confidence",
    [("GET", "/a/b", "GET", "/a/b", 1.0), ("GET", "/a/:param", "GET", "/a/:param", 1.0), ("GET", "/a/:param", "GET", "/a/7", 0.9), ("GET", "/:param/b", "GET", "/a/:param", 0.9), ("GET", "/a", "GET", "/a/b", 0.5),
     ("GET", "/a/use", "GET", "/a/users", 0.5), ("GET", "/a/b", "POST", "/a/b", None), ("*", "/a/b", "POST", "/a/b", 1.0), ("GET", "/a/b", "GET", "/c", None), ("GET", "/:param", "GET", "/:other", 0.9), ("GET", None, "GET", "/a", None)],
)
def test_route_confidence(spark, dm, dp, cm, cp, confidence):
    rows = [(1, "r", dm, dp, dp, None, "f", 1, "x", "definition", T0), (2, "r", cm, cp, cp, None, "f", 1, "x", "call_site", T0), (3, "q", cm, cp, cp, None, "f", 1, "x", "call_site", T0)]
    got = routes.match(spark.createDataFrame(rows, ROUTES)).collect()
    assert [r.confidence for r in got] == ([] if confidence is None else [confidence])


def note(i, symbol, text="n", stale=False, reason=None, sym=None, path=None, at=1):
    return (i, symbol, text, "agent", stale, reason, sym, path, datetime(2024, 1, at), None)


def test_memory_life(spark):
    s = syms(spark, (1, "A", "f.go"), (2, "B", "g.go"))
    m = spark.createDataFrame([note(1, 1), note(2, 1, "old", True, "hash_changed", "x", "y"), note(3, 2), note(4, None, stale=True)], MEMORIES)
    gone = spark.createDataFrame([("r", "f.go")], "repo_name string, file_path string")
    after = {r.id: r for r in memories.snapshot_stale(m, s, gone, "symbol_deleted").collect()}
    assert (after[1].symbol_id, after[1].is_stale, after[1].stale_reason, after[1].last_known_symbol, after[1].last_known_file) == (None, True, "symbol_deleted", "A", "f.go")
    assert (after[2].symbol_id, after[2].stale_reason, after[2].last_known_symbol) == (None, "hash_changed", "x")
    assert after[3].symbol_id == 2 and not after[3].is_stale
    files = spark.createDataFrame([("r", "f.go")], "repo_name string, path string")
    back = {r.id: r for r in memories.relink(spark.createDataFrame(list(after.values()), MEMORIES), s, files).collect()}
    assert (back[1].symbol_id, back[1].is_stale, back[1].stale_reason) == (1, False, None)
    assert back[2].symbol_id is None and back[4].symbol_id is None


def test_stale_only_symbol_is_not_detached(spark):
    m = spark.createDataFrame([note(2, 1, "old", True, "hash_changed", "x", "y")], MEMORIES)
    gone = spark.createDataFrame([("r", "f.go")], "repo_name string, file_path string")
    assert memories.snapshot_stale(m, syms(spark, (1, "A", "f.go")), gone, "hash_changed").first().symbol_id == 1


def test_purge_and_pages(spark):
    s = syms(spark, (1, "A"))
    m = spark.createDataFrame([note(1, 1, stale=True, at=1), note(2, None, stale=True, at=2), note(3, 7, stale=True, at=3), note(4, 1, at=4), note(5, None, at=4)], MEMORIES)
    assert {r.id for r in memories.purge_stale(m, s, "r").collect()} == {3, 4, 5}
    assert {r.id for r in memories.purge_stale(m, s, "r", True).collect()} == {1, 3, 4, 5}
    assert [r.id for r in memories.paged(m, 1, 2).collect()] == [5, 3]
    assert memories.paged(m, -4, 500).count() == 5


def test_save(spark):
    m = spark.createDataFrame([note(7, 1, "same")], MEMORIES)
    new = spark.createDataFrame([(1, "same", "agent"), (1, "x" * 2000, "boss"), (1, "y" * 2001, "agent"), (1, "twice", None), (1, "twice", None), (None, "free", "developer"), (2, None, "agent")], "symbol_id long, note string, author string")
    after = memories.save(m, new, T0).where("id > 7").collect()
    assert sorted((r.note[0], r.author) for r in after) == [("f", "developer"), ("t", "agent"), ("x", "agent")]
    assert sorted(r.id for r in after) == [8, 9, 10]
    assert memories.save(m.limit(0), new, T0).agg(F.max("id")).first()[0] == 4


def test_mutations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {tuple(r) for r in mutations.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    e = edges(spark, (1, 2), (1, 2))
    assert mutations.add_edges(e, edges(spark, (1, 2), (1, 2, "extends"))).count() == 2


def test_diff(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "path string, content_hash string")
    db = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("n", None)], "path string, content_hash string")
    assert {tuple(r) for r in diff.incremental(disk, db).collect()} == {("a", "new"), ("b", "unchanged"), ("c", "changed"), ("d", "deleted"), ("n", "unchanged")}
    assert tuple(diff.index_stats(diff.incremental(disk, db, True)).first()) == (4, 1, 3, 0, 1)
    assert tuple(diff.index_stats(diff.incremental(disk.limit(0), db.limit(0))).first()) == (0, 0, 0, 0, 0)


def test_overlaps(spark):
    s = syms(spark, (1, "A", "f", None, 10), (2, "B", "f", None, 20))  # 10-14, 20-24
    h = spark.createDataFrame([("r", "f", 14, 1), ("r", "f", 15, 5), ("r", "f", 24, 9), ("r", "f", 12, 0), ("r", "g", 10, 9), ("q", "f", 10, 9), (None, "f", 10, 9)], "repo_name string, file_path string, start_line int, line_count int")
    assert sorted(map(tuple, diff.overlaps(s, h).collect())) == [(1, 14, 14), (2, 24, 24)]


def test_overlaps_over_many_bins(spark):
    """Long symbols and long hunks share many bins: each pair comes once."""
    s = spark.createDataFrame([(i, "r", "n", "n", "function", "f", "h", "", i * 37, i * 37 + 300, "go", T0) for i in range(40)], SYMBOLS)
    hunks = [("r", "f", k * 61, 200) for k in range(30)]
    got = sorted(map(tuple, diff.overlaps(s, spark.createDataFrame(hunks, "repo_name string, file_path string, start_line int, line_count int")).collect()))
    want = sorted((i, max(i * 37, a), min(i * 37 + 300, a + n - 1)) for i in range(40) for _, _, a, n in hunks if i * 37 <= a + n - 1 and i * 37 + 300 >= a)
    assert got == want


def test_running_sums_of_a_hot_group(spark):
    rows = [(g, i, float(i % 5)) for g, n in ((1, 400), (2, 7), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v double").repartition(5)
    got = {(r.g, r.i): (r.n, r.total) for r in running.running(running.row_numbers(df, ["g"], [F.desc("i")], "n"), ["g"], [F.col("i")], F.col("v"), "total").collect()}
    size = {1: 400, 2: 7, None: 3}
    assert got == {(g, i): (size[g] - i, float(sum(j % 5 for j in range(i + 1)))) for g, i, _ in rows}
    assert sorted(r.n for r in running.row_numbers(df, [], [F.col("v"), F.col("i")], "n").collect()) == list(range(1, 411))
    assert running.row_numbers(df.limit(0), ["g"], [F.col("i")], "n").count() == 0


def test_lookup(spark):
    s = syms(spark, (3, "x"), (1, "x"), (2, "y", "b.go"))
    assert lookup.symbol_by(s, "r", "name", "x").first().id == 1
    assert {tuple(r) for r in lookup.name_index(s, "r").collect()} == {("x", 3), ("y", 2)}
    twice = spark.createDataFrame([(1, "old", datetime(2024, 1, 1)), (1, "new", datetime(2024, 1, 2)), (None, "z", T0)], "id long, v string, t timestamp")
    assert [tuple(r) for r in lookup.latest(twice, "id", "t", ["id", "v", "t"]).select("id", "v").collect()] == [(1, "new")]


# problem 5


def _refs(spark, rows):
    return spark.createDataFrame(rows, "ref_table string, ref_id long, parent_id long, own_time timestamp")


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 7).alias("k"))
    probe = spark.range(0, 70_000).withColumnRenamed("id", "k")
    got = bloom.flag(probe, F.col("k"), bloom.build(keys, "k", 12), "maybe", 12).groupBy((F.col("k") % 7 == 0).alias("in"), "maybe").count().collect()
    n = {(r["in"], r.maybe): r["count"] for r in got}
    # 5,000 multiples of 7 below 35,000 are keys, 5,000 above are not
    assert n.get((True, True), 0) >= 5000 and n.get((False, True), 0) < 6000
    assert bloom.build(keys, "k", 12).count() <= 1 << 12
    none = bloom.flag(probe, F.col("k"), bloom.build(keys.limit(0), "k", 12), "maybe", 12)
    assert none.where("maybe").count() == 0


def test_orphans(spark):
    day = lambda d: datetime(2024, 3, d)
    refs = _refs(spark, [("m", 1, 10, day(5)), ("m", 2, 11, day(5)), ("m", 3, 99, day(5)), ("m", 4, None, day(5)), ("m", 4, None, None), ("m", 5, 99, None), ("m", 6, 11, None), ("m", 3, 99, day(5)), ("r", 3, 10, day(1)), ("m", 7, 12, day(9))])
    parents = spark.createDataFrame([(10, day(2), "x", True), (10, day(9), "x", True), (11, day(6), "x", True), (12, None, "x", True), (None, day(1), "x", True)], "id long, seen timestamp, salt string, maybe boolean")
    got = {tuple(r) for r in orphans.orphan_references(refs.withColumn("there", F.lit(1)), parents).collect()}
    assert got == {("m", 2, "2024-03", "late"), ("m", 3, "2024-03", "missing"), ("m", 5, None, "missing"), ("r", 3, "2024-03", "late")}
    assert {tuple(r) for r in orphans.orphan_report(orphans.orphan_references(refs, parents)).collect()} == {("m", "2024-03", "late", 1), ("m", "2024-03", "missing", 1), ("m", None, "missing", 1), ("r", "2024-03", "late", 1)}
    assert orphans.orphan_references(refs.limit(0), parents).count() == 0
    assert orphans.orphan_references(refs, parents.limit(0)).where("ref_state = 'missing'").count() == 7


def test_orphans_hot_key_and_small_filter(spark):
    refs = spark.range(0, 3000).select(F.lit("m").alias("ref_table"), F.col("id").alias("ref_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("parent_id"), F.lit(T0).alias("own_time"))
    parents = spark.range(0, 3000, 2).select("id", F.lit(T0).alias("seen"))
    want = {i for i in range(3000) if (1 if i % 3 == 0 else i) % 2 == 1}
    for log2 in (1, 18):  # a filter that lets everything pass changes nothing
        assert {r.ref_id for r in orphans.orphan_references(refs, parents, log2).collect()} == want
