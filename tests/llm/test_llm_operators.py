"""Edge cases of each operator: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns, hot keys."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st


from quarry.llm import encoding, fusion, generated, grammar, lexicon, neardup, neighbours, packing, paragraphs, spans, splitting

from . import brute


def rows(df):
    return {tuple(r) for r in df.collect()}


# 1


def block(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(words, k, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"new{r.randrange(1000)}"
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def blocks():
    out = {}
    for s in range(40):
        base = block(s, 40 + s * 7, 60 if s % 2 else 400)
        for k in range(4):
            out[s * 10 + k] = " ".join(edited(base, k * len(base) // 16, s * 10 + k)) if k else " ".join(base)
    out[900] = out[901] = out[902] = out[0]
    out[903] = None
    out[904] = ""
    out[905] = "few words only"
    out[906] = " ".join(block(5, 30_000))
    out[907] = out[906] + " more"
    return out


def test_near_pairs_equal_brute_force(spark, blocks):
    df = spark.createDataFrame([(i, t, "x", 1, b"x") for i, t in blocks.items()] + [(0, blocks[0], "x", 2, b"y"), (None, blocks[0], "x", 2, b"y")], "id long, code_block string, shard string, n int, words binary")
    members, links = neardup.near_duplicates(df)
    got = neardup.expanded_pairs(members, links)
    assert rows(got) == brute.near_pairs(blocks) and got.count() == len(brute.near_pairs(blocks))
    by_id = {r.id: r.rep for r in members.collect()}
    assert by_id[900] == by_id[902] == 0 and not {903, 904, 905} & set(by_id)


def test_near_pairs_with_hot_shards(spark, blocks, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "HOT_CLASS", 1)
    df = spark.createDataFrame(list(blocks.items()), "id long, code_block string")
    members, links = neardup.near_duplicates(df)
    assert rows(neardup.expanded_pairs(members, links)) == brute.near_pairs(blocks)


def test_near_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id long, code_block string")
    members, links = neardup.near_duplicates(df)
    assert members.count() == 0 and links.count() == 0


def test_gray_rank_orders_neighbours():
    r = random.Random(3)
    for n in [*range(256), *(r.randrange(1 << 256) for _ in range(200))]:
        gray = n ^ n >> 1
        words = lambda v: np.array([[v >> 64 * i & (1 << 64) - 1 for i in (3, 2, 1, 0)]], np.uint64)
        assert (neardup.gray_rank(words(gray)) == words(n)).all()


def test_gray_index_loses_no_close_pair():
    r = np.random.default_rng(0)
    fp = r.integers(0, 2**63, (900, neardup.FP_WORDS)).astype(np.uint64)
    fp[300:600] = fp[:300] ^ (np.uint64(1) << r.integers(0, 63, (300, 1)).astype(np.uint64))
    shard, n = np.repeat([7, 9], 450), np.full(900, 50)
    x, y = neardup.GrayIndex(shard, n, fp, 0.8).pairs(0.8)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(900) for b in range(a + 1, 900) if shard[a] == shard[b] and np.bitwise_count(fp[a] ^ fp[b]).sum() <= 11}
    assert got == want


def test_gray_index_holds_a_block_of_pairs_only():
    """A shard of many unlike bags, whose masks prove nothing: all pairs of its nodes at once would be gigabytes."""
    fp = np.random.default_rng(1).integers(0, 2**63, (4000, neardup.FP_WORDS)).astype(np.uint64)
    fp[-1] = fp[0]
    tracemalloc.start()
    x, y = neardup.GrayIndex(np.zeros(4000, np.int64), np.full(4000, 300), fp, 0.8).pairs(0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {*x.tolist(), *y.tolist()} >= {0, 3999} and peak < 100e6


def test_counts_prove_that_long_bags_differ():
    """Fingerprints of long unlike bags differ in half of their bits at most, which is less than the bound."""
    texts = [" ".join(block(i, 600 if i < 40 else 60, 3000)) for i in range(50)]
    texts += [" ".join(edited(block(0, 600, 3000), 30, 1)), " ".join(["w1"] * 900 + block(3, 90, 3000)), " ".join(["w1"] * 1000 + block(3, 90, 3000))]
    bags = next(neardup._bags(40)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "code_block"])])))
    entries = neardup._entries(np.full(1 << neardup.SKETCH_LOG2, 2, np.uint32), 0.8)
    (found,) = entries(iter([bags.select(["id", "n", "words", "counts"])]))
    found = found.take(pa.array(np.unique(found.column(1).to_numpy(), return_index=True)[1]))  # one entry of each bag, all in one shard
    (first,) = neardup._shard_pairs(0.8)(iter([pa.RecordBatch.from_arrays([pa.array(np.zeros(found.num_rows, np.int64)), *found.columns[1:]], names=found.schema.names)]))
    assert list(zip(*(c.to_pylist() for c in first.columns))) == [(0, 50), (51, 52)]


# 2

PATHS = {
    "third_party/x/a.go": "vendored", "vendor/a/b.go": "vendored", "node_modules/@a/b/lib/c.ts": "vendored", "libs/a-1.2.3/src/b.java": "vendored", "a/_vendor/b.py": "vendored",
    "venv/lib/python3.11/site-packages/a/b.py": "vendored", "src/__generated__/a.ts": "generated", "api/v1/a.pb.go": "generated", "a_pb2.py": "generated", "x/zz_generated.a.go": "generated",
    "web/a.gen.ts": "generated", "gen/openapi/a.ts": "generated", "lib/a-min.js": "minified", "dist/a.umd.js": "minified", "public/a.min.js": "minified", "internal/vendorportal/a.go": None,
    "src/vendors/a/onboarding_b.py": None, "pkg/codegen/a.go": None, "internal/x/min_heap.go": None, "app/views/generated_report.ts": None, "src/a/generator/b.rs": None, "tools/minifier/a.py": None,
    "services/buildstatus/a.go": None, "src/external_auth/a.ts": None, "app/distribution/a.go": None,
}


def _function(i):
    r = random.Random(i)
    return "\n".join([f"func work{i}(a int) int {{", *(f"  if a > {r.randrange(9)} {{ return call{r.randrange(5)}(a, {r.randrange(99)}) }}" for _ in range(12)), "}"])


def test_origins(spark):
    r = random.Random(8)
    table = "var table = [\n" + "".join("  " + ", ".join(f"0x{r.randrange(1 << 16):04x}" for _ in range(8)) + ",\n" for _ in range(40)) + "]"
    strings = "words = [\n" + "".join(f"  '{r.randrange(1 << 60):x}',\n" for _ in range(60)) + "]"
    few = "var limits = [1, 20, 300, 4000, 50000]"
    layout = {
        "flat.js": [(1, _function(1)), (1, _function(2))], "blob.go": [(90, table)], "words.py": [(90, strings)], "small.go": [(90, few)], "big.go": [(30, _function(3)), (50, _function(4)), (60, few)],
        "nosize.js": [(1, _function(5)), (2, _function(6))], "nocode.go": [(40, None)], "blob_in_code.go": [(300, _function(7) * 20), (310, few)],
    }
    sizes = {"flat.js": 90_000, "blob.go": 9000, "words.py": None, "small.go": 4000, "big.go": 120_000, "nosize.js": None, "nocode.go": 4000, "blob_in_code.go": 9000}
    want = dict(PATHS) | {"flat.js": "minified", "blob.go": "data", "words.py": "data", "small.go": None, "big.go": None, "nosize.js": "minified", "nocode.go": None, "blob_in_code.go": None, None: None}
    files = [(i, "r", p, 4000) for i, p in enumerate(PATHS)] + [(100 + i, "r", p, sizes[p]) for i, p in enumerate(layout)] + [(200, "r", None, None), (0, "r", "third_party/x/a.go", 4000)]
    symbols = [(i, "r", p, line, code) for i, (p, line, code) in enumerate((p, line, code) for p, found in layout.items() for line, code in found)]
    symbols += [symbols[0], (None, "r", "small.go", 5, table), (900, "q", "small.go", 5, table), *((1000 + i, "r", f"other{i}.go", 30, _function(i + 50)) for i in range(40))]
    f = spark.createDataFrame([(*x, "x", "y") for x in files], "id long, repo_name string, path string, size_bytes long, last_line string, origin string")
    s = spark.createDataFrame([(*x, "x") for x in symbols], "id long, repo_name string, file_path string, end_line int, code_block string, tokens string")
    got = generated.file_origins(f, s).collect()
    names = {i: p for i, _, p, _ in files}
    assert len(got) == len(names) and {names[x.file_id]: x.origin for x in got} == want
    by_path = {names[x.file_id]: x for x in got}
    assert by_path["blob.go"].literal_share > 0.6 > 0.3 > by_path["big.go"].literal_share and by_path["nocode.go"].literal_chars == 0
    assert 0 < by_path["big.go"].rule_share < 1 <= by_path["big.go"].rule_spread <= by_path["big.go"].rule_reuse
    assert generated.file_origins(f, s, usage=False).columns == ["file_id", "origin", "literal_share", "literal_chars"]
    assert generated.file_origins(f.limit(0), s.limit(0)).count() == 0


TEXT = st.lists(st.sampled_from(["a", "b1", " ", "(", "12", '"s t"', "\n  ", "é"]), max_size=40).map("".join)


@given(st.lists(TEXT, min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_parse_keeps_the_characters(texts):
    """Every character stays in its text, whatever the rules; a rule stands for the digrams it was made of."""
    rows = grammar.sequences(texts, {})
    assert [int((x & grammar.LENGTH).sum()) for x in rows] == [len(t) for t in texts]
    s, owner = grammar.joined(rows)
    rules = []
    for _ in range(3):
        p = grammar.pairs(grammar.parse(s, owner, rules)[0])
        found = np.unique(p[p != 0])
        if not len(found):
            break
        rules.append(grammar.Rules(found))
    parsed, own = grammar.parse(s, owner, rules)
    assert [int((parsed[own == i] & grammar.LENGTH).sum()) for i in range(len(texts))] == [len(t) for t in texts]
    assert (np.bincount(own[parsed == 0], minlength=len(texts)) == 1).all()
    if rules:  # all digrams are rules: after a round no two terminals are neighbours
        once, _ = grammar.parse(s, owner, rules[:1])
        terminal = (once != 0) & (once & grammar.RULE == 0)
        assert not (terminal[1:] & terminal[:-1]).any()


def test_grammar_finds_the_frequent_digrams(spark):
    texts = ["x = call(y)\n" * 30, "x = call(z)\n" * 30, "".join(f"u{i} " for i in range(500))]
    rows = grammar.sequences(texts, {})
    df = spark.createDataFrame([(x.tobytes(),) for x in rows], "tokens binary").repartition(2)
    rules = grammar.infer(df, 1 / 400)
    parsed, own = grammar.parse(*grammar.joined(rows), rules)
    left = np.bincount(own[parsed != 0], minlength=3)
    assert len(rules) > 2 and left[0] < 40 and left[2] == 1000 and grammar.infer(df.limit(0)) == []


def test_whole_grammar_ends_when_no_digram_occurs_twice(spark, monkeypatch):
    """Blocks of few tokens, so that one digram's two places lie in different blocks and tasks."""
    monkeypatch.setattr(grammar, "BLOCK", 300)
    r = random.Random(3)
    once = [" ".join(f"u{i}_{j}" for j in range(20)) for i in range(30)]
    texts = ["x = call(y)\n" * 40, "aaaa " * 7, "+" * 33, "", *(" ".join(r.choices(once, k=4)) for _ in range(60))]
    rows = grammar.sequences(texts, {})
    df = spark.createDataFrame([(i, i % 3, x.tobytes()) for i, x in enumerate(rows)], "file long, repo long, tokens binary").repartition(4)
    first = grammar.infer(df, 1 / 50)
    parsed = grammar.whole(df, first, 1 / 50)
    blocks = parsed.collect()
    assert len(blocks) > 8 and len({b.block for b in blocks}) == len(blocks)
    symbols = [np.frombuffer(b.s, np.uint64) for b in blocks]
    digrams = Counter(d for s in symbols for d in grammar._digrams(s)[0].tolist())
    assert max(digrams.values()) == 1 and all(max(grammar._digrams(s)[1], default=1) == 1 for s in symbols)
    chars, held = Counter(), {}
    for b, s in zip(blocks, symbols):
        for f, g, piece in zip(np.frombuffer(b.file, np.int64).tolist(), np.frombuffer(b.repo, np.int64).tolist(), np.split(s, np.flatnonzero(s == 0) + 1)):
            chars[f] += int((piece & grammar.LENGTH).sum())
            held.update({(f, g, rule): n for rule, n in Counter(np.where(piece & grammar.RULE != 0, piece, 0)[piece != 0].astype(np.int64).tolist()).items()})
    assert chars == {i: len(x) for i, x in enumerate(texts)}
    assert {(x.file, x.repo, x.rule): x.uses for x in grammar.rule_uses(parsed).collect()} == held
    assert grammar.whole(df.limit(0), []).count() == 0


def test_reuse_counts_rules_of_any_frequency(spark):
    """Code that stands in two files only is far below the share that infer() stops at."""
    rare = {p: " ".join(f"{p}{j}" for j in range(30)) for p in "abc"}
    code = [("r", "a1", rare["a"]), ("q", "a2", rare["a"]), ("r", "b1", rare["b"]), ("r", "b2", rare["b"]), ("r", "c1", rare["c"]), (None, "a3", rare["a"])]
    code += [("s", f"other{i}", _function(i)) for i in range(150)]
    f = spark.createDataFrame([(i, *x[:2], 4000) for i, x in enumerate(code)], "id long, repo_name string, path string, size_bytes long")
    s = spark.createDataFrame([(i, *x[:2], 30, x[2]) for i, x in enumerate(code)], "id long, repo_name string, file_path string, end_line int, code_block string")
    got = {code[x.file_id][1]: x for x in generated.file_origins(f, s).collect()}
    assert got["a1"].rule_share == got["b1"].rule_share == 1 / 59 and got["c1"].rule_share == 1
    assert [(got[p].rule_reuse, got[p].rule_within, got[p].rule_spread) for p in ("a1", "b1", "c1")] == [(3, 1, 3), (2, 2, 1), (0, 0, 0)]
    assert got["a2"].rule_spread == 3 and got["a3"].rule_share == 0 and all(x.origin is None for x in got.values())


# 3


@given(st.lists(st.sampled_from(["word ", "x\n", "\n", " \t\r\n", "ä😀", "longer_token", "; ", "\r\n"]), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_cuts_equal_the_plain_rule(parts):
    text = "".join(parts)
    assert splitting.cuts(text, 60, 30, 5) == brute.pieces(text, 60, 30, 5)
    for a, z in splitting.cohesion_cuts(text, 60, 30, 5):
        assert 0 <= a < z <= len(text) and z - a <= 60


def test_split_blocks(spark):
    long = "a\n" * 2000
    data = [(1, long, 7), (1, long, 8), (2, None, 1), (3, "", 1), (4, "x" * 1800, 1), (5, "x" * 1801, 1), (None, long, 1), (6, "é" * 40_000, 1)]
    df = spark.createDataFrame(data, "id long, code_block string, start_char int")
    got = rows(splitting.split_blocks(df))
    assert {r[0] for r in got} == {1, 5, 6}
    assert got == {(i, a, z) for i, t, _ in data if i for a, z in brute.pieces(t)}
    assert splitting.split_blocks(df.limit(0)).count() == 0
    assert splitting.split_blocks(df, splitting.cohesion_cuts).where("symbol_id = 1").count() > 1
    with pytest.raises(ValueError):
        splitting.split_blocks(df, limit=100, least=100)


@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=5), min_size=1, max_size=25), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_cohesion_is_the_cosine_of_the_windows(lines, width):
    from collections import Counter

    got = splitting._cohesion(lines, width)
    for g in range(1, len(lines)):
        a, b = (Counter(w for line in part for w in line) for part in (lines[max(0, g - width) : g], lines[g : g + width]))
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert got[g - 1] == pytest.approx(sum(a[w] * b[w] for w in a) / norm if norm else 0.0)


def test_cohesion_cuts_between_topics():
    one, two = "alpha beta gamma\n" * 40, "delta omega sigma\n" * 40
    assert splitting.cohesion_cuts(one + two, 1000, 400, 50)[0][1] == len(one)


# 4


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 0) for i, v in data], "symbol_id long, embedding array<float>, cls int")


def test_nearest_pairs_edge_cases(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    data = [(i, e) for i in range(1, 13)] + [(20, [2.0, 0.0, 0.0, 0.0]), (21, [0.9, 0.1, 0.0, 0.0]), (22, [0.0, 1.0, 0.0, 0.0])]
    bad = [(30, None), (31, [0.0] * 4), (32, [1.0, 0.0]), (33, [float("nan"), 1.0, 0.0, 0.0]), (34, [float("inf"), 1.0, 0.0, 0.0]), (35, [None, 1.0, 0.0, 0.0]), (None, e), (1, e)]
    got = rows(neighbours.nearest_pairs(vectors(spark, data + bad), 5, 0.8, 4))
    assert got == brute.nearest(dict(data), 5, 0.8, 4)
    assert neighbours.nearest_pairs(vectors(spark, bad[:6]), 5, 0.8, 4).count() == 0


def test_nearest_pairs_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    r = np.random.default_rng(3)
    centres = r.normal(size=(150, 32))
    data = {i: (centres[i % 150] + 0.25 * r.normal(size=32)).astype(np.float32).tolist() for i in range(1500)}
    got = rows(neighbours.nearest_pairs(vectors(spark, list(data.items())), 5, 0.8, 32, probes=4, partition=128))
    want = brute.nearest(data, 5, 0.8, 32)
    assert len(got & want) >= 0.95 * len(want)


def test_nearest_pairs_over_two_levels(spark, monkeypatch):
    """A third of the vectors lie close together, so an upper partition, and a leaf, are far larger than the others."""
    for name, value in (("TILE", 64), ("ONE_LEVEL", 4), ("ROWS_A_SALT", 100), ("SAMPLE", 1000)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(5)
    centres = r.normal(size=(200, 32))
    data = {i: (centres[0 if i % 3 == 0 else i % 200] + 0.25 * r.normal(size=32)).astype(np.float32).tolist() for i in range(2400)}
    data |= {9000 + i: data[1] for i in range(12)}
    got = rows(neighbours.nearest_pairs(vectors(spark, list(data.items())), 5, 0.8, 32, partition=64))
    want = brute.nearest(data, 5, 0.8, 32)
    assert len(got & want) >= 0.93 * len(want)


def test_balanced_partition():
    x = np.random.default_rng(0).normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = neighbours.balanced_partition(x, 10)
    assert np.bincount(part, minlength=10).max() < 2.5 * 200 and np.bincount(part, minlength=10).min() > 40
    w, b = neighbours.fit_classifier(x, part, 10)
    assert (np.argmax(x @ w.T + b, axis=1) == part).mean() > 0.6


# 6


def hits(spark, data, name):
    return spark.createDataFrame([(q, i, s, "t", 1) for q, i, s in data], f"query_id long, symbol_id long, {name} double, goodness string, place int")


def test_places(spark):
    r = random.Random(1)
    a = [(q, r.randrange(40), r.choice([0.5, 0.7, r.random()])) for q in range(4) for _ in range(60)] + [(0, 1, None), (9, 1, None), (0, 2, float("nan")), (7, 5, 0.1)]
    b = [(q, r.randrange(40), -100 * r.random()) for q in range(3) for _ in range(30)]
    tables = [(hits(spark, [*a, (None, 1, 1.0), (1, None, 1.0)], "x"), "x", True), (hits(spark, b, "y"), "y", False)]
    assert rows(fusion.fused_places(tables)) == brute.places(a, [(q, i, -v) for q, i, v in b])
    top = fusion.component_places(tables)
    assert top.groupBy("query_id", "place").count().where("count > 1").count() == 0
    empty = [(t.limit(0), c, d) for t, c, d in tables]
    assert fusion.fused_places(empty).count() == 0 and fusion.component_places(empty).count() == 0


def test_component_ignores_the_range(spark):
    data = [(1, i, float(i % 7) + i / 10) for i in range(30)]
    plain = fusion.component_places([(hits(spark, data, "x"), "x", True), (hits(spark, [(q, i, -v) for q, i, v in data], "y"), "y", False)])
    wide = fusion.component_places([(hits(spark, data, "x"), "x", True), (hits(spark, [(q, i, -1e9 * v) for q, i, v in data], "y"), "y", False)])
    assert rows(plain) == rows(wide)


def test_component_signs(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0) for i in range(10)], "a double, b double, c double")
    loads = fusion.component(df, ["a", "b", "c"], [1, -1, 1])
    assert loads[0] > 0 > loads[1] and loads[2] == 0
    against = fusion.component(df, ["a", "b"], [1, 1])  # the two contradict each other: the first one decides
    assert against[0] == pytest.approx(0.5**0.5) and against[1] == pytest.approx(-(0.5**0.5))
    apart = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (None, 9.0)], "a double, b double")  # no row holds both
    assert fusion.component(apart, ["a", "b"], [1, 1]) == pytest.approx([0.5**0.5] * 2)
    both = spark.createDataFrame([(float(i), float(i * i), None) for i in range(5)] + [(9.0, None, 1.0)], "a double, b double, c double")
    assert fusion.component(both, ["a", "b", "c"], [1, 1, 1])[:2] == pytest.approx([0.5**0.5] * 2, abs=1e-6)


# 7


@given(st.lists(st.binary(min_size=1, max_size=6), max_size=60, unique=True))
@settings(max_examples=60, deadline=None)
def test_lexicon_finds_its_words_and_no_others(words):
    table = {w: [i, *w] for i, w in enumerate(words[::2])}
    found = lexicon.Lexicon(lexicon.build(table)).find(words + [b"", b"\xff" * 9])
    assert found == [tuple(table[w]) if w in table else None for w in words] + [None, None]


def test_automaton_shares_suffixes():
    a = lexicon.minimal_automaton(sorted(x + b"ation" for x in (b"n", b"r", b"st")))
    assert len(a["final"]) == 8  # start, after `s`, and one chain for the common end


RANKS = encoding.load_ranks(encoding.rank_file())


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_public_one(text):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=RANKS, special_tokens={})
    block = encoding.compile_lexicon([" the", "the", "é", "\n"], RANKS)
    assert encoding.Encoder(block, RANKS, encoding.split_pattern()).encode([text, None, ""]) == [own.encode_ordinary(text), [], []]


def test_plain_characters_are_what_they_are_taken_for():
    """Every plain character is an ASCII digit, a space, a letter or none of these, as the pattern's classes say."""
    import re

    import regex

    letter, plain = re.compile(f"[{encoding._LETTERS}]"), re.compile(encoding._PLAIN)
    for c in map(chr, range(0x3000)):
        if plain.fullmatch(c):
            assert bool(letter.fullmatch(c)) == bool(regex.fullmatch(r"\p{L}", c)) and bool(re.fullmatch(f"[{encoding._SPACE}]", c)) == bool(regex.fullmatch(r"\s", c))
            assert bool(re.fullmatch("[0-9]", c)) == bool(regex.fullmatch(r"\p{N}", c))


@given(st.text(st.sampled_from("ab'sltérßŁ’–—…09 \t\n\r\x0b\x1c\x85\xa0²中.-_"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_splitter_equals_the_pattern(text):
    import regex

    pattern = encoding.split_pattern()
    assert encoding.splitter(pattern)(text) == regex.compile(pattern).findall(text)
    assert encoding.splitter(r"\p{Lu}+|.")("ABc") == ["AB", "c"]


@given(st.text("aeinrstABé_😀", min_size=1, max_size=70))
@settings(max_examples=150, deadline=None)
def test_both_merges_agree(word):
    raw, short = word.encode(), lexicon.SHORT
    try:
        lexicon.SHORT = 0
        by_heap = lexicon.merge(raw, RANKS)
    finally:
        lexicon.SHORT = short
    assert by_heap == ([RANKS[raw]] if raw in RANKS else lexicon._merge_short(raw, RANKS))


def test_encoder_forgets(monkeypatch):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=RANKS, special_tokens={})
    monkeypatch.setattr(encoding, "MEMO", 50)
    encoder = encoding.Encoder(encoding.compile_lexicon([" word1"], RANKS), RANKS, encoding.split_pattern())
    for i in range(6):
        texts = ["", *(f"w{k} {'xyz' * k} word1" for k in range(i * 20, i * 30 + 20)), None]
        assert encoder.encode(texts) == [own.encode_ordinary(t or "") for t in texts]
        assert encoder.sizes(texts).tolist() == [len(own.encode_ordinary(t or "")) for t in texts]
    assert encoder.encode([]) == [] and encoder.sizes([None]).tolist() == [0]


def test_long_words():
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=RANKS, special_tokens={})
    for text in ("a" * 30_000, " " * 20_000, "ab" * 9000 + "!" * 5000, "<|endoftext|>"):
        assert encoding.Encoder(encoding.compile_lexicon([], RANKS), RANKS, encoding.split_pattern()).encode([text]) == [own.encode_ordinary(text)]


def test_encode_corpus(spark):
    data = [(1, "the cat the cat", 0), (2, None, 0), (3, "", 0), (1, "the cat the cat", 0), (4, "naïve — 中文 \r\n\t", 0), (None, "x", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int")
    got = encoding.encode_corpus(df).collect()
    assert len(got) == 6 and {len(r.ids) for r in got if r.doc_id in (2, 3)} == {0}
    assert {(r.doc_id, r.n_tokens) for r in encoding.token_sizes(df).collect()} == {(r.doc_id, len(r.ids)) for r in got}
    assert encoding.encode_corpus(df.limit(0)).count() == 0


# 8


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_item_once(sizes):
    histogram = {s: sizes.count(s) for s in sizes}
    used = {}
    for pattern, times in packing.plan(histogram, 40):
        assert sum(s * k for s, k in pattern.items()) <= 40 and times > 0
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * times
    assert used == histogram


def test_fill_pattern_is_the_best():
    assert sum(s * k for s, k in packing.fill_pattern(50, {30: 1, 26: 1, 24: 1, 7: 3}).items()) == 50
    assert packing.fill_pattern(5, {6: 2}) == {}
    with pytest.raises(ValueError):
        packing.plan({50: 1}, 40)


def test_audit_sees_faults(spark):
    sizes = spark.createDataFrame([(1, 150), (2, 30), (3, 0), (4, None), (5, 60)], "doc_id long, n_tokens int")
    good = packing.pack_items(sizes, 100)
    fields = ["documents", "over_full", "needless_pieces", "wrong_sizes", "gaps"]
    row = packing.audit(sizes, good, 100).first()
    assert [row[f] for f in fields] == [5, 0, 0, 0, 0] and row.near_least
    bad = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 0, 50), (2, 0, 3, 10), (2, 1, 3, 10), (3, 0, 0, 0), (4, 0, 0, 0)], "doc_id long, piece int, container_id long, n_tokens int")
    row = packing.audit(sizes, bad, 100).first()
    assert [row[f] for f in fields] == [5, 1, 1, 2, 2]


def test_pack_items(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([7, 7, 7, r.randrange(1, 100)])) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 250), (5003, 200), (5004, 100)]
    df = spark.createDataFrame([(i, n, 1, "x") for i, n in sizes], "doc_id long, n_tokens int, piece int, bucket string")
    got = packing.pack_items(df, 100).collect()
    fill = {}
    for x in got:
        fill[x.container_id] = fill.get(x.container_id, 0) + x.n_tokens
    total = sum(n or 0 for _, n in sizes)
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill))) and len(fill) <= total / 100 * 1.01 + 2
    assert sorted((x.doc_id, x.piece, x.n_tokens) for x in got if x.doc_id >= 5000) == [(5000, 0, 0), (5001, 0, 0), (5002, 0, 100), (5002, 1, 100), (5002, 2, 50), (5003, 0, 100), (5003, 1, 100), (5004, 0, 100)]
    assert len(got) == 3000 + 8 and sum(x.n_tokens for x in got) == total
    assert packing.pack_items(df.limit(0), 100).count() == 0
    assert {x.container_id for x in packing.pack_items(df.where("doc_id in (5000, 5001)"), 100).collect()} == {0}


# 9


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, first int, span string")


def test_stretches_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé😀 ") for _ in range(r.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = {}
    for i in range(80):
        parts = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(3)]
        p = r.choice(passage)
        a = r.randrange(0, 60)
        parts.insert(r.randrange(3), p[a : a + r.choice([100, 128, 129, 150, 400])])
        texts[i] = "".join(parts)
    for i in range(80, 120):
        texts[i] = texts[80 if i % 2 else 3] if i > 81 else " ".join(word() for _ in range(90))  # copies hold a third of all
    texts |= {200: None, 201: "", 202: "a" * 127, 203: "a" * 500, 204: "ab" * 300, 205: "ab" * 200, 206: passage[0] + passage[0], 207: "\n" * 128}
    df = documents(spark, list(texts.items()))
    assert rows(spans.shared_stretches(df)) == brute.stretches(texts, 128)


def test_recurrence_in_one_text_does_not_count(spark):
    p = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    df = documents(spark, [(1, p + "xyz" + p), (1, p + "xyz" + p), (2, "nothing of that kind"), (None, p)])
    assert spans.shared_stretches(df).count() == 0
    assert spans.shared_stretches(df.limit(0)).count() == 0
    share = spans.shared_share(df.where("doc_id is not null"), spans.shared_stretches(df)).collect()
    assert {(r.doc_id, r.share) for r in share} == {(1, 0.0), (2, 0.0)}


def test_run_groups_name_every_run_once(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab ") for _ in range(n)) for n in (1000, 128, 127, 0, 300)]
    sizes = np.array([len(t) for t in texts])
    _, first, runs, offset, text = spans.run_groups(spans.Hashes("".join(texts)), sizes)
    start = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        own = text == i
        a, k = first[own] - start[i], runs[own]
        assert k.sum() == max(n - 127, 0) and (not own.any() or a[0] == 0 and (a[1:] == a[:-1] + k[:-1]).all())
    assert runs.max() <= spans.WINDOW and 0 <= offset.min() and offset.max() < spans.WINDOW
    for part in (2, 5):  # texts apart, and places that turn often, name the same anchors
        monkeypatch.setattr(spans, "PLACE", 7 if part == 5 else 20)
        alone = [spans.run_groups(spans.Hashes(t), np.array([len(t)])) for t in texts if len(t) >= 128]
        assert {int(a) for x in alone for a in x[0]} == {int(a) for a in spans.run_groups(spans.Hashes("".join(texts)), sizes)[0]}


def test_stretches_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(spans, "AT_ONCE", 500)
    assert list(spans._chunks(np.array([100, 450, 40, 900, 1, 0]))) == [(0, 1), (1, 3), (3, 4), (4, 6)] and list(spans._chunks(np.zeros(0, int))) == []


def test_hashes_of_equal_substrings():
    h = spans.Hashes("xx" + "héllo wörld" + "yy" + "héllo wörld")
    a, z = np.array([2, 15]), np.array([13, 26])
    assert len(set(h.of(a, z).tolist())) == 1 and h.of(np.array([0]), np.array([2]))[0] != h.of(np.array([13]), np.array([15]))[0]


def test_paragraphs_equal_brute_force(spark, monkeypatch):
    """Clusters, links and what is kept, against all pairs; a third of the paragraphs are copies of one."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(300)}"
    bases = [[word() for _ in range(r.randrange(30, 80))] for _ in range(25)]
    made = []
    for b in bases:
        made.append(" ".join(b))
        for k in range(3):
            c = list(b)
            for _ in range(k):
                c[r.randrange(len(c))] = "new" + str(r.randrange(99))
            made.append(" ".join(c))
    made += ["Only, four short words", "only four short  WORDS!", "x"] + [made[0]] * 50
    r.shuffle(made)
    texts = {i: "\n\n".join(made[i * 4 : i * 4 + 4]) for i in range(-(-len(made) // 4))}
    texts |= {900: None, 901: "", 902: " \n\n \t\n", 903: "!!!\n\n???", 904: "line one\nline two\n \n  after a blank line  "}
    data = [(i, t, 1, 2) for i, t in texts.items()] + [(0, texts[0], 1, 2), (None, "a b c d e f", 1, 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, cls int, links int")
    want_rows = [(i, n, a, z) for i, t in texts.items() if t for n, (a, z) in enumerate(paragraphs.pieces(t)) if paragraphs._WORD.search(t[a:z])]
    sets = [frozenset(paragraphs.shingles(texts[i][a:z]).tolist()) for i, _, a, z in want_rows]
    distinct = sorted(set(sets), key=sorted)
    near = {s: {t for t in distinct if t != s and len(s & t) >= 0.8 * len(s | t) - 1e-9} for s in distinct}
    label = {s: n for n, s in enumerate(distinct)}
    for _ in distinct:
        label = {s: min([label[s], *(label[t] for t in near[s])]) for s in distinct}
    first = {}
    for row, s in sorted(zip(want_rows, sets)):
        first.setdefault(label[s], row[:2])
    want = {row: (label[s], len(near[s]), first[label[s]] == row[:2]) for row, s in zip(want_rows, sets)}
    for tile in (1024, 2):
        monkeypatch.setattr(paragraphs, "TILE", tile)
        monkeypatch.setattr(paragraphs, "HOT", 100_000 if tile > 2 else 5)
        got = {(x.doc_id, x.paragraph, x.start_char, x.end_char): x for x in paragraphs.near_duplicate_paragraphs(df).collect()}
        assert set(got) == set(want) and len({x.class_id for x in got.values()}) == len(set(label.values()))
        assert {k: (x.links, x.kept) for k, x in got.items()} == {k: v[1:] for k, v in want.items()}
        assert len({(x.class_id, want[k][0]) for k, x in got.items()}) == len(set(label.values()))
    assert paragraphs.near_duplicate_paragraphs(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 200).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(500, 503).selectExpr("id as a", "503L as b"))
    assert {(r.node, r.root) for r in paragraphs.components(edges).collect()} == {(i, 0) for i in range(201)} | {(i, 500) for i in range(500, 504)}


def test_pieces():
    assert [(("a\n\nb c\r\n \t\r\n\nd\n")[a:z]) for a, z in paragraphs.pieces("a\n\nb c\r\n \t\r\n\nd\n")] == ["a", "b c\r", "d\n"]
    assert paragraphs.pieces("") == [] and paragraphs.pieces("\n\n\n") == []
