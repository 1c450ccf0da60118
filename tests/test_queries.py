"""Every core query against its SQL on the smallest tables; queries without SQL must run and give rows."""

import math
import re
from datetime import datetime

import pytest

from quarry.plans import registry
from quarry.functions.stemmer import stem
from quarry.schema import DEPENDENCIES, SYMBOLS

from .compare import agree

T0 = datetime(2024, 1, 1)

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, small, name):
    agree(spark, duck, QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_every_reference_is_resolved(spark, tmp_path):
    """Four files of two symbols each, ids odd and even: the references with an odd id give edges too."""
    from quarry.plans.views import REPO

    rows = [(i, REPO, f"n{i}", f"q.n{i}", "function", f"f{(i + 1) // 2}.go", "h", "", i, i, "go", T0) for i in range(1, 9)]
    spark.createDataFrame(rows, SYMBOLS).write.parquet(str(tmp_path / "symbols.parquet"))
    got = {(r.caller_id, r.callee_id) for r in QUERIES["name_index_resolve"](spark, str(tmp_path)).collect()}
    assert got == {(i - 1 + i % 2, i) for i in range(1, 9)}


def test_every_search_is_fused(spark, small):
    """All searches of the tables, not one of them."""
    searches = {r.query_id for t in ("semantic_results", "fts_results") for r in spark.read.parquet(f"{small}/{t}.parquet").where("query_id is not null").select("query_id").distinct().collect()}
    assert {r.query_id for r in QUERIES["rrf_fusion"](spark, small).collect()} == searches and len(searches) > 1


@pytest.mark.parametrize("name, terms, stemmed", [("fts_term_bm25", ["shard"], False), ("fts_phrase_bm25", ["func", "x"], False), ("fts_term_stemmed", ["sharding"], True)])
def test_full_text_over_the_index(spark, tmp_path, name, terms, stemmed):
    """Brute force over documents written out by hand; some hits stand only in the keywords."""
    from quarry.plans.views import REPO

    made = [
        (1, REPO, "shard", "function", "func shard() {\n}", ""),
        (2, REPO, "route", "function", "func (x Ring) route() {\n  shard()\n}", "ring shard"),  # from the signature and a callee
        (3, REPO, "table", "variable", "var table =\n  shards(sharding, 4)", "sharding shards table"),  # from the initialiser
        (4, REPO, "parsed", "method", "def parsed(self):\n  raise ShardError", "sharderror"),
        (20, REPO, "load", "function", "def load():\n  parsed()", "parsed"),
        (5, "other", "shard", "function", "func (x) shard()", ""),
        *((i, "other" if i % 2 else REPO, f"f{i}", "function", "def f():", "") for i in range(6, 20)),
    ]
    spark.createDataFrame([(i, r, n, f"q.{n}", k, "a.go", "h", code, i, i, "go", T0) for i, r, n, k, code, _ in made], SYMBOLS).write.parquet(str(tmp_path / "symbols.parquet"))
    spark.createDataFrame([(2, 1, "call"), (2, 1, "import"), (20, 4, "call")], DEPENDENCIES).write.parquet(str(tmp_path / "dependencies.parquet"))
    form = stem if stemmed else str
    docs = {(i, r): [[form(w) for w in re.findall(r"[a-z0-9]+", text.lower())] for text in (n, f"q.{n}", k, code.split("\n")[0], words)] for i, r, n, k, code, words in made}
    terms = [form(w) for w in terms]
    tf = {d: sum(c[i : i + len(terms)] == terms for c in columns for i in range(len(c))) for d, columns in docs.items()}
    size = {d: sum(map(len, columns)) for d, columns in docs.items()}
    hits, mean = [d for d in docs if tf[d]], sum(size.values()) / len(docs)
    idf = max(math.log((len(docs) - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6)
    want = {d[0]: -idf * tf[d] * 2.2 / (tf[d] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for d in hits if d[1] == REPO}
    got = {r.symbol_id: r["rank"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) == {"fts_term_bm25": 2, "fts_phrase_bm25": 1, "fts_term_stemmed": 3}[name]


def test_wordpiece_reads_the_embedding_text(spark, tmp_path):
    """One signature, two kinds and names: the ids differ, and spell kind, qualified name and first line."""
    rows = [(1, "r", "a", "q.a", "function", "a.go", "h", "return\nclass", 1, 2, "go", T0), (2, "r", "b", "q.b", "class", "a.go", "h", "return", 3, 4, "go", T0)]
    spark.createDataFrame(rows, SYMBOLS).write.parquet(str(tmp_path / "symbols.parquet"))
    got = {r.symbol_id: [int(i) for i in r.ids.split() if i != "0"] for r in QUERIES["wordpiece"](spark, str(tmp_path)).collect()}
    at = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "function", "class", "return", "def", "func", *"abcdefghijklmnopqrstuvwxyz", *"0123456789", *"(){}:,.*_"])}
    assert got == {i: [at[w] for w in ["[CLS]", kind, "q", ".", name, ":", "return", "[SEP]"]] for i, kind, name in ((1, "function", "a"), (2, "class", "b"))}


def test_l2_normalize_reads_every_component(spark, tmp_path):
    """Vectors of one length and one head: only the components after the third tell them apart."""
    vectors = [(1, "r", [1.0, 2.0, 2.0, 4.0, 0.0]), (2, "r", [1.0, 2.0, 2.0, 0.0, 4.0]), (3, "r", [0.0] * 5)]
    spark.createDataFrame(vectors, "symbol_id long, repo_name string, embedding array<float>").write.parquet(str(tmp_path / "vec_symbols.parquet"))
    got = {r.symbol_id: r.weighed for r in QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    assert got == {1: 5.4, 2: 6.2, 3: 0.0}
