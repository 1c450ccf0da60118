"""The registered queries of this subpackage on the smallest tables: against SQL where there is some, else brute force."""

import pytest

from quarry.llm import encoding, registry, splitting

from ..compare import agree
from .brute import near_pairs, nearest, places, stretches

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, small, name):
    agree(spark, duck, QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_p1_against_brute_force(spark, small):
    blocks = spark.read.parquet(f"{small}/symbols.parquet").select("id", "code_block").distinct().collect()
    assert rows(QUERIES["p1_found"](spark, small)) == near_pairs(dict(map(tuple, blocks)))


def test_p1_classes_cover(spark, small):
    got = QUERIES["p1_classes"](spark, small)
    assert got.count() == got.select("symbol_id").distinct().count()


def test_p3_pieces_rebuild_the_blocks(spark, small):
    texts = dict(map(tuple, spark.read.parquet(f"{small}/symbols.parquet").select("id", "code_block").collect()))
    by_id = {}
    for i, a, z in sorted(rows(QUERIES["p3_found"](spark, small))):
        by_id.setdefault(i, []).append((a, z))
    assert set(by_id) == {i for i, t in texts.items() if len(t) > splitting.LIMIT}
    for i, pieces in by_id.items():
        assert pieces[0][0] == 0 and pieces[-1][1] == len(texts[i])
        assert all(z - a <= splitting.LIMIT for a, z in pieces)
        assert all(b == z - splitting.OVERLAP for (_, z), (b, _) in zip(pieces, pieces[1:]))


def test_p4_recall(spark, small):
    table = spark.read.parquet(f"{small}/vec_symbols.parquet").select("symbol_id", "embedding").collect()
    want = nearest({r.symbol_id: r.embedding for r in table})
    got = rows(QUERIES["p4_found"](spark, small))
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_p6_against_brute_force(spark, small):
    s = [tuple(r) for r in spark.read.parquet(f"{small}/semantic_results.parquet").select("query_id", "symbol_id", "similarity_score").collect()]
    f = [tuple(r) for r in spark.read.parquet(f"{small}/fts_results.parquet").select("query_id", "symbol_id", "fts_rank").collect()]
    assert rows(QUERIES["p6_found"](spark, small)) == places(s, [(q, i, None if v is None else -v) for q, i, v in f])


def test_p7_against_the_public_implementation(spark, small):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=encoding.load_ranks(encoding.rank_file()), special_tokens={})
    texts = dict(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: list(r.ids) for r in QUERIES["p7_ids"](spark, small).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in texts.items()}


def test_p8_containers(spark, small):
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p7_ids"](spark, small).collect()}
    got = QUERIES["p8_containers"](spark, small).collect()
    fill, total = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        total.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert {d: sum(r.n_tokens for r in pieces) for d, pieces in total.items()} == sizes
    assert all(len(p) == max(1, -(-sizes[d] // 2048)) for d, p in total.items())
    assert len(fill) <= -(-sum(sizes.values()) // 2048) + 1


def test_p9_against_brute_force(spark, small):
    texts = dict(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    assert rows(QUERIES["p9_found"](spark, small)) == stretches(texts, 128)
    share = {r.doc_id: r for r in QUERIES["p9_share"](spark, small).collect()}
    assert set(share) == set(texts) and all(0 <= r.share <= 1 for r in share.values())
