import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions import embedders, params, scalars
from quarry.functions.stemmer import stem


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'double' if isinstance(values[n], float) else 'long'}" for n in names))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("size, tokens", [(-3, 0), (0, 0), (1, 1), (4, 1), (5, 2), (9, 3), (4096, 1024)])
def test_estimate_tokens(spark, size, tokens):
    assert one(spark, scalars.estimate_tokens(F.col("n")), n=size) == tokens


@pytest.mark.parametrize("tokens, cost", [(0, "$0.00"), (3000, "$0.00"), (200_000, "$0.60"), (2_000_000, "$6.00")])
def test_format_cost(spark, tokens, cost):
    assert one(spark, scalars.format_cost(F.col("n")), n=tokens) == cost


@pytest.mark.parametrize("files, response, saved", [(8000, 800, 1800), (80, 200, 0), (0, 8, 0), (40, 40, 0)])
def test_saved_tokens(spark, files, response, saved):
    assert one(spark, scalars.saved_tokens(F.col("a"), F.col("b")), a=files, b=response) == saved


@pytest.mark.parametrize(
    "path, normal",
    [("/u/:id", "/u/:param"), ("/u/{id}/x/{other_id}", "/u/:param/x/:param"), ("/u/17?q=1", "/u/17?q=1"), ("/:_a1/b", "/:param/b"), ("", "")],
)
def test_normalize_path(spark, path, normal):
    assert one(spark, scalars.normalize_path(F.col("p")), p=path) == normal


def test_nulls_pass_through_scalars(spark):
    assert one(spark, scalars.normalize_path(F.col("p")), p=None) is None
    assert one(spark, scalars.signature(F.col("p")), p=None) is None
    assert one(spark, scalars.author(F.col("p")), p=None) == "agent"


def test_keywords(spark):
    code = "func Load(ctx Context) error {\n try { x } catch (IOFailure e) { retry() }\n return ParseError\n}"
    words = one(spark, scalars.keywords(F.col("c"), F.lit("function"), F.array(F.lit("Open"), F.lit("io"))), c=code)
    assert words == "context iofailure load open parseerror retry"
    assert one(spark, scalars.keywords(F.col("c"), F.lit("variable"), F.array().cast("array<string>")), c="var maxSize = newLimit(null)") == "maxsize newlimit"


def test_embed_text(spark):
    assert one(spark, scalars.embed_text(F.lit("type"), F.lit("A.b"), F.col("c"), F.lit("x y")), c="  def f():\n  pass") == "type A.b: def f(): [x y]"
    assert one(spark, scalars.embed_text(F.lit("type"), F.lit("A.b"), F.col("c"), F.lit("")), c="z") == "type A.b: z"


def test_dot_and_normalize(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [1.0], [0.0, 0.0])], "a array<float>, b array<float>, c array<float>, z array<float>")
    r = df.select(scalars.dot(F.col("a"), F.col("b")).alias("ab"), scalars.dot(F.col("a"), F.col("c")).alias("ac"), scalars.l2_normalize(F.col("b")).alias("n"), scalars.l2_normalize(F.col("z")).alias("z")).first()
    assert (r.ab, r.ac, r.z) == (11.0, 0.0, [0.0, 0.0])
    assert np.allclose(r.n, [0.6, 0.8])


@pytest.mark.parametrize("status, lines, changed, kind", [("A", 9, 1, "added"), ("D", 9, 1, "deleted"), ("M", 3, 3, "added"), ("M", 3, 2, "modified"), (None, 3, 1, "modified")])
def test_change_type(spark, status, lines, changed, kind):
    assert one(spark, scalars.change_type(F.col("s"), F.lit(lines), F.lit(changed)), s=status) == kind


@pytest.mark.parametrize("value, names", [("a", ["a"]), (["a", "b"], ["a", "b"]), ('["x", "y"]', ["x", "y"]), ("[not json", ["[not json"]), ("[1]", ["[1]"]), ([], [])])
def test_string_or_list(value, names):
    assert params.string_or_list(value) == names


@pytest.mark.parametrize("value", [None, "", [1], 7, ["a"] * 51])
def test_string_or_list_refuses(value):
    with pytest.raises(ValueError):
        params.string_or_list(value)


@pytest.mark.parametrize(
    "pattern, literal",
    [("^plain$", "plain"), (r"open\(", "open"), (".*", ""), ("ab.*", ""), (r"\bword\b", "word"), ("one|two", ""), ("x+yes_1", "yes_1"), ("(one|two)+three?", "thre"), ("(?:part){2,}x", "part"),
     ("(part){0,2}other", "other"), ("say [a-z]+ loudly", "loudly"), (r"\p{L}+word", ""), ("[[:alpha:]_word]+", ""), (r"\Qa.b\E", "")],
)
def test_required_literal(pattern, literal):
    assert params.required_literal(pattern) == literal


@given(st.lists(st.sampled_from(["abc", "de", "x", "(abc|de)", "(?:fgh)?", "[a-d]", "x*", "(abcd)+", ".", "^", "$", r"\b"]), min_size=1, max_size=6), st.text("abcdefghx ", max_size=20))
@settings(max_examples=300, deadline=None)
def test_every_match_holds_the_literal(parts, text):
    import re

    pattern = "".join(parts)
    if re.search(pattern, text):
        assert params.required_literal(pattern) in text


@pytest.mark.parametrize(
    "pattern, text",
    [("(?P<n>foo)(?P=n)", r"(foo)\1(?:)"), ("[[:alpha:][:^digit:]_]+", r"[\p{Alpha}[^\p{Digit}]_]+"), ("[]a[]", r"[\]a\[]"), ("[a&&b]", r"[a&\&b]"), (r"\(?P<x>a", r"\(?P<x>a"), (r"(a)(?<b>c)(?P<d>e)(?P=d)", r"(a)(?<b>c)(e)\3(?:)"),
     (r"[\]&&]", r"[\]&\&]"), ("(?:a|b)(?i)c", "(?:a|b)(?i)c"), (r"\Q(?P<a>\E", r"\Q(?P<a>\E"), ("[^]]", r"[^\]]")],
)
def test_engine_pattern(pattern, text):
    assert params.engine_pattern(pattern) == text


@pytest.mark.parametrize("pattern", ["(?P=none)", "[[:nothing:]]"])
def test_engine_pattern_refuses(pattern):
    with pytest.raises(ValueError):
        params.engine_pattern(pattern)


@pytest.mark.parametrize("query, phrase", [("a", '"a"'), ('say "x"', '"say ""x"""'), ("", '""'), ("a AND b*", '"a AND b*"')])
def test_phrase(query, phrase):
    assert params.phrase(query) == phrase


def test_limits():
    assert [params.limit_or(n, 50, 200) for n in (0, -1, 7, 500, None)] == [50, 50, 7, 200, 50]
    assert params.in_range_or(99, 1, 50, 10) == 10 and params.clamp(9, 0, 3) == 3


@pytest.mark.parametrize(
    "word, root",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("happy", "happi"), ("generalizations", "gener"),
     ("connection", "connect"), ("adjustable", "adjust"), ("controlling", "control"), ("sky", "sky"), ("is", "is"), ("ÄRGER", "ÄRGER")],
)
def test_stem(word, root):
    assert stem(word) == root


def test_hash_vectors():
    v = embedders.hash_vectors(["one", "two", "one", ""], 16)
    assert v.shape == (4, 16) and np.allclose((v**2).sum(axis=1), 1, atol=1e-5)
    assert (v[0] == v[2]).all() and not (v[0] == v[1]).all()
    # the first number of the empty text, by hand: offset, one step, high half over the greatest int
    seed = (14695981039346656037 * 6364136223846793005 + 1442695040888963407) % 2**64
    raw = (seed - 2**64 if seed >= 2**63 else seed) >> 32
    assert np.sign(v[3][0]) == np.sign(raw)


def test_wordpiece():
    t = embedders.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "un": 4, "##able": 5, "run": 6, ".": 7}, max_tokens=7)
    assert t.encode("Run, unable.")[0] == [2, 6, 1, 4, 5, 7, 3]
    assert t.encode("run")[0:2] == ([2, 6, 3, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0])
    assert t.encode("x" * 101)[0][1] == 1 and t.encode(None)[0][:2] == [2, 3]
    assert embedders.WordPiece({"a": 9}).special["[UNK]"] == 100
    assert embedders.WordPiece.from_lines("a\nb\n").vocabulary == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        embedders.WordPiece.from_json('{"model": {"type": "BPE", "vocab": {}}}')


def test_static_vectors():
    t = embedders.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "b": 5})
    m = np.arange(12, dtype=np.float32).reshape(6, 2)
    assert np.allclose(embedders.static_vectors(["a b"], t, m, normalize=False), [[9, 10]])
    assert np.allclose(embedders.static_vectors([""], t, m), [[0, 0]])
