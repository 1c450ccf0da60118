"""Sources, parsers, embedders and parameter rules as registered queries, with their SQL.

Trees, diffs and model files are made from the tables, so that SQL can say from the same rows what must come out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import embedders, params, scalars
from ..operators import graph
from ..parse import extract
from ..session import mounted, scratch, spread, table
from ..sources import gitdiff, tensors, walk
from ..streaming import watch
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


# trees

IGNORE = ["# made for the check", "", "*_test.go", "scripts", "!kept.go"]
_TREES: dict[tuple[str, str], str] = {}
#: The files of the tree: the blocks of each file of the symbols table, one below the other.
TREE = "SELECT repo_name, file_path, string_agg(code_block, chr(10) ORDER BY start_line, id) AS content FROM sym GROUP BY repo_name, file_path"
INDEXED = (
    "regexp_matches({0}, '\\.(ts|tsx|jsx|go|py|js|mjs|rs|java|c|h|cpp|hpp|cc|cxx|hxx|hh|cs)$') AND octet_length(encode(content)) <= 1048576"
    " AND NOT regexp_matches({0}, '(^|/)(node_modules|dist|build|\\.git|\\.next|\\.nuxt|coverage|__pycache__|vendor)/') AND NOT regexp_matches({0}, '(^|/)([^/]*_test\\.go|scripts)(/|$)')"
)


def tree_of(rows: DataFrame, root: str) -> str:
    """Writes rows(path, content) as files below root, each by the worker that holds it, and an ignore file; root."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write("\n".join(IGNORE))
    rows.select("path", "content").mapInPandas(write, "n long").count()
    return root


def tree(spark: SparkSession, sf: str) -> str:
    """The tree of a folder of tables, written once a session: ROOT/repository/path."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        root = mounted(spark, scratch(spark, "tree"))
        if root is None:
            raise ValueError("a tree of files needs a mounted shared folder")
        ordered = F.array_sort(F.collect_list(F.struct("start_line", "id", "code_block")))
        files = symbols(spark, sf, "code_block").groupBy("repo_name", "file_path").agg(F.array_join(F.transform(ordered, lambda s: s["code_block"]), "\n").alias("content"))
        _TREES[key] = tree_of(files.select(F.concat_ws("/", "repo_name", "file_path").alias("path"), "content"), root)
    return _TREES[key]


@query(
    "SELECT path, sha256(content) AS content_hash, octet_length(encode(content))::BIGINT AS size_bytes, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language"
    f" FROM (SELECT repo_name || '/' || file_path AS path, content FROM tree) WHERE {INDEXED.format('path')}", tree=TREE)
def scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of a directory with its ignore file: hashes, sizes and languages of what may be indexed."""
    return walk.scan(spark, tree(spark, sf), "all", with_content=False).select("path", "content_hash", "size_bytes", "language")


@query(f"SELECT path, sha256(content) AS content_hash FROM (SELECT repo_name || '/' || file_path AS path, content FROM tree) WHERE {INDEXED.format('path')} AND path LIKE '%e%.go'", tree=TREE)
def read_named_files(spark: SparkSession, sf: str) -> DataFrame:
    """The contents of some files, opened by name."""
    root = tree(spark, sf)
    named = walk.listing(spark, root).where("path like '%e%.go'").select("path")
    return walk.read_files(spark, root, "all", named).select("path", F.sha2("content", 256).alias("content_hash"))


@query(
    "SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'create' WHEN a.path IS NULL THEN 'remove' ELSE 'write' END AS op FROM b FULL JOIN a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.size <> b.size",
    b="SELECT repo_name || '/' || path AS path, coalesce(size_bytes, 0) AS size FROM fil",
    a="SELECT path, size + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS size FROM (SELECT id, repo_name || '/' || path AS path, coalesce(size_bytes, 0) AS size FROM fil) WHERE id % 11 <> 0 UNION ALL SELECT repo_name || '/new/' || path, 1 FROM fil WHERE id % 13 = 0",
)
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a watcher reports between two listings of a tree."""
    rows = view(spark, sf, "files", ["id", "repo_name", "path", "size_bytes", "last_indexed"])
    before = rows.select("id", F.concat_ws("/", "repo_name", "path").alias("path"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.col("last_indexed").alias("modified"))
    after = before.where("id % 11 <> 0").withColumn("size_bytes", F.expr("size_bytes + if(id % 7 = 0, 1, 0)"))
    new = rows.where("id % 13 = 0").select("id", F.concat_ws("/", "repo_name", F.lit("new"), "path").alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.col("last_indexed").alias("modified"))
    return watch.changes(before, after.unionByName(new))


# diffs


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs made of the files table, a few texts a repository: a quarter added, deleted, modified and renamed each."""
    files = view(spark, sf, "files", ["id", "repo_name", "path"])
    status = F.element_at(F.array(*[F.lit(x) for x in ("A", "D", "M", "R097")]), (F.col("id") % 4 + 1).cast("int"))
    paths = F.when(status == "R097", F.concat(F.lit("old/"), "path", F.lit("\x00"), "path")).otherwise(F.col("path"))
    raw = F.concat(F.lit(":100644 100644 abcdef1 1234567 "), status, F.lit("\x00"), paths, F.lit("\x00"))
    hunk = "concat('@@ -', k * 10 + 1, ',2 +', k * 20 + id % 50 + 1, if(id % 5 = 1, '', concat(',', id % 5)), ' @@ func f() {\n-gone\n+@@ -1 +1 @@\n')"
    new = F.when(status == "D", F.lit("+++ /dev/null\n@@ -1,3 +0,0 @@\n-+++ b/none\n")).otherwise(F.concat(F.lit("+++ b/"), "path", F.lit("\n"), F.expr(f"array_join(transform(sequence(0, cast(id % 3 as int)), k -> {hunk}), '')")))
    patch = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nindex abcdef1..1234567 100644\n--- a/"), "path", F.lit("\n"), new)
    grouped = files.select("repo_name", (F.col("id") % 8).alias("some"), F.struct("id", raw.alias("raw"), patch.alias("patch")).alias("f")).groupBy("repo_name", "some").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return grouped.select("repo_name", F.concat(F.array_join("f.raw", ""), F.lit("\x00"), F.array_join("f.patch", "")).alias("text"))


_STATUS = "SELECT repo_name, path AS file_path, (['A', 'D', 'M', 'R097'])[(id % 4)::INTEGER + 1] AS status FROM fil"
_LINES = "SELECT repo_name, path AS file_path, (k * 20 + id % 50 + 1)::INTEGER AS start_line, (id % 5)::INTEGER AS line_count FROM (SELECT *, unnest(range(0, id % 3 + 1)) AS k FROM fil WHERE id % 4 <> 1) WHERE id % 5 > 0"


@query(_STATUS)
def diff_name_status(spark: SparkSession, sf: str) -> DataFrame:
    return gitdiff.name_status(_diffs(spark, sf))


@query(_LINES)
def diff_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return gitdiff.hunks(_diffs(spark, sf))


@query("SELECT s.repo_name, s.file_path, s.status, (SELECT count(*) FROM lines l WHERE l.repo_name = s.repo_name AND l.file_path = s.file_path)::BIGINT AS hunks FROM st s WHERE s.status = 'D' OR EXISTS (SELECT 1 FROM lines l WHERE l.repo_name = s.repo_name AND l.file_path = s.file_path)", st=_STATUS, lines=_LINES)
def diff_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Files and how many hunks each has; those without are listed only if deleted."""
    files, lines = gitdiff.combined(_diffs(spark, sf))
    counts = lines.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("hunks"))
    return files.join(counts, ["repo_name", "file_path"], "left").select("repo_name", "file_path", "status", F.coalesce("hunks", F.lit(0)).alias("hunks"))


# parsers


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every function and method as a file of its own; a method in a class, where its language wants one."""
    rows = symbols(spark, sf, "code_block", "language").where("kind in ('function', 'method') and language is not null")
    method = F.col("kind") == "method"
    indented = F.concat(F.lit("class W:\n    "), F.replace("code_block", F.lit("\n"), F.lit("\n    ")))
    code = (
        F.when((method & (F.col("language") != "go") & (F.col("language") != "python") & (F.col("language") != "rust")) | (F.col("language") == "java"), F.concat(F.lit("class W {\n"), "code_block", F.lit("\n}")))
        .when(method & (F.col("language") == "python"), indented).when(method & (F.col("language") == "rust"), F.concat(F.lit("impl W {\n"), "code_block", F.lit("\n}"))).otherwise(F.col("code_block"))
    )
    return rows.select("repo_name", F.col("id").cast("string").alias("path"), "language", code.alias("content"))


@query("SELECT id, name, CASE WHEN kind = 'method' OR language = 'java' THEN 'method' ELSE 'function' END AS kind FROM sym WHERE kind IN ('function', 'method') AND language IS NOT NULL")
def parsed_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The first function that the parser of its language finds in each function's and method's code: name and kind.

    Go, Python, TypeScript, JavaScript, Rust and Java; some of the Python does not parse.
    """
    found = extract.symbol_rows(extract.parse_files(spread(_as_files(spark, sf)))).where("kind in ('function', 'method')")
    first = found.groupBy("file_path").agg(F.min_by(F.struct("name", "kind"), F.struct("start_line", "name")).alias("s"))
    return first.select(F.col("file_path").cast("long").alias("id"), "s.name", "s.kind")


_HEADS = {
    "go": ("import (\n\t\"fmt\"\n\t\"mod/p{0}\"\n)\n", ["fmt", "mod/p{0}"]), "python": ("import mod{0}\nfrom pkg{0} import x\n", ["mod{0}", "pkg{0}"]), "typescript": ("import {{ a }} from './m{0}';\n", ["./m{0}"]),
    "javascript": ("import a from './m{0}';\n", ["./m{0}"]), "java": ("import a.b.C{0};\n", ["a.b.C{0}"]), "rust": ("use a::b{0};\n", ["a::b{0}"]),
}


@query("SELECT id, imported FROM (SELECT id, language, unnest(CASE language " + " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(n.split('{0}')[0]) + (' || (id % 9)::VARCHAR' if '{0}' in n else '') for n in names)}]" for lang, (_, names) in _HEADS.items()) + " END) AS imported FROM sym WHERE kind IN ('function', 'method') AND language IS NOT NULL)")
def file_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What each file imports, of files that begin with the imports of their language."""
    rows = _as_files(spark, sf)
    number = (F.col("path").cast("long") % 9).cast("string")
    head = F.lit("")
    for lang, (text, _) in _HEADS.items():
        parts = text.replace("{{", "{").replace("}}", "}").split("{0}")
        pieces = [x for p in parts for x in (F.lit(p), number)][:-1]
        head = F.when(F.col("language") == lang, F.concat(*pieces)).otherwise(head)
    files = rows.withColumn("content", F.concat(head, "content"))
    edges = extract.edge_rows(extract.parse_files(spread(files)))
    return extract.imports_of_files(edges).select(F.col("file_path").cast("long").alias("id"), F.col("symbol").alias("imported"))


@query(
    "SELECT DISTINCT id, regexp_extract(part, '(?:^|[^\\w.$])([A-Za-z_]\\w*)\\s*$', 1) AS called FROM parts WHERE NOT regexp_matches(part, '(?:\\bdef|\\bfunc|\\)) +[A-Za-z_]\\w*\\s*$')"
    " AND regexp_extract(part, '(?:^|[^\\w.$])([A-Za-z_]\\w*)\\s*$', 1) NOT IN ('', 'func', 'return', 'if', 'for', 'switch', 'in', 'not', 'and', 'or', 'is', 'else', 'elif', 'while', 'with', 'assert', 'case', 'go', 'defer', 'yield', 'await', 'lambda', 'range')",
    bare="SELECT id, regexp_replace(code_block, '\"(?:\\\\.|[^\"\\\\\\n])*\"|''(?:\\\\.|[^''\\\\\\n])*''|`[^`]*`|//[^\\n]*|#[^\\n]*', ' ', 'g') AS code FROM sym WHERE kind IN ('function', 'method') AND language IN ('go', 'python')",
    parts="SELECT id, unnest(string_split(code, '(')[1:-2]) AS part FROM bare",
)
def called_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names that each Go and Python function calls; SQL takes what stands before brackets."""
    files = _as_files(spark, sf).where("language in ('go', 'python')")
    edges = extract.edge_rows(extract.parse_files(spread(files))).where("kind = 'call'")
    return edges.select(F.col("file_path").cast("long").alias("id"), F.col("symbol").alias("called")).where("called <> 'range'").distinct()


# embedders and tokenizers

WORDS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "function", "class", "return", "def", "func", *"abcdefghijklmnopqrstuvwxyz", *"0123456789", *"(){}:,.*_", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789")]
_TEXT = "SELECT id, kind || ' ' || qualified_name || ': ' || regexp_replace(split_part(code_block, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS text FROM sym"
_SPLIT = "regexp_extract_all(lower(text), '[\\p{P}\\p{S}]|[^\\s\\p{P}\\p{S}]+')"
#: Ids of a word: its longest prefix in the vocabulary is one of five words or one character; the rest is single characters.
_IDS = (
    f"list_transform({_SPLIT}, lambda w: CASE WHEN octet_length(encode(w)) > 100 THEN [1] ELSE list_transform(regexp_extract_all(w, '^(?:function|return|class|func|def)|.'), lambda p, i:"
    " CASE WHEN length(p) > 1 THEN list_position(['function', 'class', 'return', 'def', 'func'], p) + 3 WHEN i = 1 AND instr('(){}:,.*_', p) > 0 THEN 44 + instr('(){}:,.*_', p)"
    " WHEN instr('abcdefghijklmnopqrstuvwxyz0123456789', p) > 0 THEN (CASE WHEN i = 1 THEN 8 ELSE 53 END) + instr('abcdefghijklmnopqrstuvwxyz0123456789', p) ELSE NULL END) END)"
)
_PIECES = {"texts": _TEXT, "pieces": f"SELECT id, flatten(list_transform({_IDS}, lambda l: CASE WHEN len(list_filter(l, lambda x: x IS NULL)) > 0 THEN [1] ELSE l END))[1:126] AS ids FROM texts"}


def _embed_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(symbols(spark, sf, "code_block"))
    return rows.select(F.col("id").alias("symbol_id"), scalars.embed_text(F.col("kind"), F.col("qualified_name"), F.col("code_block")).alias("text"))


@query("SELECT id AS symbol_id, array_to_string(list_concat(list_concat([2], ids), list_concat([3], list_transform(range(0, 126 - len(ids)), lambda x: 0))), ' ') AS ids FROM pieces", **_PIECES)
def wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    """WordPiece ids of every symbol's embedding text over a stand-in vocabulary of letters and common words."""
    tokenizer = embedders.WordPiece({w: i for i, w in enumerate(WORDS)})
    return _embed_text(spark, sf).select("symbol_id", F.array_join(embedders.wordpiece_ids(F.col("text"), tokenizer).cast("array<string>"), " ").alias("ids"))


@query(f"SELECT id AS symbol_id, array_to_string({_SPLIT}, ' ') AS words FROM texts", texts=_TEXT)
def basic_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Words and marks of every symbol's embedding text, lower-cased."""

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(embedders.WordPiece.words(t)))

    return _embed_text(spark, sf).select("symbol_id", words("text").alias("words"))


def _model(spark: SparkSession) -> str:
    """A folder with a small static model: a vocabulary, and a tensor of half floats of four numbers a word."""
    folder = mounted(spark, scratch(spark, "model")) or "/nonexistent"
    os.makedirs(folder, exist_ok=True)
    i, d = np.meshgrid(np.arange(len(WORDS)), np.arange(4), indexing="ij")
    body = (((i * 7 + d * 3) % 11 - 5) / 8).astype("<f2").tobytes()
    head = json.dumps({"__metadata__": {"made": "here"}, "embeddings": {"dtype": "F16", "shape": [len(WORDS), 4], "data_offsets": [0, len(body)]}}).encode()
    for name, content in (("model.safetensors", len(head).to_bytes(8, "little") + head + body), ("vocab.txt", "\n".join(WORDS).encode()), ("config.json", b'{"normalize": false}')):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
    return folder


@query("SELECT id AS symbol_id, " + ", ".join(f"list_sum(list_transform(ids, lambda i: (i * 7 + {d * 3}) % 11 - 5))::BIGINT AS v{d}" for d in range(4)) + " FROM pieces", **_PIECES)
def static_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of every symbol's embedding text by a static model read from files, as the index and the search load it:
    the means, times the number of pieces, in eighths."""
    folder = _model(spark)
    embedder = embedders.load_embedder(f"static:{folder}")
    with open(os.path.join(folder, "vocab.txt"), encoding="utf-8") as f:
        tokenizer = embedders.WordPiece.from_lines(f.read())
    pieces = F.size(F.filter(embedders.wordpiece_ids(F.col("text"), tokenizer), lambda i: i > 0)) - 2
    rows = _embed_text(spark, sf).select("symbol_id", embedder.column(F.col("text")).alias("v"), pieces.alias("n"))
    return rows.select("symbol_id", *[F.round(F.col("v")[d].cast("double") * F.col("n") * 8).cast("long").alias(f"v{d}") for d in range(4)])


@query(
    "SELECT id AS symbol_id, array_to_string(list_transform(e, lambda x: round((x / n)::FLOAT::DOUBLE * 1e6)::BIGINT), ' ') AS embedding FROM (SELECT id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS n FROM raw)",
    texts=_TEXT,
    seeds="SELECT id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::BIGINT, 2))::HUGEINT)), lambda h, b: ((h - h % 256 + xor((h % 256)::INTEGER, b::INTEGER)) * 1099511628211) % 18446744073709551616) AS s FROM texts",
    steps="SELECT id, 0 AS d, s FROM seeds UNION ALL SELECT id, d + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM steps WHERE d < 128",
    raw="SELECT id, list(((CASE WHEN s // 4294967296 >= 2147483648 THEN s // 4294967296 - 4294967296 ELSE s // 4294967296 END)::FLOAT / 2147483647::FLOAT)::DOUBLE ORDER BY d) AS e FROM steps WHERE d > 0 GROUP BY id",
)
def mock_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of the hashing embedder for every symbol's embedding text, in millionths."""
    embedded = _embed_text(spark, sf).select("symbol_id", embedders.hash_embedding(F.col("text")).alias("e"))
    millionths = F.transform("e", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))
    return embedded.select("symbol_id", F.array_join(millionths, " ").alias("embedding"))


@query("SELECT bits, CASE WHEN e = 31 AND m > 0 THEN 'nan' WHEN e = 31 AND s = 1 THEN '-inf' WHEN e = 31 THEN 'inf' END AS special, CASE WHEN e < 31 THEN ((CASE WHEN s = 1 THEN -1 ELSE 1 END) * CASE WHEN e = 0 THEN m ELSE (1024 + m) * (1::BIGINT << (e - 1)) END)::BIGINT END AS units FROM (SELECT i::INTEGER AS bits, (i // 32768)::INTEGER AS s, (i // 1024 % 32)::INTEGER AS e, (i % 1024)::BIGINT AS m FROM range(0, 65536) t(i))")
def half_floats(spark: SparkSession, sf: str) -> DataFrame:
    """All 65,536 half floats as a tensor file holds them, in units of the smallest."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            body = batch.id.to_numpy().astype("<u2").tobytes()
            head = json.dumps({"x": {"dtype": "F16", "shape": [len(batch)], "data_offsets": [0, len(body)]}}).encode()
            with np.errstate(invalid="ignore"):  # signalling NaN
                x = tensors.float_tensor(tensors.read_tensors(len(head).to_bytes(8, "little") + head + body), "x").astype(float)
            special = np.where(np.isnan(x), "nan", np.where(x == np.inf, "inf", np.where(x == -np.inf, "-inf", None)))
            units = pd.array([None if s else int(v * 2**24) for s, v in zip(special, x)], "Int64")
            yield pd.DataFrame({"bits": batch.id.astype("int32"), "special": special, "units": units})

    return spark.range(1 << 16).mapInPandas(decode, "bits int, special string, units long")


# parameters and answers


@query("SELECT id, CASE WHEN k BETWEEN 1 AND 50 THEN k ELSE 10 END AS top_k, CASE WHEN s BETWEEN 0 AND 1 THEN s ELSE 0.3 END::DOUBLE AS least, greatest(0, least(3, d)) AS depth, CASE WHEN l <= 0 THEN 50 ELSE least(l, 200) END AS row_limit FROM (SELECT id, (id % 71 - 9)::INTEGER AS k, (id % 31 - 5)::DOUBLE / 20 AS s, (id % 9 - 2)::INTEGER AS d, (id % 307 - 20)::INTEGER AS l FROM rou)")
def request_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The rules for out-of-range parameters, over a table of calls."""

    @F.pandas_udf("top_k int, least double, depth int, row_limit int")
    def rules(k: pd.Series, s: pd.Series, d: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"top_k": [params.in_range_or(x, 1, 50, 10) for x in k], "least": [params.in_range_or(x, 0.0, 1.0, 0.3) for x in s], "depth": [params.clamp(x, 0, 3) for x in d], "row_limit": [params.limit_or(x, 50, 200) for x in n]})

    calls = view(spark, sf, "routes", ["id"]).select("id", F.expr("cast(id % 71 - 9 as int)").alias("k"), F.expr("cast(id % 31 - 5 as double) / 20").alias("s"), F.expr("cast(id % 9 - 2 as int)").alias("d"), F.expr("cast(id % 307 - 20 as int)").alias("n"))
    return calls.select("id", rules("k", "s", "d", "n").alias("p")).select("id", "p.*")


@query("SELECT id, unnest(CASE id % 4 WHEN 0 THEN [name] WHEN 1 THEN [name, qualified_name] WHEN 2 THEN ['[' || name] ELSE ['[1, \"' || name || '\"]'] END) AS name FROM sym")
def name_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Names as tools are given them: one name, a list in JSON, and what only looks like one."""

    @F.pandas_udf("array<string>")
    def listed(values: pd.Series) -> pd.Series:
        return values.map(params.string_or_list)

    n, q = F.col("name"), F.col("qualified_name")
    value = F.when(F.col("id") % 4 == 0, n).when(F.col("id") % 4 == 1, F.to_json(F.array(n, q))).when(F.col("id") % 4 == 2, F.concat(F.lit("["), n)).otherwise(F.concat(F.lit('[1, "'), n, F.lit('"]')))
    return symbols(spark, sf).select("id", F.explode(listed(value)).alias("name"))


@query("SELECT id, CASE WHEN kind = 'function' THEN code_block END AS code, CASE WHEN kind = 'function' THEN length(code_block) ELSE 0 END::INTEGER AS n FROM sym WHERE repo_name = $REPO")
def code_on_demand(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf, "code_block").where(F.col("repo_name") == REPO)
    code = scalars.code_if(F.col("kind") == "function", F.col("code_block"))
    return rows.select("id", code.alias("code"), F.coalesce(F.char_length(code), F.lit(0)).alias("n"))


@query("SELECT id, '{\"id\":' || id || ',\"kind\":\"' || kind || '\",\"lines\":[' || start_line || ',' || end_line || ']}' AS answer FROM sym")
def answers_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """One answer a row, as a tool's caller gets it."""
    return symbols(spark, sf).select("id", F.to_json(F.struct("id", "kind", F.array("start_line", "end_line").alias("lines"))).alias("answer"))


@query(
    "SELECT t.id AS symbol_id, t.name, t.file_path, CASE WHEN d.id IS NOT NULL THEN 'dependency' ELSE 'name_heuristic' END AS match_reason, t.code_block FROM sym t LEFT JOIN direct d ON d.id = t.id WHERE d.id IS NOT NULL",
    own="SELECT id, name, file_path FROM sym WHERE repo_name = $REPO AND kind IN ('function', 'method') AND (" + " OR ".join(f"file_path ILIKE '{p}'" for p in graph.TEST_PATHS) + " OR name ILIKE 'test_%' OR name ILIKE 'Test%')",
    root="SELECT callee_id AS id FROM dep JOIN own ON own.id = dep.caller_id GROUP BY callee_id ORDER BY count(*) DESC, callee_id LIMIT 1",
    direct="SELECT DISTINCT own.id FROM own JOIN dep ON dep.caller_id = own.id JOIN root ON root.id = dep.callee_id",
)
def tests_with_code(spark: SparkSession, sf: str) -> DataFrame:
    """The tests of the symbol that the most tests call, with their code."""
    rows, edges = symbols(spark, sf, "code_block"), view(spark, sf, "dependencies")
    tests = rows.where((F.col("repo_name") == REPO) & F.col("kind").isin("function", "method") & graph.is_test())
    root = edges.join(tests.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").groupBy(F.col("callee_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    found = graph.tests_for_symbol(edges, rows, REPO, root, "no such name")
    return found.join(rows.select(F.col("id").alias("symbol_id"), "code_block"), "symbol_id").select("symbol_id", "name", "file_path", "match_reason", "code_block")
