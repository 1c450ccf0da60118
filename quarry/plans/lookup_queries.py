"""Scans, filters, counts and scalar functions as registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import diff, lookup, mutations
from ..session import spread, table
from ..sources import markdown, walk
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


@query("SELECT id, path, content_hash, size_bytes FROM fil WHERE repo_name = $REPO")
def files_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.list_files(view(spark, sf, "files", ["id", "repo_name", "path", "content_hash", "size_bytes"]), REPO).drop("repo_name")


@query("SELECT path, content_hash, size_bytes FROM fil WHERE repo_name = $REPO AND path = (SELECT min(path) FROM fil WHERE repo_name = $REPO)")
def file_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files", ["repo_name", "path", "content_hash", "size_bytes"])
    path = files.where(F.col("repo_name") == REPO).agg(F.min("path")).first()[0] or ""  # the parameter of the lookup
    return lookup.file_by_path(files, REPO, path).drop("repo_name")


@query("SELECT path, content_hash FROM fil WHERE repo_name = $REPO")
def hash_index(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.hash_index(view(spark, sf, "files", ["repo_name", "path", "content_hash"]), REPO)


@query(
    "SELECT path, size_bytes FROM fil WHERE size_bytes <= 1048576 AND regexp_matches(path, '\\.(ts|tsx|jsx|go|py|js|mjs|rs|java|c|h|cpp|hpp|cc|cxx|hxx|hh|cs)$')"
    " AND NOT regexp_matches(path, '(^|/)(node_modules|dist|build|\\.git|\\.next|\\.nuxt|coverage|__pycache__|vendor)/')"
    " AND NOT (path LIKE 'generated/%') AND NOT regexp_matches(path, '(^|/)[^/]*_test\\.go(/|$)')"
)
def file_size_limit_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which files a scan would index, with two ignore lines."""
    files = view(spark, sf, "files", ["path", "size_bytes"])
    return files.where(walk.indexable(F.col("path"), F.col("size_bytes"), ["generated/", "*_test.go"]))


@query("SELECT path, coalesce(CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' END, '?') AS language FROM fil")
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files", ["path"]).select("path", F.coalesce(walk.language(F.col("path")), F.lit("?")).alias("language"))


@query("SELECT id, name, start_line FROM sym WHERE repo_name = $REPO AND file_path = (SELECT min(file_path) FROM sym WHERE repo_name = $REPO)")
def symbols_by_file_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf)
    path = table(spark, sf, "symbols").where(F.col("repo_name") == REPO).agg(F.min("file_path")).first()[0] or ""
    return lookup.symbols_of_file(rows, REPO, path).select("id", "name", "start_line")


@query("SELECT id, qualified_name FROM sym WHERE repo_name = $REPO AND id IN (SELECT symbol_id FROM mem)")
def symbols_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "memories", ["id", "symbol_id"]).where("symbol_id is not null").select(F.col("symbol_id").alias("id"))
    return lookup.symbols_by_ids(symbols(spark, sf), REPO, ids).select("id", "qualified_name")


@query("SELECT file_path, count(*)::BIGINT AS n, string_agg(name, ',' ORDER BY start_line, id) AS names FROM sym WHERE repo_name = $REPO GROUP BY file_path")
def symbols_by_repo_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.outline(symbols(spark, sf), REPO)


@query("SELECT key, max(id) AS id FROM (SELECT name AS key, id FROM sym WHERE repo_name = $REPO UNION ALL SELECT qualified_name, id FROM sym WHERE repo_name = $REPO) WHERE key IS NOT NULL GROUP BY key")
def name_index(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.name_index(symbols(spark, sf), REPO)


@query("SELECT file_path, arg_min(id, start_line * 10000000000 + id) AS id FROM sym WHERE repo_name = $REPO GROUP BY file_path")
def first_symbol_of_file(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_symbols(symbols(spark, sf).where(F.col("repo_name") == REPO)).select("file_path", "id")


@query("SELECT caller_id, callee_id, kind FROM dep WHERE caller_id = (SELECT min(caller_id) FROM dep)")
def edges_by_caller(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "dependencies")
    return lookup.edges_of(edges, table(spark, sf, "dependencies").agg(F.min("caller_id")).first()[0] or 0)


@query("SELECT caller_id, callee_id, kind FROM dep WHERE callee_id = (SELECT min(callee_id) FROM dep)")
def edges_by_callee(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "dependencies")
    return lookup.edges_of(edges, table(spark, sf, "dependencies").agg(F.min("callee_id")).first()[0] or 0, "callee_id")


@query("SELECT DISTINCT kind FROM dependencies")
def edge_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dependencies").select("kind").distinct()


@query("SELECT id, name, kind FROM sym WHERE repo_name = $REPO AND kind = 'type'")
def kind_filter(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where((F.col("repo_name") == REPO) & (F.col("kind") == "type")).select("id", "name", "kind")


@query("SELECT id, file_path FROM sym WHERE file_path LIKE 'src/%'")
def path_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where(F.startswith("file_path", F.lit("src/"))).select("id", "file_path")


@query("SELECT id, name FROM sym WHERE name ILIKE '%le_ger%'")
def ilike_search(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where(scalars.like_any(F.col("name"), "le_ger")).select("id", "name")


@query("SELECT id, name FROM sym WHERE NOT regexp_matches(name, '^[A-Z]')")
def glob_exported_filter(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where(lookup.unexported(F.col("name"))).select("id", "name")


@query("SELECT repo_name, count(*)::BIGINT AS symbols FROM sym GROUP BY repo_name")
def count_symbols_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.count_symbols(symbols(spark, sf))


@query("SELECT symbol_id, count(*)::BIGINT AS memories FROM mem WHERE symbol_id IS NOT NULL GROUP BY symbol_id")
def memory_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.count_memories(view(spark, sf, "memories", ["id", "symbol_id"]))


@query(
    "SELECT (t + 3) // 4 AS file_tokens, 250 AS response_tokens, greatest(0, (t + 3) // 4 - 250) AS saved,"
    " CASE WHEN greatest(0, (t + 3) // 4 - 250) * 3.0 / 1000000 < 0.01 THEN '$0.00' ELSE printf('$%.2f', greatest(0, (t + 3) // 4 - 250) * 3.0::DOUBLE / 1000000) END AS cost_avoided FROM total",
    total="SELECT coalesce(sum(size_bytes), 0)::BIGINT AS t FROM fil WHERE repo_name = $REPO AND path IN (SELECT file_path FROM sym WHERE repo_name = $REPO AND name ILIKE '%ledger%')",
)
def token_savings(spark: SparkSession, sf: str) -> DataFrame:
    paths = symbols(spark, sf).where((F.col("repo_name") == REPO) & scalars.like_any(F.col("name"), "ledger"))
    return lookup.savings(lookup.file_bytes(paths, view(spark, sf, "files", ["repo_name", "path", "size_bytes"]), REPO), 1000)


@query("SELECT event_id, user_id, sum(greatest(floor(value)::BIGINT, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def session_running_total(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select("event_id", "user_id", "ts", F.floor("value").alias("saved"))
    return mutations.running_total(calls, "user_id", ["ts", "event_id"], "saved").select("event_id", "user_id", "total")


@query("SELECT repo_name, count(*) FILTER (WHERE handler_symbol_id IS NOT NULL)::BIGINT AS successes, count(*) FILTER (WHERE handler_symbol_id IS NULL)::BIGINT AS errors FROM rou GROUP BY repo_name")
def batch_success_counts(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "routes", ["id", "repo_name", "handler_symbol_id"]).withColumn("error", F.when(F.col("handler_symbol_id").isNull(), "no handler"))
    return mutations.batch_counts(items, "repo_name")


_DISK = "SELECT path, CASE WHEN id % 7 = 0 THEN concat(content_hash, 'x') ELSE content_hash END AS content_hash FROM fil WHERE repo_name = $REPO AND id % 11 <> 0"
_STORED = "SELECT path, content_hash FROM fil WHERE repo_name = $REPO AND id % 10 <> 0"
_STATES = "SELECT coalesce(d.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'deleted' WHEN d.content_hash IS NOT DISTINCT FROM s.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM disk d FULL JOIN stored s ON d.path = s.path"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a repository made from one table: ids by 11 are gone, by 10 are new, by 7 have changed."""
    own = view(spark, sf, "files", ["id", "repo_name", "path", "content_hash"]).where(F.col("repo_name") == REPO)
    hashed = F.when(F.col("id") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    disk = own.where("id % 11 <> 0").select("path", hashed.alias("content_hash"))
    return diff.incremental(disk, own.where("id % 10 <> 0").select("path", "content_hash"))


@query(_STATES, disk=_DISK, stored=_STORED)
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf)


@query(
    "SELECT count(*) FILTER (WHERE state <> 'deleted')::BIGINT AS scanned, count(*) FILTER (WHERE state = 'new')::BIGINT AS \"new\", count(*) FILTER (WHERE state = 'changed')::BIGINT AS changed,"
    " count(*) FILTER (WHERE state = 'unchanged')::BIGINT AS unchanged, count(*) FILTER (WHERE state = 'deleted')::BIGINT AS deleted FROM states",
    disk=_DISK, stored=_STORED, states=_STATES,
)
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return diff.index_stats(_states(spark, sf))


# scalar functions


@query("SELECT id, regexp_replace(path_pattern, ':[a-zA-Z_]\\w*|\\{[^}]+\\}', ':param', 'g') AS normalized FROM rou")
def normalize_path(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "routes", ["id", "path_pattern"]).select("id", scalars.normalize_path(F.col("path_pattern")).alias("normalized"))


@query("SELECT id, split_part(code_block, chr(10), 1) AS signature FROM sym")
def signature_first_line(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf, "code_block").select("id", scalars.signature(F.col("code_block")).alias("signature"))


@query("SELECT id, sha256(code_block) AS hash FROM sym")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf, "code_block").select("id", scalars.content_hash(F.col("code_block")).alias("hash"))


@query(
    "SELECT id, array_to_string((list_sort(list_distinct(list_filter(list_transform(list_concat(body, types, initial), lambda w: lower(w)), lambda w: octet_length(encode(w)) > 2))))[1:30], ' ') AS keywords FROM raw",
    raw="""SELECT id, CASE WHEN kind IN ('function', 'method') THEN list_concat(regexp_extract_all(code_block, '[A-Z][a-zA-Z]*(?:Error|Exception|Timeout|Failure)'),
      regexp_extract_all(code_block, '(?:except|catch|rescue)\\s+\\(?([A-Za-z_][\\w.]*)', 1),
      list_filter(['retry', 'fallback', 'timeout', 'backoff', 'cache', 'throttle', 'circuit_breaker', 'rate_limit', 'rollback', 'compensate'], lambda b: contains(lower(code_block), b))) ELSE [] END AS body,
      list_filter(regexp_extract_all(split_part(code_block, chr(10), 1), '\\b[A-Z][a-zA-Z0-9]+\\b'), lambda w: w NOT IN ('Func', 'True', 'False', 'None', 'String', 'Int', 'Bool', 'Float')) AS types,
      CASE WHEN kind IN ('variable', 'constant') THEN list_filter(list_transform(regexp_extract_all(code_block, '\\b[a-zA-Z][a-zA-Z0-9_]{2,}\\b'), lambda w: lower(w)),
      lambda w: w NOT IN ('var', 'const', 'let', 'new', 'nil', 'null', 'true', 'false', 'string', 'int', 'bool', 'float')) ELSE [] END AS initial FROM sym""",
)
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return symbols(spark, sf, "code_block").select("id", scalars.keywords(F.col("code_block"), F.col("kind"), none).alias("keywords"))


@query("SELECT id, kind || ' ' || qualified_name || ': ' || regexp_replace(split_part(code_block, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS text FROM sym")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf, "code_block").select("id", scalars.embed_text(F.col("kind"), F.col("qualified_name"), F.col("code_block")).alias("text"))


@query("SELECT id, CASE WHEN size_bytes > 0 THEN (size_bytes + 3) // 4 ELSE 0 END AS tokens, CASE WHEN size_bytes > 0 AND ((size_bytes + 3) // 4) * 3.0::DOUBLE / 1000000 >= 0.01 THEN printf('$%.2f', ((size_bytes + 3) // 4) * 3.0::DOUBLE / 1000000) ELSE '$0.00' END AS cost FROM fil")
def estimate_tokens_cost(spark: SparkSession, sf: str) -> DataFrame:
    tokens = scalars.estimate_tokens(F.col("size_bytes"))
    return view(spark, sf, "files", ["id", "size_bytes"]).select("id", tokens.alias("tokens"), scalars.format_cost(tokens).alias("cost"))


_GOOD = "SELECT symbol_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vec WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0"


@query("SELECT symbol_id, round(CASE WHEN list_inner_product(e, e) < 1e-24 THEN 0 ELSE list_sum(list_transform(range(1, len(e) + 1), lambda i: i * e[i])) / sqrt(list_inner_product(e, e)) END, 6) AS weighed FROM good", good=_GOOD)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """All components of every unit vector, summed by position."""
    good = view(spark, sf, "vec_symbols").where(F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnan))
    weighed = F.aggregate(F.transform("u", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return good.select("symbol_id", scalars.l2_normalize(F.col("embedding")).alias("u")).select("symbol_id", F.round(weighed, 6).alias("weighed"))


@query("SELECT g.symbol_id, round(CASE WHEN len(g.e) = len(q.e) THEN list_inner_product(g.e, q.e) ELSE 0 END, 4) AS product FROM good g, (SELECT e FROM good WHERE len(e) = 128 ORDER BY symbol_id LIMIT 1) q", good=_GOOD)
def dot_mismatch_zero(spark: SparkSession, sf: str) -> DataFrame:
    from .search_queries import query_vector

    good = view(spark, sf, "vec_symbols").where(F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnan))
    literal = F.array(*[F.lit(x) for x in query_vector(spark, sf)])
    return good.select("symbol_id", F.round(scalars.dot(F.col("embedding"), literal), 4).alias("product"))


@query("SELECT DISTINCT query_id, '\"' || replace(query_text, '\"', '\"\"') || '\"' AS phrase FROM fts_results")
def sanitize_fts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fts_results").select("query_id", scalars.phrase(F.col("query_text")).alias("phrase")).distinct()


@query("SELECT id, CASE WHEN author IN ('agent', 'developer') THEN author ELSE 'agent' END AS author, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created FROM mem")
def author_and_time(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "memories", ["id", "author", "created_at"]).select("id", scalars.author(F.col("author")).alias("author"), scalars.iso_time(F.col("created_at")).alias("created"))


# table functions


@query(
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INTEGER - 1 AS position, title, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM cut WHERE title <> '' OR n > 0",
    lines="SELECT doc_id, t.line, t.ord FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, ord) WHERE regexp_matches(text, '\\S')",
    grouped="SELECT doc_id, line, ord, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM lines",
    cut="SELECT doc_id, g, coalesce(max(CASE WHEN line LIKE '## %' THEN substr(line, 4) END), '') AS title, count(*) FILTER (WHERE line NOT LIKE '## %') AS n, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE line NOT LIKE '## %'), '') AS content FROM grouped GROUP BY doc_id, g",
)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.sections(table(spark, sf, "documents"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))::INTEGER AS words FROM documents WHERE text IS NOT NULL")
def tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.fulltext import terms

    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(terms(F.col("text"))).alias("words"))
