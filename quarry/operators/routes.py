"""HTTP routes: filtered listing, handlers, and scored matches of call sites with definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import params, scalars


def find(routes: DataFrame, repo: str, method: str = "", path: str = "", file_path: str = "", kind: str = "", limit: int | None = 50) -> DataFrame:
    """Routes by method (upper-cased), part of the pattern or normalised path, file and kind; by method, path and id.

    limit: 50 if 0 or less, 200 at most; None gives all of them.
    """
    rows = routes.where(F.col("repo_name") == repo)
    if method:
        rows = rows.where(F.col("method") == method.upper())
    if path:
        rows = rows.where(scalars.like_any(F.col("path_pattern"), path) | scalars.like_any(F.col("normalized_path"), path))
    if file_path:
        rows = rows.where(F.col("file_path") == file_path)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    ordered = rows.orderBy("method", "normalized_path", "id")
    return ordered if limit is None else ordered.limit(params.limit_or(limit, 50, 200))


def with_handler(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `handler`, the qualified name of the handler symbol, empty if there is none."""
    names = symbols.select(F.col("id").alias("handler_symbol_id"), F.col("qualified_name").alias("handler"))
    return routes.join(names, "handler_symbol_id", "left").withColumn("handler", F.coalesce("handler", F.lit("")))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)


def _shaped(routes: DataFrame, repo: str | None) -> DataFrame:
    rows = routes.where(F.col("normalized_path").isNotNull() & F.col("kind").isin("definition", "call_site"))
    if repo is not None:
        rows = rows.where(F.col("repo_name") == repo)
    return rows.select("repo_name", "id", "method", F.col("normalized_path").alias("path"), "kind")


def match_classes(routes: DataFrame, repo: str | None = None) -> DataFrame:
    """(repo_name, dm, dp, cm, cp, confidence, defs long, calls long): matches between classes of equal routes.

    A class is all definitions, or all call sites, of one repository, method and path: (dm, dp) and (cm, cp), with as
    many members as defs and calls say. Copies are never paired here; match() expands the classes.

    Methods must be equal, or one `*`. 1.0: equal normalised paths; 0.9: as many segments, each equal or one of the two a
    parameter (`:...`); 0.5: one path begins with the other as text. Other pairs drop out. A null path matches nothing.

    No pair is formed without a common key: 1.0 and 0.9 join on the number of segments and on each segment that is no
    parameter on either side (the last such of the call, against definitions with that word or a parameter
    there), 0.5 on prefixes of the paths. Only definitions and calls made of parameters alone meet by count.
    """
    # many routes of a repository repeat a (method, path): they are matched once and expanded at the end
    distinct = _shaped(routes, repo).withColumn("seg", _segments(F.col("path"))).groupBy("repo_name", "kind", "method", "path", "seg").agg(F.count(F.lit(1)).alias("copies"))
    d = distinct.where("kind = 'definition'").select("repo_name", F.col("method").alias("dm"), F.col("path").alias("dp"), F.col("seg").alias("ds"), F.col("copies").alias("defs"))
    c = distinct.where("kind = 'call_site'").select("repo_name", F.col("method").alias("cm"), F.col("path").alias("cp"), F.col("seg").alias("cs"), F.col("copies").alias("calls"))
    methods = (F.col("dm") == F.col("cm")) | (F.col("dm") == "*") | (F.col("cm") == "*")
    fits = F.forall(F.zip_with("ds", "cs", lambda x, y: (x == y) | F.startswith(x, F.lit(":")) | F.startswith(y, F.lit(":"))), lambda x: x)

    # the key of a segmentwise match: (count, 0-based position, word) of the last plain word of the call, since paths share
    # their first words; a definition offers its own words, and `:` at every position where it has a parameter
    def key(n: Column, i: Column, w: Column) -> Column:
        return F.concat_ws("\x1f", n.cast("string"), i.cast("string"), w)

    numbered_c = F.filter(F.transform("cs", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: ~F.startswith(s["w"], F.lit(":")))
    call = c.withColumn("plain", F.get(numbered_c, F.size(numbered_c) - 1))
    n_c, n_d = F.size("cs"), F.size("ds")
    with_word = call.where("plain is not null").withColumn("k", F.explode(F.array(key(n_c, F.col("plain.i"), F.col("plain.w")), key(n_c, F.col("plain.i"), F.lit(":")))))
    offers = F.transform("ds", lambda w, i: key(n_d, i, F.when(F.startswith(w, F.lit(":")), F.lit(":")).otherwise(w)))
    by_word = d.withColumn("k", F.explode(offers)).join(with_word, ["repo_name", "k"]).where(methods & fits)
    without = call.where("plain is null").withColumn("n", n_c)
    by_count = d.withColumn("n", n_d).join(without, ["repo_name", "n"]).where(methods & fits)
    pair = ["repo_name", "dm", "dp", "cm", "cp", "defs", "calls"]
    segmentwise = by_word.select(*pair).unionByName(by_count.select(*pair)).withColumn("confidence", F.when(F.col("dp") == F.col("cp"), 1.0).otherwise(0.9))

    def prefixes(side: DataFrame, path: str) -> DataFrame:
        return side.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.char_length(path)), lambda n: F.substring(F.col(path), F.lit(1), n))))

    d_short = d.join(prefixes(c, "cp"), (d.repo_name == c.repo_name) & (F.col("dp") == F.col("k"))).where(methods).select(d.repo_name, *pair[1:])
    c_short = c.join(prefixes(d, "dp"), (d.repo_name == c.repo_name) & (F.col("cp") == F.col("k"))).where(methods).select(c.repo_name, *pair[1:])
    textual = d_short.unionByName(c_short).withColumn("confidence", F.lit(0.5))
    best = segmentwise.unionByName(textual).groupBy(*pair).agg(F.max("confidence").alias("confidence"))
    return best.select(*pair[:5], "confidence", "defs", "calls")


def match(routes: DataFrame, repo: str | None = None) -> DataFrame:
    """(repo_name, def_id, call_id, confidence double): match_classes() expanded, one row a pair of routes.

    The output holds every pair; where copies are many, take the classes. A class's members are spread over salts, so
    no task holds all of one.
    """
    salts = 16
    ids = _shaped(routes, repo).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    defs = ids.where("kind = 'definition'").select("repo_name", F.col("method").alias("dm"), F.col("path").alias("dp"), F.col("id").alias("def_id"), "salt")
    calls = ids.where("kind = 'call_site'").select("repo_name", F.col("method").alias("cm"), F.col("path").alias("cp"), F.col("id").alias("call_id"), "salt")
    classes = match_classes(routes, repo).drop("defs", "calls")
    left = classes.withColumn("salt", every).join(defs, ["repo_name", "dm", "dp", "salt"]).drop("salt")
    return left.withColumn("salt", every).join(calls, ["repo_name", "cm", "cp", "salt"]).select("repo_name", "def_id", "call_id", "confidence")
