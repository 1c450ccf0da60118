"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import AUTHORS

# Fixed values of keyword extraction.
ERROR_TYPE = r"[A-Z][a-zA-Z]*(?:Error|Exception|Timeout|Failure)"
CATCH_TARGET = r"(?:except|catch|rescue)\s+\(?([A-Za-z_][\w.]*)"
BEHAVIOURS = ["retry", "fallback", "timeout", "backoff", "cache", "throttle", "circuit_breaker", "rate_limit", "rollback", "compensate"]
NOT_TYPES = ["Func", "True", "False", "None", "String", "Int", "Bool", "Float"]
NOT_NAMES = ["var", "const", "let", "new", "nil", "null", "true", "false", "string", "int", "bool", "float"]
MAX_KEYWORDS = 30

# Fixed values of the token estimate: bytes of a token, dollars of a million tokens.
BYTES_PER_TOKEN, DOLLARS_PER_MILLION = 4, 3.0


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(text, 256)


def signature(code: Column) -> Column:
    """What stands before the first line end, untrimmed."""
    return F.substring_index(code, "\n", 1)


def embed_text(kind: Column, qualified_name: Column, code: Column, keywords: Column | None = None) -> Column:
    """`kind qualified_name: first line` and, if there are keywords, ` [keywords]`."""
    first = F.regexp_replace(signature(code), r"^\s+|\s+$", "")
    text = F.concat(kind, F.lit(" "), qualified_name, F.lit(": "), first)
    if keywords is None:
        return text
    return F.concat(text, F.when(keywords != "", F.concat(F.lit(" ["), keywords, F.lit("]"))).otherwise(""))


def normalize_path(path: Column) -> Column:
    """`:id` and `{id}` become `:param`; numbers and query strings stay."""
    return F.regexp_replace(path, r":[a-zA-Z_]\w*|\{[^}]+\}", ":param")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def keywords(code: Column, kind: Column, callees: Column) -> Column:
    """Up to 30 sorted lower-case words of more than two bytes that describe a symbol, joined by spaces.

    From error types, catch targets and behaviours in functions and methods; the callees' names; type names in the first
    line; names in the initialisers of variables.
    """
    none = F.array().cast("array<string>")
    lowered = F.lower(code)
    behaviours = F.filter(F.array(*[F.lit(b) for b in BEHAVIOURS]), lambda b: F.contains(lowered, b))
    body = F.when(kind.isin("function", "method"), F.concat(_all(code, ERROR_TYPE), _all(code, CATCH_TARGET, 1), behaviours)).otherwise(none)
    types = F.array_except(_all(signature(code), r"\b[A-Z][a-zA-Z0-9]+\b"), F.array(*[F.lit(w) for w in NOT_TYPES]))
    names = F.transform(_all(code, r"\b[a-zA-Z][a-zA-Z0-9_]{2,}\b"), F.lower)
    initial = F.when(kind.isin("variable", "constant"), F.array_except(names, F.array(*[F.lit(w) for w in NOT_NAMES]))).otherwise(none)
    words = F.transform(F.concat(body, F.coalesce(callees, none), types, initial), F.lower)
    chosen = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > 2)))
    return F.array_join(F.slice(chosen, 1, MAX_KEYWORDS), " ")


def estimate_tokens(size: Column) -> Column:
    """Bytes over four, rounded up; 0 for none or fewer."""
    return F.when(size > 0, F.ceil(size / BYTES_PER_TOKEN)).otherwise(0).cast("long")


def saved_tokens(file_bytes: Column, response_bytes: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), estimate_tokens(file_bytes) - estimate_tokens(response_bytes))


def format_cost(tokens: Column) -> Column:
    cost = tokens * F.lit(DOLLARS_PER_MILLION) / F.lit(1_000_000)
    return F.when(cost < 0.01, F.lit("$0.00")).otherwise(F.format_string("$%.2f", cost))


def author(name: Column) -> Column:
    """`agent` or `developer`; anything else, null too, is `agent`."""
    return F.when(name.isin(*AUTHORS), name).otherwise("agent")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; 0 if the lengths differ or either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(a) == F.size(b), total), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """The vector at length one; one shorter than 1e-12 stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # through an array of one, so that the norm is computed once a vector and not once a component
    return F.transform(F.array(norm), lambda n: F.when(n < 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n)))[0]


def code_if(wanted: Column, code: Column) -> Column:
    """The code if it is wanted, else null."""
    return F.when(wanted, code)


def phrase(query: Column) -> Column:
    """A full-text query as one quoted phrase, as params.phrase() does for a single one."""
    return F.concat(F.lit('"'), F.replace(query, F.lit('"'), F.lit('""')), F.lit('"'))


def like_any(text: Column, part: str) -> Column:
    """Case-insensitive LIKE '%part%'; `%` and `_` in part are wildcards, a backslash is itself."""
    return text.ilike("%" + part.replace("\\", "\\\\") + "%")


def like_prefix(text: Column, part: str) -> Column:
    return text.ilike(part.replace("\\", "\\\\") + "%")


def exported(name: Column) -> Column:
    """Does the name begin with an ASCII capital?"""
    return name.rlike("^[A-Z]")


def iso_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def change_type(status: Column, symbol_lines: Column, changed: Column) -> Column:
    """added, deleted or modified; a symbol of which every line changed counts as added."""
    return F.when(status == "A", "added").when(status == "D", "deleted").when(changed >= symbol_lines, "added").otherwise("modified")
