"""Table schemas and the fixed vocabularies of the model."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType())}


def _struct(text: str) -> T.StructType:
    """A schema from `name type, ...`, without needing a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(","))])


FILES = _struct("id long, repo_name string, path string, content_hash string, last_indexed timestamp, size_bytes long")
SYMBOLS = _struct(
    "id long, repo_name string, name string, qualified_name string, kind string, file_path string, content_hash string,"
    " code_block string, start_line int, end_line int, language string, indexed_at timestamp"
)
DEPENDENCIES = _struct("caller_id long, callee_id long, kind string")
MEMORIES = _struct(
    "id long, symbol_id long, note string, author string, is_stale boolean, stale_reason string, last_known_symbol string,"
    " last_known_file string, created_at timestamp, updated_at timestamp"
)
VECTORS = _struct("symbol_id long, repo_name string, embedding array<float>")
ROUTES = _struct(
    "id long, repo_name string, method string, path_pattern string, normalized_path string, handler_symbol_id long,"
    " file_path string, start_line int, framework string, kind string, indexed_at timestamp"
)
HUNKS = _struct("repo_name string, file_path string, start_line int, line_count int")
EVENTS = _struct("path string, ts timestamp, op string")
RAW_EDGES = _struct("file_path string, kind string, symbol string")

POSTINGS = _struct("term string, symbol_id long, repo_name string, file_path string, column int, place int")
LENGTHS = _struct("symbol_id long, repo_name string, file_path string, length long")

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "dependencies": DEPENDENCIES, "memories": MEMORIES, "vec_symbols": VECTORS, "routes": ROUTES, "fts_postings": POSTINGS, "fts_lengths": LENGTHS,
}
#: The layout of the stored tables; a store of an older one is brought up to it.
SCHEMA_VERSION = 2

SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "variable")
EDGE_KINDS = ("call", "extends", "implements")
AUTHORS = ("agent", "developer")
HASH_CHANGED, SYMBOL_DELETED = "hash_changed", "symbol_deleted"

#: Numbers of an embedding.
DIMENSION = 128
#: Files above this are not indexed.
MAX_FILE_BYTES = 1 << 20
#: Characters of a note.
MAX_NOTE = 2000
