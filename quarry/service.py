"""The engine's service: one method for each of its seventeen tools, answers as plain dictionaries.

Bad input gives {"error": ...}, never an exception; batch tools give an error for each item. The work is distributed, the
answer is collected: at most MAX_ROWS rows of a list, and an answer that leaves out more says `truncated`. Counts beside
a list are of all there is. The sections of a document are all given: they are no more than the text that was read here.
"""

from __future__ import annotations

import functools
import json
import os
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import __version__
from .functions import params, scalars
from .functions.embedders import Embedder, load_embedder
from .index_job import index
from .operators import diff, fulltext, graph, lookup, memories, routes, search
from .session import staged
from .sources import gitdiff
from .store import Store

TIMEOUT_S, REINDEX_TIMEOUT_S = 30, 300
#: Rows of one list in an answer.
MAX_ROWS = 10_000
MEMORY_TOOLS = ["save_symbol_memory", "get_symbol_memories", "purge_stale_memories"]
TOOLS = ["ping", "reindex_project", "get_modified_symbols", "get_tests_for_symbol", "read_architecture_rules", "get_code_by_symbol", "semantic_search_symbols", "get_file_skeleton", "get_symbol_usages", "get_call_tree", "find_dead_code", "get_blast_radius", "find_http_routes", "search_code_patterns", *MEMORY_TOOLS]


class ToolError(ValueError):
    """Input that a tool refuses."""


def enabled(tool: str, allowed: tuple[str, ...] = ()) -> bool:
    """An empty list allows all tools; any of the three note tools allows their group."""
    if not allowed:
        return True
    return any(t in allowed for t in MEMORY_TOOLS) if tool in MEMORY_TOOLS else tool in allowed


def tool(timeout_s: int = TIMEOUT_S):
    """Runs a method under a job tag that is interrupted when its time is over; adds the time taken."""

    def wrap(f: Callable[..., dict]) -> Callable[..., dict]:
        @functools.wraps(f)
        def run(self: Service, *args, **kwargs) -> dict:
            if not enabled(f.__name__, self.tools):
                return {"error": f"{f.__name__}: tool is not enabled"}
            began, tag = time.time(), f"quarry-{uuid.uuid4().hex[:8]}"
            self.spark.addTag(tag)
            timer = threading.Timer(timeout_s, lambda: self.spark.interruptTag(tag))
            timer.start()
            try:
                answer = f(self, *args, **kwargs)
            except (ToolError, ValueError) as e:
                return {"error": f"{f.__name__}: {e}"}
            except Exception as e:  # noqa: BLE001 - a failed job is an answer too
                if time.time() - began >= timeout_s:
                    return {"error": f"{f.__name__}: took longer than {timeout_s} s"}
                return {"error": f"{f.__name__}: {type(e).__name__}: {str(e)[:300]}"}
            finally:
                timer.cancel()
                self.spark.removeTag(tag)
            answer.setdefault("metadata", {})["timing_ms"] = int((time.time() - began) * 1000)
            return answer

        return run

    return wrap


class Service:
    """Tools over the stored tables of one repository."""

    def __init__(self, spark: SparkSession, store: Store, root: str, repo: str, tools: tuple[str, ...] = (), embedder: str | Embedder = "hash"):
        self.spark, self.store, self.root, self.repo, self.tools = spark, store, root, repo, tools
        self.embedder = load_embedder(embedder) if isinstance(embedder, str) else embedder
        self.cache = search.VectorCache()
        self.session_saved = 0

    # shared parts

    @property
    def symbols(self) -> DataFrame:
        return self.store.read("symbols", self.repo)

    @property
    def edges(self) -> DataFrame:
        return self.store.read("dependencies", self.repo)

    def _rows(self, df: DataFrame, most: int = MAX_ROWS) -> list[dict]:
        """The first rows of a list; what ends a longer one is a row {"truncated": True}, which _list() takes off."""
        found = [r.asDict(recursive=True) for r in df.take(most + 1)]
        return found if len(found) <= most else [*found[:most], {"truncated": True}]

    def _list(self, answer: dict, name: str, df: DataFrame) -> list[dict]:
        found = self._rows(df)
        if found and "truncated" in found[-1]:
            found.pop()
            answer["truncated"] = True
        answer[name] = found
        return found

    def _inside(self, path: str) -> str:
        """The file's place, if it exists and lies under the root."""
        full = os.path.realpath(os.path.join(self.root, path))
        if not full.startswith(os.path.realpath(self.root) + os.sep) or not os.path.isfile(full):
            raise ToolError(f"file {path!r} does not exist")
        return full

    def _resolve(self, name: str) -> DataFrame:
        if not name or not name.strip():
            raise ToolError("symbol_name is required")
        found = search.resolve(self.symbols, self.repo, name)
        if found.isEmpty():
            raise ToolError(f"symbol {name!r} was not found")
        return found

    def _with_savings(self, answer: dict, paths: set[str], response_bytes: int | None = None) -> dict:
        size = 0
        if paths:
            named = self.spark.createDataFrame([(p,) for p in sorted(paths)], "file_path string")
            size = lookup.file_bytes(named, self.store.read("files", self.repo), self.repo).first()[0]
        sent = len(json.dumps(answer, default=str).encode()) if response_bytes is None else response_bytes
        tokens = lambda n: -(-n // scalars.BYTES_PER_TOKEN) if n > 0 else 0
        saved = max(0, tokens(size) - tokens(sent))
        self.session_saved += saved
        cost = lambda n: f"${c:.2f}" if (c := n * scalars.DOLLARS_PER_MILLION / 1e6) >= 0.01 else "$0.00"
        answer["metadata"] = {"tokens_saved": saved, "cost_avoided": cost(saved), "session_tokens_saved": self.session_saved, "session_cost_avoided": cost(self.session_saved)}
        return answer

    # tools

    @tool()
    def ping(self) -> dict:
        return {"status": "ok", "version": __version__, "repo_name": self.repo, "symbols": self.symbols.count()}

    @tool(REINDEX_TIMEOUT_S)
    def reindex_project(self, force: bool = False) -> dict:
        stats = vars(index(self.spark, self.root, self.repo, self.store, force, self.embedder)).copy()
        self.store.vacuum()
        self.cache.invalidate(self.repo)
        return stats

    def flush(self, paths: DataFrame, number: int = 0) -> None:
        """What a watcher calls with the paths(path) of a quiet moment: they alone are indexed."""
        index(self.spark, self.root, self.repo, self.store, embed=self.embedder, only=paths)
        self.cache.invalidate(self.repo)

    @tool()
    def get_modified_symbols(self, base_ref: str = "HEAD", include_staged: bool = True) -> dict:
        files, hunks = gitdiff.diff_tables(self.spark, self.root, self.repo, base_ref, include_staged)
        answer = {"base_ref": base_ref}
        found = self._list(answer, "symbols", diff.modified_symbols(self.symbols, hunks, files).orderBy("file_path", "start_line", "symbol_id"))
        return answer | {"symbol_count": len(found)}

    @tool()
    def get_tests_for_symbol(self, symbol_name: str, include_code: bool = False) -> dict:
        target = self._resolve(symbol_name)
        tests = graph.tests_for_symbol(self.edges, self.symbols, self.repo, target, symbol_name)
        if include_code:
            tests = tests.join(self.symbols.select(F.col("id").alias("symbol_id"), "code_block"), "symbol_id").orderBy("file_path", "start_line", "symbol_id")
        answer = {"symbol": symbol_name}
        found = self._list(answer, "tests", tests)
        return answer | {"test_count": len(found)}

    @tool()
    def read_architecture_rules(self, name: str = "ARCHITECTURE.md") -> dict:
        from .sources.markdown import sections

        with open(self._inside(name), encoding="utf-8", errors="replace") as f:
            text = self.spark.createDataFrame([(0, f.read())], "doc_id int, text string")
        cut = sections(text.coalesce(1)).orderBy("position").select("title", "content").collect()  # no more than the text itself
        return {"file": name, "sections": [r.asDict() for r in cut]}

    @tool()
    def get_code_by_symbol(self, symbol_name, depth: int = 1) -> dict:
        """One item a name: its symbol, the symbols it depends on up to depth (clamped to 0..3), and its notes.

        All names are resolved, traversed and joined at once, so a batch takes as many jobs as one name.
        """
        names, depth = params.string_or_list(symbol_name), params.clamp(depth, 0, graph.MAX_DEPTH)
        asked = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names) if n.strip()], "input string")
        ids = {r.input: r.id for r in search.resolve_many(self.symbols, self.repo, asked).collect() if r.id is not None}
        roots = self.spark.createDataFrame([(i,) for i in sorted(set(ids.values()))], "id long")
        own = {r["id"]: r for r in self._rows(lookup.symbols_by_ids(self.symbols, self.repo, roots))}
        deps: dict[int, list] = {}
        notes: dict[int, list] = {}
        answer: dict = {}
        if own:
            reached = graph.bfs_many(self.edges, roots, depth).where("root <> node").select("root", F.col("node").alias("id"), "depth")
            for r in self._list(answer, "rows", self.symbols.join(reached, "id").orderBy("root", "depth", "id")):
                deps.setdefault(r.pop("root"), []).append(r)
            for r in self._list(answer, "rows", memories.of_symbols(self.store.read("memories"), roots)):
                notes.setdefault(r["symbol_id"], []).append(r)
            answer.pop("rows")
        items, paths = [], set()
        for name in names:
            if ids.get(name) not in own:
                items.append({"input": name, "error": f"symbol {name!r} was not found"})
                continue
            i = ids[name]
            items.append({"input": name, "data": {"symbol": own[i], "dependencies": deps.get(i, []), "memories": notes.get(i, [])}})
            paths |= {own[i]["file_path"], *(d["file_path"] for d in deps.get(i, []))}
        good = sum("data" in i for i in items)
        return self._with_savings(answer | {"results": items, "success_count": good, "error_count": len(items) - good}, paths)

    @tool()
    def semantic_search_symbols(self, query: str, top_k: int = 10, kind: str = "", file_path_prefix: str = "", min_similarity: float = 0.3, compatible: bool = False) -> dict:
        if not query or not query.strip():
            raise ToolError("query is required")
        top_k = params.in_range_or(top_k, 1, 50, 10)
        least = params.in_range_or(min_similarity, 0.0, 1.0, 0.3)
        made = self.store.meta(f"embedder:{self.repo}")
        if made and made != [self.embedder.name, self.embedder.dimension]:
            raise ToolError(f"the vectors were made by {made[0]} with {made[1]} numbers: index the project with {self.embedder.name} first")
        vector = [float(x) for x in self.embedder.vectors([query])[0]]
        vectors = self.cache.vectors(self.store.read("vec_symbols", self.repo), self.repo, self.store.version("vec_symbols", self.repo))
        near = search.knn(vectors, vector, 3 * top_k, least)
        text = fulltext.search(self.store.read("fts_postings"), self.store.read("fts_lengths"), self.repo, query, 3 * top_k, stemmed=True)
        found = self._rows(search.hybrid(self.symbols, self.store.read("memories"), near, text, top_k, kind, file_path_prefix, compatible))
        return self._with_savings({"results": found, "result_count": len(found)}, {r["file_path"] for r in found})

    @tool()
    def get_file_skeleton(self, file_path) -> dict:
        """One item a path: its symbols' signatures. All files are read in one job."""
        asked, errors = params.string_or_list(file_path), {}
        for path in asked:
            try:
                if not path.strip():
                    raise ToolError("file path is empty")
                self._inside(path)
            except ToolError as e:
                errors[path] = str(e)
        wanted = self.spark.createDataFrame([(p,) for p in dict.fromkeys(asked) if p not in errors], "file_path string")
        answer: dict = {}
        held: dict[str, list] = {}
        for r in self._list(answer, "rows", lookup.skeleton(self.symbols, self.repo, wanted).orderBy("file_path", "start_line", "symbol_id")):
            held.setdefault(r.pop("file_path"), []).append(r)
        answer.pop("rows")
        items = []
        for path in asked:
            if path in held:
                items.append({"input": path, "data": {"symbols": held[path]}})
            else:
                items.append({"input": path, "error": errors.get(path, f"no symbols in {path!r}")})
        good = sum("data" in i for i in items)
        return self._with_savings(answer | {"results": items, "success_count": good, "error_count": len(items) - good}, {p for p in asked if p not in errors})

    @tool()
    def get_symbol_usages(self, symbol_name: str) -> dict:
        answer = {"symbol": symbol_name}
        usages = graph.usages(self.edges, self.symbols, self.repo, self._resolve(symbol_name))
        found = self._list(answer, "usages", usages)
        answer["usage_count"] = usages.count() if answer.get("truncated") else len(found)
        return self._with_savings(answer, {r["file_path"] for r in found})

    @tool()
    def get_call_tree(self, symbol_name: str, direction: str = "callees", depth: int = 1) -> dict:
        if direction not in ("callees", "callers"):
            raise ToolError(f"direction must be callees or callers, not {direction!r}")
        found = self._rows(graph.call_tree(self.edges, self.symbols, self._resolve(symbol_name), depth, direction))
        return self._with_savings({"symbol": symbol_name, "direction": direction, "edges": found, "edge_count": len(found)}, {r["file_path"] for r in found})

    @tool()
    def find_dead_code(self, file_path: str = "", kind: str = "", exclude_exported: bool = True, limit: int = 50) -> dict:
        if file_path:
            self._inside(file_path)
        rows = graph.dead_code(self.edges, self.symbols, self.repo, file_path, kind, exclude_exported, limit)
        found = self._rows(rows.select("id", "name", "qualified_name", "kind", "file_path", "start_line"))
        return self._with_savings({"dead_symbols": found, "count": len(found)}, {r["file_path"] for r in found})

    @tool()
    def get_blast_radius(self, symbol_name: str, depth: int = 2, cap: int = graph.MAX_EDGES) -> dict:
        """The first `cap` callers by file; the counts are of all of them."""
        affected = staged(graph.blast_radius(self.edges, self.symbols, self._resolve(symbol_name), depth), "affected")
        depths = {r.depth: r.affected for r in graph.blast_by_depth(affected).collect()}  # one row a level
        files_affected = graph.blast_by_file(affected).count()
        found = self._rows(affected.orderBy("depth", "symbol_id").limit(max(cap, 0)))
        files: dict[str, list] = {}
        for r in found:
            files.setdefault(r["file_path"], []).append(r)
        total = sum(depths.values())
        answer = {"symbol": symbol_name, "affected_by_file": files, "by_depth": depths, "total_affected": total, "files_affected": files_affected, "truncated": len(found) < total}
        return self._with_savings(answer, set(files))

    @tool()
    def find_http_routes(self, method: str = "", path: str = "", file_path: str = "") -> dict:
        if file_path:
            self._inside(file_path)
        stored = self.store.read("routes", self.repo)
        found = self._rows(routes.with_handler(routes.find(stored, self.repo, method, path, file_path, limit=100), self.symbols).orderBy("method", "normalized_path", "id"))
        total = routes.match_classes(stored, self.repo).agg(F.coalesce(F.sum(F.col("defs") * F.col("calls")), F.lit(0))).first()[0]
        matches = self._rows(routes.match(stored, self.repo).orderBy(F.desc("confidence"), "def_id", "call_id").limit(200))
        answer = {"routes": found, "route_count": len(found), "matches": matches, "match_count": total, "matches_truncated": len(matches) < total}
        return self._with_savings(answer, {r["file_path"] for r in found})

    @tool()
    def search_code_patterns(self, pattern: str, file_path_prefix: str = "", kind: str = "", limit: int = 50, compatible: bool = False) -> dict:
        if not pattern:
            raise ToolError("pattern is required")
        found = self._rows(search.search_patterns(self.symbols, self.repo, pattern, file_path_prefix, kind, limit, compatible))
        return self._with_savings({"results": found, "result_count": len(found), "pattern": pattern}, {r["file_path"] for r in found}, 150 * len(found))

    @tool()
    def save_symbol_memory(self, symbol_name: str, note: str, author: str = "agent") -> dict:
        """Appends the note to the repository's part; no stored note is written again."""
        if not note or not note.strip():
            raise ToolError("note is required")
        if len(note) > memories.MAX_NOTE:
            raise ToolError(f"note is longer than {memories.MAX_NOTE} characters")
        target = self._resolve(symbol_name).first()
        new = self.spark.createDataFrame([(target.id, note, author)], "symbol_id long, note string, author string")
        fresh = staged(memories.new_rows(self.store.read("memories"), new), "note")
        number = fresh.agg(F.max("id")).first()[0]
        if number is None:
            raise ToolError("the symbol has this note already")
        self.store.append("memories", fresh, self.repo)
        return {"memory_id": number, "symbol": target.qualified_name}

    @tool()
    def get_symbol_memories(self, symbol_name: str = "", file_path: str = "", offset: int = 0, limit: int = 20) -> dict:
        stored = self.store.read("memories")
        if symbol_name:
            rows = memories.of_symbol_name(stored, self.symbols, self.repo, symbol_name)
        elif file_path:
            rows = memories.of_file(stored, self.symbols, self.repo, file_path)
        else:
            raise ToolError("symbol_name or file_path is required")
        found = self._rows(memories.paged(rows, offset, limit).withColumn("created_at", scalars.iso_time(F.col("created_at"))))
        return {"memories": found, "count": len(found)}

    @tool()
    def purge_stale_memories(self, orphaned_only: bool = False) -> dict:
        purged, changes = 0, {}
        for part in self.store.parts("memories"):  # one a repository
            before = self.store.read("memories", part)
            after = staged(memories.purge_stale(before, self.symbols, self.repo, orphaned_only), "purged")
            if gone := before.count() - after.count():
                purged, changes["memories", part] = purged + gone, after
        if changes:
            self.store.commit(changes)
        return {"purged": purged}
