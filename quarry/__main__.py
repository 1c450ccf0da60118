"""Command line: index a tree, call one tool, or serve tools over lines of JSON.

    python -m quarry index PATH [--repo-name NAME] [--store DIR] [--force]
    python -m quarry call TOOL '{"symbol_name": "main"}' [--root PATH] ...
    python -m quarry serve [--root PATH] ...
    python -m quarry watch [--root PATH] ...

serve reads {"id": ..., "tool": ..., "arguments": {...}} and answers {"id": ..., "result": ...}, one line each.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable, Iterator

from .service import TOOLS, Service
from .sources import config
from .store import Store


def answer(service: Service, tool: str, arguments: dict) -> dict:
    """One tool's answer; an unknown tool or argument is an error in the answer."""
    if tool not in TOOLS:
        return {"error": f"unknown tool {tool!r}"}
    try:
        return getattr(service, tool)(**arguments)
    except TypeError as e:
        return {"error": f"{tool}: {e}"}


def serve(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """Answers to requests, line by line; a line that is no request gets an error."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            result = answer(service, request["tool"], request.get("arguments") or {})
            yield json.dumps({"id": request.get("id"), "result": result}, default=str)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield json.dumps({"id": None, "error": f"bad request: {e}"})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["index", "call", "serve", "watch"])
    parser.add_argument("rest", nargs="*")
    for name in ("--config", "--root", "--repo-name", "--store"):
        parser.add_argument(name)
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    settings = config.load(args.config)
    root = args.root or (args.rest[0] if args.command == "index" and args.rest else settings.project_root)
    repo = args.repo_name or settings.repo_name or os.path.basename(os.path.abspath(root))
    from .session import local_session

    spark = local_session(os.cpu_count() or 1)
    service = Service(spark, Store(spark, args.store or settings.store), root, repo, settings.tools, settings.embedder)
    if args.command == "serve":
        for line in serve(service, sys.stdin):
            print(line, flush=True)
        return 0
    if args.command == "watch":
        from .streaming.watch import TreeWatcher

        service.reindex_project(force=args.force)
        TreeWatcher(spark, root).run(service.flush, every_s=settings.debounce_ms / 1000)
        return 0
    if args.command == "index":
        result = service.reindex_project(force=args.force)
    else:
        result = answer(service, args.rest[0] if args.rest else "", json.loads(args.rest[1]) if len(args.rest) > 1 else {})
    print(json.dumps(result, default=str))
    return int("error" in result)


if __name__ == "__main__":
    sys.exit(main())
