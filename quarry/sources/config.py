"""Settings of the engine from defaults, a simple file and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

PREFIX = "QUARRY_"


@dataclass(frozen=True)
class Config:
    project_root: str = "."
    store: str = "quarry-store"
    repo_name: str = ""
    log_level: str = "info"
    tools: tuple[str, ...] = field(default=())
    debounce_ms: int = 500
    embedder: str = "hash"


def _typed(name: str, text: str):
    kind = {f.name: f.type for f in fields(Config)}[name]
    if "tuple" in str(kind):
        return tuple(x.strip() for x in text.strip("[]").split(",") if x.strip())
    return int(text) if kind == "int" else text.strip("\"'")


def load(path: str | None = None) -> Config:
    """Defaults, then `key: value` lines of a file, then QUARRY_* variables. A file named explicitly must exist."""
    found: dict[str, object] = {}
    names = {f.name for f in fields(Config)}
    if path and not os.path.exists(path):
        raise FileNotFoundError(path)
    chosen = path or "quarry.yaml"
    if os.path.exists(chosen):
        with open(chosen) as f:
            for line in f:
                key, colon, value = line.split("#", 1)[0].partition(":")
                if colon and key.strip() in names:
                    found[key.strip()] = _typed(key.strip(), value.strip())
    for name in names:
        if (value := os.environ.get(PREFIX + name.upper())) is not None:
            found[name] = _typed(name, value)
    return replace(Config(), **found)
