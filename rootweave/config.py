"""Settings of an index: defaults, then the root's JSON file, then the environment, then the root itself."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import UTC, datetime
from pathlib import Path

from rootweave.sources.tree import IGNORE_FILES

FILE = ".rootweave/config.json"
MAX_BYTES_VARIABLE = "ROOTWEAVE_MAX_FILE_BYTES"
#: What marks a root, and whether it does so in the home directory as well.
MARKERS = {".git": True, ".claude": False}


@dataclass
class Chunk:
    window_lines: int = 80
    overlap_lines: int = 10


@dataclass
class Retrieval:
    default_mode: str = "hybrid"
    limit: int = 10
    token_budget: int = 1500
    rrf_k: int = 60
    compact_snippets: bool = True
    compact_min_reduction: float = 0.25


@dataclass
class Embeddings:
    enabled: bool = False
    backend: str = "noop"
    model: str = "all-MiniLM-L6-v2"
    endpoint: str | None = None
    allow_external: bool = False


@dataclass
class Graph:
    max_depth: int = 2
    node_cap: int = 40


@dataclass
class Config:
    root: str = "."
    languages: str | list[str] = "auto"
    max_file_bytes: int = 1 << 20
    ignore_files: list[str] = field(default_factory=lambda: list(IGNORE_FILES))
    extra_ignore: list[str] = field(default_factory=list)
    chunk: Chunk = field(default_factory=Chunk)
    retrieval: Retrieval = field(default_factory=Retrieval)
    embeddings: Embeddings = field(default_factory=Embeddings)
    graph: Graph = field(default_factory=Graph)
    redaction: dict = field(default_factory=lambda: {"enabled": True})

    def digest(self) -> str:
        """SHA-256 of what decides the content of an index, as sorted compact JSON."""
        own = asdict(self)
        kept = {k: own[k] for k in ("root", "languages", "max_file_bytes", "ignore_files", "extra_ignore", "chunk", "redaction")}
        kept["embeddings"] = {k: own["embeddings"][k] for k in ("enabled", "backend", "model")}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _filled(kind: type, values: dict) -> object:
    own = {f.name: f for f in fields(kind)}
    out = kind()
    for name, value in values.items():
        if name in own:
            now = getattr(out, name)
            setattr(out, name, _filled(type(now), value) if is_dataclass(now) else value)
    if isinstance(out, Retrieval) and out.default_mode not in ("hybrid", "fts", "symbol", "vector"):
        raise ValueError(f"unknown mode {out.default_mode}")
    if isinstance(out, Embeddings) and out.backend not in ("noop", "local", "external"):
        raise ValueError(f"unknown embedding backend {out.backend}")
    return out


def find_root(start: str | None = None) -> str:
    """The nearest directory above start with a marker, else start."""
    at = Path(start or ".").resolve()
    home = Path.home().resolve()
    for place in (at, *at.parents):
        if any((place / m).exists() and (anywhere or place != home) for m, anywhere in MARKERS.items()):
            return str(place)
    return str(at)


def load(root: str | None = None) -> Config:
    place = Path(root).resolve() if root else Path(find_root())
    values = json.loads((place / FILE).read_text("utf-8")) if (place / FILE).is_file() else {}
    if MAX_BYTES_VARIABLE in os.environ:
        values["max_file_bytes"] = int(os.environ[MAX_BYTES_VARIABLE])
    return _filled(Config, values | {"root": str(place)})


def now() -> str:
    """The time in UTC, to the second."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
