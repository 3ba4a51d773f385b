"""Settings: JSON over defaults, merged recursively."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Project:
    name: str
    source_paths: list[str]
    extensions: list[str]
    exclude_patterns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Chunking:
    min_lines: int = 3
    max_lines: int = 80
    overlap_lines: int = 10


@dataclass(frozen=True)
class Search:
    top_k: int = 20
    rerank_top_k: int = 8
    min_score: float = 0.0
    alpha: float = 0.5
    use_reranker: bool = False


@dataclass(frozen=True)
class Settings:
    projects: list[Project]
    chunking: Chunking
    search: Search
    vector_size: int = 64


def merged(base: dict, over: dict) -> dict:
    """Dicts merge key by key, anything else is replaced; neither argument changes."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _pick(kind: type, values: dict[str, Any], prefix: str = "") -> Any:
    return kind(**{f.name: values[prefix + f.name] for f in fields(kind) if prefix + f.name in values})


def settings(values: dict[str, Any]) -> Settings:
    """indexer: chunk_* settings beside projects by name; embedding; search."""
    values = merged({"indexer": {}, "embedding": {}, "search": {}}, values)
    indexer = values["indexer"]
    projects = [Project(n, list(p.get("source_paths", [])), list(p.get("extensions", [])), list(p.get("exclude_patterns", []))) for n, p in indexer.items() if isinstance(p, dict)]
    return Settings(projects, _pick(Chunking, indexer, "chunk_"), _pick(Search, values["search"]), values["embedding"].get("vector_size", 64))


def load(path: str) -> Settings:
    """A JSON file, with or without byte order mark."""
    try:
        return settings(json.loads(Path(path).read_text("utf-8-sig")))
    except (OSError, ValueError) as e:
        raise SystemExit(f"settings {path}: {e}") from e
