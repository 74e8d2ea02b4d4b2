"""The engine's calls for agents: plain arguments in, JSON-shaped answers out."""

from __future__ import annotations

from typing import Any

from lantern.plans.engine import Engine, pack_json, result_json

MAX_RESULTS = 100


def _check(query: str, top_k: int, min_score: float = 0.0) -> None:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if not 0 < top_k <= MAX_RESULTS:
        raise ValueError(f"top_k must lie between 1 and {MAX_RESULTS}")
    if min_score < 0:
        raise ValueError("min_score must not be negative")


def search(engine: Engine, query: str, top_k: int = 10, min_score: float = 0) -> dict[str, Any]:
    """The best chunks for a query in plain language or a symbol."""
    _check(query, top_k, min_score)
    rows = engine.search(query, top_k, min_score=min_score).collect()
    return {"query": query, "count": len(rows), "results": [{**result_json(r), "start_line": r["start_line"], "end_line": r["end_line"]} for r in rows]}


def resolve(engine: Engine, query: str, top_k: int = 5) -> dict[str, Any]:
    """A feature with its tests, imports, callers and related files."""
    _check(query, top_k)
    return pack_json(engine.resolve(query, top_k), formatted=True)


def explain(engine: Engine, location: str) -> dict[str, Any]:
    """A file, a `file:line` or a symbol in its surroundings."""
    return pack_json(engine.explain(location), location, formatted=True)


def status(engine: Engine) -> dict[str, Any]:
    """The state of the index; never builds one."""
    return engine.status()


def reindex(engine: Engine, force: bool = False, include_text: bool | None = None) -> dict[str, Any]:
    """Bring the index up to date, or build it again."""
    return engine.index(force=force, include_text=include_text).as_dict()


TOOLS = {f.__name__: f for f in (search, resolve, explain, status, reindex)}
