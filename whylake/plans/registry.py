"""Registry of named queries with the SQL text that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from whylake.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the names in ``VIEWS``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if opening := re.match(r"(?i)with\s+(recursive\s)?", body):
        return f"WITH {opening[1] or ''}{ctes},\n{body[opening.end():]}"
    return f"WITH {ctes}\n{body}"
