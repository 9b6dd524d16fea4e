"""Named queries over the library's tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


from . import library, retrieval, relating, organizing, changes, answering, serving  # noqa: E402, F401
