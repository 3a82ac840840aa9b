"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from ..sources.adapters import SQL

QUERIES: dict = {}
ORACLES: dict = {}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` behind the common table expressions it names: adapters by name, others as text."""
    held = ", ".join(SQL.get(n, n) for n in names)
    return f"WITH {held} {sql}" if held else sql


def query(name: str, sql: str | None = None, *tables: str):
    def take(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return f

    return take


def add(name: str, f, sql: str | None = None, *tables: str) -> None:
    query(name, sql, *tables)(f)
