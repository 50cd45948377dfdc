"""Registry of contract queries and composition of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """Declare a named SQL view (``v_...``) that queries may mention."""
    VIEWS[name] = body.strip()


def _needed(text: str, ordered: list[str]) -> None:
    for name in re.findall(r"\bv_\w+", text):
        if name in VIEWS and name not in ordered:
            _needed(VIEWS[name], ordered)
            ordered.append(name)


def compose(sql: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where the operator can be said in SQL."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
