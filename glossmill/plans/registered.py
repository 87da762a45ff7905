"""The registry of queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def literal(value: object) -> str:
    """A Python value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return " || ".join(f"chr({ord(x)})" if x in _CONTROLS else "'" + x.replace("'", "''") + "'" for x in _parts(value)) or "''"
    return str(value)


_CONTROLS = {chr(n) for n in range(32)}


def _parts(text: str) -> list[str]:
    out, plain = [], ""
    for c in text:
        if c in _CONTROLS:
            out += [plain, c] if plain else [c]
            plain = ""
        else:
            plain += c
    return [*out, plain] if plain else out


def values(names: str, rows: Sequence[tuple]) -> str:
    """SQL that gives the rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"
