"""Pieces of DuckDB SQL for the twins of queries."""

from __future__ import annotations

import string


def arr(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def low(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({low(x)}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"
