"""Registry of checked queries: a Spark function and, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import Tables

NUDGE = 1e-9
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
PLAIN: dict[str, Callable[[Tables], DataFrame]] = {}  # without the rounding
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; double columns are rounded."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda t: rounded(fn(t))
        PLAIN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that the order of a sum does not show.

    Means of decimal data often end in an exact 5; the nudge makes both engines
    round those the same way.
    """
    cols = {
        c: F.round(F.col(f"`{c}`") + F.lit(NUDGE), digits) + F.lit(0.0)
        for c, t in df.dtypes
        if t in ("double", "float")
    }
    return df.withColumns(cols) if cols else df


def sql_round(expr: str) -> str:
    return f"round({expr} + CAST({NUDGE} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def outer(ctes: str, keep: str, doubles: str, source: str) -> str:
    """SQL that selects ``keep`` as they are and ``doubles`` rounded from ``source``."""
    cols = [*keep.split(), *[f"{sql_round(d)} AS {d}" for d in doubles.split()]]
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({source}) AS result"
