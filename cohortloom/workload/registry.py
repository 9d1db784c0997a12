"""Registry of the named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .roles import Roles, with_roles


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Roles], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None, roles: str = ""):
    """Register a function of the role tables under its own name."""

    def register(build: Callable[[Roles], DataFrame]):
        text = with_roles(sql, *roles.split()) if sql else None
        QUERIES[build.__name__] = Query(build.__name__, operators, build, text)
        return build

    return register


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named doubles, as the SQL side does."""
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])
