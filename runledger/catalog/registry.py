"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Views` under ``name``, with its SQL twin if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the named double columns (adding 0.0 turns -0.0 into 0.0)."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def big(*cols: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]
