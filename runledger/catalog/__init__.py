"""Named queries over the derived views, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from runledger.catalog.registry import ORACLE, QUERIES
from runledger.catalog.views import Views, compose

MODULES = ("scoring", "rewards", "screening", "rounds", "scalars", "transcripts", "research", "ingest", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"runledger.catalog.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: compose(sql) for name, sql in ORACLE.items()}
