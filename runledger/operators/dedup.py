"""Newest-wins and prefer-scored rules, snapshot ranks, identity lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.scale import keep_first, ranked


def newest(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str | Column]) -> DataFrame:
    """Newest row per key; on equal timestamps the one scanned first."""
    return keep_first(df, keys, [F.col(ts).desc_nulls_last(), *[F.col(t).asc() if isinstance(t, str) else t for t in tie]])


def prefer_scored(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """Scored record if there is one, first seen otherwise."""
    return keep_first(df, [key], [F.col(score).isNotNull().desc(), F.col(pos).asc()])


def latest_snapshot(df: DataFrame, ts: str = "observed_at") -> DataFrame:
    """Rows of the newest snapshot only (one scalar, joined as a single row)."""
    top = df.agg(F.max(ts).alias("_top"))
    return df.join(F.broadcast(top), F.col(ts) == F.col("_top")).drop("_top")


def snapshot_rank(board: DataFrame) -> DataFrame:
    """Rank inside each snapshot by overall score; entrants without one have no rank. Position breaks ties."""
    placed = ranked(board, ["observed_at"], "overall", ["pos"])
    return placed.withColumn("rank", F.when(F.col("overall").isNotNull(), F.col("rank")))


def repair_names(runs: DataFrame, dim: DataFrame, marker: str = "available after uploads") -> DataFrame:
    """Missing or placeholder task names replaced from the dimension (task_id, task_name)."""
    d = dim.select("task_id", F.col("task_name").alias("_real"))
    placeholder = F.col("task_name").isNull() | (F.col("task_name") == "") | F.lower("task_name").contains(marker)
    return runs.join(d, "task_id", "left").withColumn(
        "task_name", F.when(placeholder, F.coalesce("_real", "task_name")).otherwise(F.col("task_name"))).drop("_real")


def resolve_entrant(df: DataFrame, dims: Sequence[DataFrame], key: str = "hotkey") -> DataFrame:
    """Name from the first registry that knows the key, else its first eight characters. Registries: hotkey, label."""
    ranked = None
    for i, d in enumerate(dims):
        part = d.select(F.col("hotkey").alias(key), F.lit(i).alias("_prio"), "label")
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.groupBy(key).agg(F.min_by("label", "_prio").alias("_label"))
    return df.join(first, key, "left").withColumn("entrant", F.coalesce("_label", F.substring(key, 1, 8))).drop("_label")
