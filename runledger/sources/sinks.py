"""Writers: immutable snapshots, keyed appends, upserts, flat exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.scale import keep_first


def write_snapshot(df: DataFrame, path: str, day: str = "day") -> None:
    """Write once, never over an existing snapshot, never an empty one."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty snapshot")
    df.write.mode("errorifexists").partitionBy(day).parquet(path)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest row of every key by its other columns, the same one on every run."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return keep_first(df, list(keys), rest) if rest else df.dropDuplicates(list(keys))


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not have yet, one per key."""
    return one_per_key(df, keys).join(existing.select(*keys), list(keys), "left_anti")


def append_new(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Append only unseen keys; running it twice changes nothing. Returns what was appended."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(target)
        fresh = new_rows(df, existing, keys)
    except Exception as exc:  # the first append has no target yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        fresh = one_per_key(df, keys)
    fresh.write.mode("append").parquet(target)
    return fresh


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str]) -> DataFrame:
    """New version of ``target``: named columns replaced on a key match, unseen keys added.

    A full outer join, both sides partitioned by the key; the caller swaps paths.
    """
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in keys]).withColumn(
        "_upd", F.lit(True))
    joined = target.withColumn("_old", F.lit(True)).join(u, list(keys), "full")
    fresh = F.col("_old").isNull()

    def value(c: str):
        if c not in updates.columns:
            return F.col(c)
        if c in set_cols:
            return F.when(F.col("_upd"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(fresh, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[value(c) for c in target.columns if c not in keys])


def export_task_scores(details: DataFrame, path: str | None = None, compression: str = "none") -> DataFrame:
    """Flat per-task export; with a path also written as CSV with header, plain or by a codec."""
    flat = details.select("hotkey", "task_id", "task_name", "baseline_pass", "miner_pass", "baseline_tokens", "miner_tokens",
                          "compression_ratio", "score", "broke_baseline", "negative_score", "observed_at")
    if path is not None:
        flat.write.mode("errorifexists").option("header", True).option("compression", compression).csv(path)
    return flat
