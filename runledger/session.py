"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small inputs with heavy rows: do not merge shuffle partitions below the core count
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only a
    local master without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    base = os.path.join(tempfile.gettempdir(), f"runledger-{os.getpid()}")
    os.makedirs(base, exist_ok=True)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


# Spark removes the shuffle files of a query at its end, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def through_parquet(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Cut lineage by writing ``df`` once to shared storage and reading it back.

    Unlike an executor-local checkpoint the copy survives lost executors.
    With ``release`` the shuffle files of the write are gone when it ends;
    the session's own setting is left as it was.
    """
    conf = df.sparkSession.conf
    path = scratch_path(df.sparkSession, label)
    was = conf.get(CLEAN_UP, None)
    if release:
        conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        if release:
            conf.unset(CLEAN_UP) if was is None else conf.set(CLEAN_UP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give row-heavy work at least one partition per core (by ``keys``, if a keyed step follows).

    A large input has far more splits than that and passes through untouched;
    a single small file would otherwise keep one core busy.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)
