"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# rows of one batch handed back to Spark; bounds what a Python worker holds besides its input batch
OUT_ROWS = 2000
# parts that a large group is ranked in before its sample is taken
SPREAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n, the fold of a document; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def hash_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bounded_sample(docs: DataFrame, group: str, per_group: int, max_groups: int, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """At most ``per_group`` keys per value of ``group`` and ``max_groups`` values (the most frequent ones): (key, group[, text]).

    One row per key and group, however often the table repeats it (of several
    texts the smallest); a key may be in several groups. Rows without key or
    group take no part. The choice goes by a hash of the key, so it is the
    same on every run. Only distinct keys are ranked; texts are picked up by
    a join with the chosen keys, which are at most per_group * max_groups.
    """
    slim = docs.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, group).distinct()
    top = slim.groupBy(group).count().orderBy(F.desc("count"), group).limit(max_groups).select(F.col(group).alias("_g"))
    from pyspark.sql import Window

    # first within SPREAD parts of a group, so that the last step sees at most SPREAD * per_group rows of it, however many tasks there were
    part = F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(SPREAD))
    by_hash = [F.xxhash64(F.col(key), F.lit(7)), F.col(key)]
    order = Window.partitionBy(group).orderBy(*by_hash)
    chosen = (slim.join(F.broadcast(top), F.col(group) == F.col("_g"), "left_semi")
              .withColumn("_rn", F.row_number().over(Window.partitionBy(group, part).orderBy(*by_hash))).where(F.col("_rn") <= per_group)
              .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_group).select(key, group))
    if text is None:
        return chosen
    side = chosen.select(F.col(key).alias("_k"), F.col(group).alias("_g"))
    held = docs.join(F.broadcast(side), (F.col(key) == F.col("_k")) & (F.col(group) == F.col("_g")), "left_semi")
    return held.groupBy(key, group).agg(F.min(text).alias(text))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with working columns."""
    return df.select(*names)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row; a generator keeps the optimizer from repeating its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))
