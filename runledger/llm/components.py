"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import through_parquet

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v bigint) but the roots: root is the least node it can reach.

    Alternates two star steps: hang larger neighbours on the least neighbour,
    then do so among smaller ones, until every node hangs on its root. Each
    round is written to the shared scratch folder, so lineage stays short and
    lost executors cost no more than a round. Minima are aggregated map-side
    and joined back, so a node with very many neighbours is no single group.
    """
    now = through_parquet(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.toDF("u", "v"))
        now = through_parquet(small.distinct(), label)
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
