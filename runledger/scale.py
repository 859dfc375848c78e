"""Helpers that keep hot keys from landing in one task.

Three shapes come up again and again and each has a skew-proof form here:

* attaching per-group facts back to the rows of a group (``attach_facts``),
* running totals inside an ordered group (``running_totals``; by ranges of
  values, with ranks and quantiles on top, ``global_totals``),
* the newest/first N rows of a group (``keep_first``), which Spark limits
  before the shuffle by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.session import through_parquet

# A group with more rows than this counts as hot. The list of hot groups is
# then at most total_rows / HOT_ROWS long, which bounds what is broadcast.
HOT_ROWS = 4_000_000
# Rows of one ordered group handled by one task in running_totals.
BLOCK_ROWS = 65_536


def salt_count(spark: SparkSession, floor: int = 1, ceiling: int = 64) -> int:
    """How many ways to split a key when the key space is smaller than the cluster."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(floor, min(ceiling, partitions // 16))


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality over paired columns."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def shuffled(df: DataFrame) -> DataFrame:
    """Mark rows whose joins go by shuffles, whatever the size of their files.

    Spark takes the compressed size of a written table for that of its rows;
    ids, positions and flags shrink to a byte a row and less there, so that
    millions of rows would be sent whole to the driver and every executor.
    The mark holds through filters, selections and aggregates up to the next join.
    """
    return df.hint("merge")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1,
               rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order.

    Spark plans ``row_number() <= n`` as a partial group limit before the
    shuffle, so at most ``n`` rows per key and map task move.
    """
    name = rank_col or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= n)
    return ranked if rank_col else ranked.drop(name)


def attach_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size_col: str,
                 sizes: DataFrame | None = None, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join per-group ``facts`` back to the rows of the group, whatever the skew.

    ``facts`` holds one row per key and ``size_col`` says how many rows that
    key has; a group of n rows is split into ceil(n / hot_rows) salts and its
    facts are repeated once per salt. Rows learn the salt count of hot groups
    from a broadcast list, whose length is at most total_rows / hot_rows.
    ``sizes`` (keys and ``size_col``) can supply that list more cheaply than
    ``facts``. ``size_col`` is consumed.
    """
    values = [c for c in facts.columns if c not in keys and c != size_col]
    hot = (sizes if sizes is not None else facts).where(F.col(size_col) > hot_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col(size_col) / hot_rows).cast("int").alias("_salts"))
    tagged = rows.join(
        F.broadcast(hot), same([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys]), "left")
    # a salt hangs on the row and its partition alone, so that a rerun of a lost task gives the same one
    spot = F.xxhash64(*[F.col(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()], F.spark_partition_id())
    tagged = tagged.drop(*[f"_h_{k}" for k in keys]).withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(spot, F.col("_salts")).cast("int")))
    salts = F.greatest(F.lit(1), F.ceil(F.col(size_col) / hot_rows).cast("int"))
    repeated = facts.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.explode(F.sequence(F.lit(0), salts - 1)).alias("_c_salt"),
        *values)
    joined = tagged.join(
        repeated, same([F.col(k) for k in keys], [F.col(f"_c_{k}") for k in keys])
        & (F.col("_salt") == F.col("_c_salt")), how)
    return joined.select(*[F.col(c) for c in rows.columns], *values)


def attach_by_block(rows: DataFrame, facts: DataFrame, keys: Sequence[str], position: str, last: str,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """Left join of one-row-per-key facts to rows that know their position inside the key.

    ``last`` (consumed) is the largest position of the key. The facts are
    repeated once per block of positions, about rows / block copies in all,
    and the join runs on (key, block), so a long group is spread over tasks.
    """
    values = [c for c in facts.columns if c not in keys and c != last]
    repeated = facts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / block))).alias("_block"),
                            *values)
    tagged = rows.withColumn("_block", F.floor(F.col(position) / block))
    return tagged.join(repeated, [*keys, "_block"], "left").select(*[F.col(c) for c in rows.columns], *values)


def running_totals(df: DataFrame, keys: Sequence[str], position: str, sums: Mapping[str, Column],
                   maxima: Mapping[str, Column] | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sums and maxima along a dense integer ``position``.

    Equivalent to a window over ``keys`` ordered by ``position``, but the
    group is cut into blocks of ``block`` positions: blocks are summarised
    first, summaries are prefix-combined (one row per block), and the rows
    only ever meet others of their own block. ``position`` must be unique
    within the key; values should be integers so that results do not depend
    on the order of addition.
    """
    maxima = maxima or {}
    tagged = df.withColumn("_block", F.floor(F.col(position) / block))
    for name, expr in {**sums, **maxima}.items():
        tagged = tagged.withColumn(f"_v_{name}", expr)
    by_block = tagged.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.select(
        *[F.col(k) for k in keys], "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_p_{n}") for n in maxima])
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = tagged
    for n in sums:
        local = local.withColumn(f"_r_{n}", F.sum(f"_v_{n}").over(inside))
    for n in maxima:
        local = local.withColumn(f"_r_{n}", F.max(f"_v_{n}").over(inside))
    joined = local.join(carried, [*keys, "_block"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_p_{n}") + F.coalesce(F.col(f"_r_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(f"_p_{n}"), F.col(f"_r_{n}")).alias(n) for n in maxima])


def global_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: Column, name: str,
                  total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` within ``keys`` along ``order``, whatever the skew of keys and values.

    Rows are dealt out by ranges of (keys, order, row hash), so that a hot
    key, a crowd of equal values or of nulls is cut like anything else; each
    range is summed by itself and learns what lies before it from the sums
    of the ranges (one row per key and range). The dealt rows are written
    once, because sampled range bounds differ from job to job. Rows that are
    equal in all columns share a range. ``total`` adds the sum of the key.
    """
    plain = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    sort = [*[F.col(k) for k in keys], *order, F.xxhash64(*plain)]
    dealt = df.withColumn("_weight", weight).repartitionByRange(_partitions(df.sparkSession), *sort).sortWithinPartitions(*sort)
    stored = through_parquet(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    # the upper bits of the row number are the range
    local = stored.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*keys, "_range").agg(F.sum("_weight").alias("_sum")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = local.withColumn("_run", F.sum("_weight").over(inside))
    on = same([F.col(k) for k in [*keys, "_range"]], [F.col(f"_k_{k}") for k in keys] + [F.col("_k_range")])
    joined = run.join(sums, on)
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_run")).alias(name),
                         *([F.col("_total").alias(total)] if total else []))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Rank by descending score, missing scores last; ``ties`` make the order total."""
    out = global_totals(df, keys, [F.col(score).desc_nulls_last(), *ties], F.lit(1), name)
    return out.withColumn(name, F.col(name).cast("int"))


def values_at(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key the values at 1-based ranks of the ascending non-null values, and their number ``n``.

    ``ranks``: name -> rank as a function of n. Equal values are counted
    before they are sorted; no task holds a key's values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = global_totals(counted, keys, [F.col(value)], F.col("_n"), "_upto", "n")
    return summed.groupBy(*keys, "n").agg(
        *[F.min(F.when(F.col("_upto") >= rank(F.col("n")), F.col(value))).alias(name) for name, rank in ranks.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per key, interpolated between neighbours; keys without a value have no row."""
    place = {q: (lambda n, q=q: F.lit(q) * (n - 1)) for q in shares.values()}
    ranks = {}
    for name, q in shares.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor(place[q](n)) + 1
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil(place[q](n)) + 1
    found = values_at(df, keys, value, ranks)
    between = {name: F.col(f"_lo_{name}") + (place[q](F.col("n")) - F.floor(place[q](F.col("n")))) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
               for name, q in shares.items()}
    return found.select(*keys, *[e.alias(name) for name, e in between.items()])


def positions(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column],
              name: str) -> DataFrame:
    """1-based position of each row within ``keys`` under ``order``.

    Same numbers as ``row_number()``, but rows are only sorted against rows
    of the same ``bucket``; ``bucket`` must be non-decreasing along
    ``order`` (an hour of the timestamp, say). A hot key is thus spread over
    as many tasks as it has buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = tagged.withColumn("_local", F.row_number().over(
        Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return local.join(offsets, [*keys, "_bucket"]).select(
        *[F.col(c) for c in df.columns], (F.col("_offset") + F.col("_local")).alias(name))
