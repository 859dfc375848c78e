"""Reward weights from category scores, burn, payout vectors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scoring import close_to

# Fixed names of the classes, in the order that subsets are listed.
CLASSES = ("Easy", "Medium", "Hard")


def subsets(classes: tuple[str, ...] = CLASSES) -> list[tuple[str, int, int, float, list[str]]]:
    """All non-empty class subsets with their weight: layer k halves, split over its subsets."""
    rows = []
    for depth, size in enumerate(range(len(classes), 0, -1)):
        members = list(combinations(classes, size))
        for subset in members:
            rows.append(("+".join(subset), size, depth, 0.5 ** depth / len(members), list(subset)))
    return rows


def subset_table(spark, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """The class subsets as rows."""
    return spark.createDataFrame(
        subsets(classes), "element string, size int, layer int, weight double, members array<string>")


def subset_scores(category: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Mean class score per entrant and subset; a subset with a missing class gives no row."""
    subsets = subset_table(category.sparkSession, classes).withColumn("category", F.explode("members"))
    joined = category.select("hotkey", "category", "category_score").join(F.broadcast(subsets), "category")
    return joined.groupBy("hotkey", "element", "size", "layer", "weight").agg(
        F.avg("category_score").alias("subset_score"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == F.col("size")).drop("_n")


def winners(scores: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Entrants within tolerance of the element's best; the element weight is split evenly.

    Maximum and winner count are one small row per element, joined back, so
    an element with millions of entrants is never sorted in one task.
    """
    best = scores.groupBy("element").agg(F.max("subset_score").alias("winning_score"))
    won = scores.join(F.broadcast(best), "element").where(close_to("subset_score", "winning_score", tol))
    counts = won.groupBy("element").agg(F.count(F.lit(1)).alias("n_winners"))
    return won.join(F.broadcast(counts), "element").withColumn("share", F.col("weight") / F.col("n_winners"))


def reward_weights(scores: DataFrame, burn_ratio: Column | float) -> DataFrame:
    """Raw and final weight per entrant; finals fill 1 - burn, the rest burns."""
    burn = burn_ratio if isinstance(burn_ratio, Column) else F.lit(float(burn_ratio))
    raw = winners(scores).groupBy("hotkey").agg(F.sum("share").alias("raw_weight"))
    pool = F.greatest(F.lit(0.0), F.lit(1.0) - burn)
    total = raw.agg(F.sum("raw_weight").alias("_total"))
    return raw.crossJoin(F.broadcast(total)).select(
        "hotkey", "raw_weight",
        F.when((F.col("_total") > 0) & (pool > 0), F.col("raw_weight") * pool / F.col("_total")).alias("final_weight"))


# Fixed labels of the projection's elements, by the number of their classes.
LABELS = {3: "Overall", 2: "Pair", 1: "Single"}


def eligible_entrants(board: DataFrame) -> DataFrame:
    """All three class scores present and the review not failed."""
    failed = F.lower(F.coalesce("review_status", F.lit(""))).contains("fail")
    return board.where("easy IS NOT NULL AND medium IS NOT NULL AND hard IS NOT NULL").where(~failed)


def element_winners(board: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Projection winners over board columns; absolute tolerance, shares by element."""
    elements = F.array(*[
        F.struct(F.lit(f"{LABELS[size]} ({','.join(c[0] for c in members)})").alias("element"), F.lit(weight).alias("weight"),
                 (sum(F.col(c.lower()) for c in members) / size).alias("subset_score"))
        for _, size, _, weight, members in subsets()])
    scores = eligible_entrants(board).select("hotkey", F.inline(elements))
    best = scores.groupBy("element").agg(F.max("subset_score").alias("winning_score"))
    won = scores.join(F.broadcast(best), "element").where(F.abs(F.col("subset_score") - F.col("winning_score")) < tol)
    counts = won.groupBy("element").agg(F.count(F.lit(1)).alias("n_winners"))
    return won.join(F.broadcast(counts), "element").withColumn("share", F.col("weight") / F.col("n_winners"))


def projected_shares(board: DataFrame) -> DataFrame:
    """Share of the pool per entrant, rounded to four digits."""
    raw = element_winners(board).groupBy("hotkey").agg(F.sum("share").alias("w"))
    total = raw.agg(F.sum("w").alias("_total"))
    return raw.crossJoin(F.broadcast(total)).select("hotkey", F.round(F.col("w") / F.col("_total"), 4).alias("pool_share"))


def burn_state(burns: DataFrame) -> DataFrame:
    """Newest request, ratio clamped to [0, 1]; without any request everything burns."""
    latest = burns.agg(F.max_by(F.struct("is_active", "burn_ratio"), F.struct("created_at", "request_id")).alias("b"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.burn_ratio").cast("double")))
    return latest.select(
        F.when(F.col("b").isNull(), True).otherwise(F.col("b.is_active")).alias("is_active"),
        F.when(F.col("b").isNull(), 1.0).otherwise(ratio).alias("burn_ratio"))


def assign_uids(weights: DataFrame, registry: DataFrame) -> DataFrame:
    """Weights per registered id; unknown hotkeys fall to id 0."""
    return weights.join(registry.select("hotkey", "uid"), "hotkey", "left").groupBy(
        F.coalesce("uid", F.lit(0)).alias("uid")).agg(F.sum("weight").alias("weight"))


def payout(screeners: DataFrame, per_screener: float, rewards: DataFrame, registry: DataFrame) -> DataFrame:
    """Payout vector: flat screener weights plus active rewards, remainder to id 0.

    ``screeners``: uid. ``rewards``: hotkey, weight (already valid now). If
    the parts exceed 1 (tolerance 1e-6) everything goes to id 0.
    """
    flat = screeners.groupBy("uid").agg((F.count(F.lit(1)) * F.lit(max(0.0, per_screener))).alias("weight"))
    flat = flat.where("weight > 0")
    summed = rewards.where("trim(hotkey) <> ''").groupBy(F.trim("hotkey").alias("hotkey")).agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight")).where("weight > 0")
    parts = flat.select("uid", "weight").unionByName(assign_uids(summed, registry))
    used = parts.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("used"))
    kept = parts.crossJoin(F.broadcast(used)).where("used <= 1.0 + 1e-6").select("uid", "weight")
    # with parts above one nothing was kept, so the whole unit burns
    rest = used.select(
        F.lit(0).cast("long").alias("uid"),
        F.when(F.col("used") > 1.0 + 1e-6, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("used")))
        .alias("weight"))
    both = kept.select(F.col("uid").cast("long").alias("uid"), "weight").unionByName(rest.where("weight > 0"))
    return both.groupBy("uid").agg(F.sum("weight").alias("weight"))


def normalize_weights(weights: DataFrame, tol: float = 2e-5) -> DataFrame:
    """Divide by the total unless it is already 1 (absolute 1e-5 plus relative 1e-5)."""
    total = weights.agg(F.sum("weight").alias("_total"))
    scaled = F.when((F.abs(F.col("_total") - 1.0) > tol) & (F.col("_total") > 0),
                    F.col("weight") / F.nullif("_total", F.lit(0.0))).otherwise(F.col("weight"))
    return weights.crossJoin(F.broadcast(total)).withColumn("weight", scaled).drop("_total")
