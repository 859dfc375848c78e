"""Reward round: category scores to weights, window replacement, approval changes, payout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators import difficulty, pairs, rewards
from runledger.session import through_parquet


def build(tasks: DataFrame, runs: DataFrame, validations: DataFrame, entrants: DataFrame, burns: DataFrame,
          exclude_banned: bool = True, competition_id: int | None = None) -> DataFrame:
    """Candidate weights of a round under the current burn ratio."""
    if competition_id is not None:
        tasks = tasks.where(F.col("competition_id") == competition_id)
    judged = pairs.judged_runs_written(runs, validations)
    cells = pairs.scored_cells(tasks, judged, entrants, exclude_banned)
    classes = difficulty.task_difficulty(tasks, judged)
    # one row per entrant and class; read several times below, so written once
    category = through_parquet(difficulty.category_scores(cells, classes), "category-scores")
    scores = rewards.subset_scores(category)
    weights = rewards.reward_weights(scores, 0.0)
    burn = rewards.burn_state(burns).select("burn_ratio")
    # with no pool left there are no final weights
    pool = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("burn_ratio"))
    return weights.crossJoin(F.broadcast(burn)).select(
        "hotkey", "raw_weight", F.when(pool > 0, F.col("final_weight") * pool).alias("final_weight"))


def replace_window(rewards_now: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Unapproved rows of the given windows give way to the candidates.

    ``windows``: competition_id, starts_at, ends_at. ``candidates``: hotkey, competition_id, weight.
    """
    keys = ["competition_id", "starts_at", "ends_at"]
    cols = ["hotkey", *keys, "weight", "approved"]
    stale = windows.select(*keys).distinct().withColumn("approved", F.lit(False))
    kept = rewards_now.select(*cols).join(stale, [*keys, "approved"], "left_anti").select(*cols)
    fresh = windows.select(*keys).distinct().join(candidates, "competition_id").withColumn("approved", F.lit(False))
    return kept.unionByName(fresh.select(*cols))


def apply_approval(rewards_now: DataFrame, changes: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Approval flags set row by row; disapproving a live approved winner empties its window
    and refills it with fresh candidates.

    ``changes``: reward_id, approved.
    """
    keys = ["competition_id", "starts_at", "ends_at"]
    changed = rewards_now.join(changes.select("reward_id", F.col("approved").alias("_to")), "reward_id", "left")
    live = (F.col("starts_at") <= now) & (F.col("ends_at") >= now)
    triggers = F.col("approved") & (F.col("_to") == F.lit(False)) & live
    windows = changed.where(triggers).select(*keys).distinct()
    flagged = changed.withColumn("approved", F.coalesce("_to", "approved")).drop("_to")
    hit = flagged.join(windows.withColumn("_hit", F.lit(True)), keys, "left")
    cleared = hit.withColumn("approved", F.col("approved") & F.col("_hit").isNull()).drop("_hit")
    return replace_window(cleared, candidates, windows)
