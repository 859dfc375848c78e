"""Leaderboard job: runs and verdicts to an ordered, paged board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scoring import adjust_score
from runledger.operators import boards, difficulty, pairs, screening
from runledger.session import through_parquet


def build(tasks: DataFrame, runs: DataFrame, validations: DataFrame, entrants: DataFrame,
          min_resolved: int = 4, number: int = 1, size: int = 100) -> DataFrame:
    # everything below comes from one join of runs and verdicts
    judged = pairs.judged_runs_written(runs, validations)
    cells = pairs.scored_cells(tasks, judged, entrants)
    # one row per task, read twice
    classes = through_parquet(difficulty.task_difficulty(tasks, judged).select("task_id", "category"), "task-classes")
    facts = pairs.judged_baselines(judged).select("task_id", "baseline_token_sum").join(
        classes, "task_id", "left")
    needed = classes.agg(F.count(F.lit(1)).alias("n_required"))
    task_score = F.when(F.col("n_scored") > 0, pairs.mean_score())
    by_class = [F.avg(F.when(F.col("category") == c, task_score)).alias(f"_{c.lower()}") for c in difficulty.CATEGORIES]
    # totals and class means come out of one pass over the cells
    totals = (
        cells.join(facts, "task_id", "left").groupBy("entrant_id", "hotkey")
        .agg(*pairs.entrant_totals(), *by_class,
             F.count_if(F.col("category").isNotNull() & (F.col("n_scored") > 0)).alias("_have"))
        .withColumn("total_score", adjust_score("raw_total", "baseline_token_sum", "run_token_sum"))
        .crossJoin(F.broadcast(needed)))
    totals = totals.withColumns({
        c.lower(): F.when(F.col("_have") == F.col("n_required"), F.col(f"_{c.lower()}")) for c in difficulty.CATEGORIES})
    passed = screening.screener_eligible(tasks, judged, entrants, min_resolved).select(
        "entrant_id", F.lit(True).alias("screener_passed"))
    board = totals.join(passed, "entrant_id", "left").withColumn(
        "screener_passed", F.coalesce("screener_passed", F.lit(False)))
    # one row per entrant, read for the page and for the total
    return boards.leaderboard(through_parquet(board, "board"), number, size)
