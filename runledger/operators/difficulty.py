"""Task difficulty classes and the category scores built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.pairs import mean_score
from runledger.scale import global_totals

# Fixed values of the difficulty rule.
LOSS_WEIGHT = 0.75
TOKEN_WEIGHT = 0.25
CATEGORIES = ("Hard", "Medium", "Easy")


def difficulty_inputs(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """Loss ratio over known baseline verdicts and mean baseline tokens, once per verdict row; tasks without a verdict drop out."""
    rows = F.greatest("n_verdicts", F.lit(1))
    zero = F.lit(0)
    inputs = judged.where("baseline_run").groupBy("task_id").agg(
        (F.lit(1.0) - F.sum("v_pass") / F.nullif(F.sum(F.col("v_pass") + F.col("v_fail")), zero)).alias("loss_ratio"),
        F.coalesce(F.sum(F.col("tokens_used") * rows) / F.nullif(F.sum(F.when(F.col("tokens_used").isNotNull(), rows)), zero),
                   F.lit(0.0)).alias("avg_tokens"))
    return inputs.where("loss_ratio IS NOT NULL").join(tasks.select("task_id", "task_name"), "task_id")


def difficulty_score(inputs: DataFrame) -> DataFrame:
    """Weighted loss ratio and tokens relative to the largest mean.

    The maximum is one scalar per job, joined as a single row, so tasks are
    never gathered into one window partition here.
    """
    top = inputs.agg(F.max("avg_tokens").alias("max_tokens"))
    token_score = F.when(F.col("max_tokens") > 0, F.col("avg_tokens") / F.nullif("max_tokens", F.lit(0.0))).otherwise(0.0)
    return inputs.crossJoin(F.broadcast(top)).select(
        "task_name", "task_id", "loss_ratio", "avg_tokens", token_score.alias("token_score"),
        (LOSS_WEIGHT * F.col("loss_ratio") + TOKEN_WEIGHT * token_score).alias("difficulty_score"))


def assign_difficulty(scores: DataFrame) -> DataFrame:
    """Thirds by descending score; a remainder goes to the harder classes first."""
    placed = global_totals(scores, [], [F.col("difficulty_score").desc_nulls_last(), F.col("task_name")], F.lit(1), "_pos", "_n")
    parts = len(CATEGORIES)
    size, larger = F.floor(F.col("_n") / parts), F.col("_n") % parts
    head = larger * (size + 1)
    third = F.when(F.col("_pos") <= head, F.ceil(F.col("_pos") / (size + 1))).otherwise(larger + F.ceil((F.col("_pos") - head) / F.nullif(size, F.lit(0))))
    return placed.select(*scores.columns, F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), third.cast("int")).alias("category"))


def task_difficulty(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    return assign_difficulty(difficulty_score(difficulty_inputs(tasks, judged)))


def with_category(scores: DataFrame, difficulty: DataFrame, how: str = "left") -> DataFrame:
    """Attach the class of the task; task-sized side, sized by Spark before it broadcasts."""
    return scores.join(difficulty.select("task_id", "category"), "task_id", how)


def category_scores(cells: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Mean of task means per class, for entrants that have a score on every classified task.

    ``cells``: one row per (entrant, task) as made by `pairs.task_cells`.
    """
    needed = difficulty.agg(F.count(F.lit(1)).alias("n_required"))
    per_task = cells.where("n_scored > 0").withColumn("task_score", mean_score()).join(
        difficulty.select("task_id", "category"), "task_id")
    per_class = per_task.groupBy("entrant_id", "hotkey", "category").agg(
        F.avg("task_score").alias("category_score"), F.count(F.lit(1)).alias("n_tasks"))
    have = Window.partitionBy("entrant_id")
    return (
        per_class.withColumn("_have", F.sum("n_tasks").over(have))
        .crossJoin(F.broadcast(needed)).where(F.col("_have") == F.col("n_required"))
        .select("entrant_id", "hotkey", "category", "category_score", "n_tasks"))


def complete_entrants(cells: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Entrants whose set of scored tasks equals the required set.

    Cells are unique per (entrant, task), so comparing counts compares sets.
    """
    needed = difficulty.agg(F.count(F.lit(1)).alias("n_required"))
    have = cells.where("n_scored > 0").join(difficulty.select("task_id"), "task_id", "left_semi").groupBy(
        "entrant_id", "hotkey").agg(F.count(F.lit(1)).alias("n_scored_tasks"))
    return have.crossJoin(F.broadcast(needed)).withColumn("complete", F.col("n_scored_tasks") == F.col("n_required"))
