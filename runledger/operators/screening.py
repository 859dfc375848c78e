"""Screening gates: who has enough solved screener tasks, and how entrants rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.scale import keep_first, ranked


def required_passes(n: Column, ratio: float, minimum: int) -> Column:
    """min(n, max(1, ceil(n * ratio), minimum)); 0 when there is nothing to pass."""
    share = min(1.0, max(0.0, ratio))
    needed = F.greatest(F.lit(1), F.ceil(n * F.lit(share)).cast("int"), F.lit(max(0, minimum)))
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(n.cast("int"), needed))


def screener_task_stats(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """Scored and resolved verdicts per (competition, entrant, screener task)."""
    screeners = tasks.where("is_screener").select("task_id", "competition_id")
    mine = judged.where("NOT baseline_run AND entrant_id IS NOT NULL AND n_verdicts > 0").join(screeners, "task_id")
    return mine.groupBy("competition_id", "entrant_id", "task_id").agg(
        F.sum("n_scored").alias("total_scored"), F.sum("n_scored_pass").alias("resolved_count"))


def screener_eligible(tasks: DataFrame, judged: DataFrame, entrants: DataFrame, min_resolved: int = 4) -> DataFrame:
    """Entrants, not banned, with at least ``min_resolved`` tasks solved in 3/5 of the scored runs."""
    stats = screener_task_stats(tasks, judged)
    # 5 * resolved >= 3 * scored is the 3/5 rule without rounding error
    solved = (F.col("total_scored") > 0) & (5 * F.col("resolved_count") >= 3 * F.col("total_scored"))
    return (
        stats.groupBy("entrant_id").agg(F.count_if(solved).alias("resolved_tasks"))
        .where(F.col("resolved_tasks") >= min_resolved)
        .join(entrants.where("banned = false").select("entrant_id", "hotkey"), "entrant_id"))


def screening_verdict(tasks: DataFrame, runs: DataFrame, validations: DataFrame, scripts: DataFrame,
                      ratio: float = 0.6, min_passed: int = 1) -> DataFrame:
    """Per script: is every planned attempt of every screener task judged, and are enough tasks won?

    ``scripts``: entrant_id, script_id, competition_id. A task is won by a
    strict majority of its planned attempts. Attempts beyond the plan are ignored.
    """
    planned = tasks.where("is_screener").select(
        "competition_id", "task_id", F.greatest(F.lit(1), F.coalesce("planned_repeats", F.lit(1))).alias("repeats"))
    screeners = planned.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("n_screeners"), F.sum("repeats").alias("n_attempts"))
    attempts = (
        runs.where("NOT baseline_run").select("run_id", "task_id", "entrant_id", "script_id", "attempt_no")
        .join(planned, "task_id").where("attempt_no BETWEEN 1 AND repeats")
        .join(validations.select("run_id", "validation_id", "resolved", "scored_at"), "run_id"))
    # several rows for one attempt: the latest verdict row speaks for it
    states = attempts.groupBy("competition_id", "entrant_id", "script_id", "task_id", "repeats", "attempt_no").agg(
        F.max_by(F.when(F.col("scored_at").isNotNull(), F.col("resolved")), F.col("validation_id")).alias("verdict"))
    per_task = states.groupBy("competition_id", "entrant_id", "script_id", "task_id", "repeats").agg(
        F.count("verdict").alias("judged"), F.count_if(F.col("verdict")).alias("won"))
    per_script = per_task.groupBy("competition_id", "entrant_id", "script_id").agg(
        F.sum("judged").alias("judged"), F.count_if(F.col("won") > F.floor(F.col("repeats") / 2)).alias("tasks_won"))
    out = scripts.join(screeners, "competition_id", "left").join(
        per_script, ["competition_id", "entrant_id", "script_id"], "left")
    n = F.coalesce("n_screeners", F.lit(0))
    complete = F.coalesce("judged", F.lit(0)) >= F.coalesce("n_attempts", F.lit(0))
    return out.select(
        "competition_id", "entrant_id", "script_id", n.alias("n_screeners"),
        F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("tasks_won", F.lit(0)).alias("tasks_won"),
        complete.alias("complete"),
        (complete & (F.coalesce("tasks_won", F.lit(0)) >= required_passes(n, ratio, min_passed))).alias("passed"))


def run_progress(tasks: DataFrame, runs: DataFrame, validations: DataFrame) -> DataFrame:
    """Per (competition, entrant, script): dispatch flags and distinct scored runs against the plan."""
    plan = tasks.groupBy("competition_id").agg(
        F.sum(F.greatest(F.lit(1), F.coalesce("planned_repeats", F.lit(1)))).alias("expected_runs"))
    judged = (
        runs.where("NOT baseline_run").select("run_id", "task_id", "entrant_id", "script_id", "status")
        .join(validations.select("run_id", "resolved", "scored_at"), "run_id", "left"))
    # one row per run first: distinct counting then needs no expansion
    per_run = judged.groupBy("run_id", "task_id", "entrant_id", "script_id", "status").agg(
        F.bool_or(F.col("scored_at").isNotNull() & F.col("resolved").isNotNull()).alias("is_scored"))
    dispatched = F.col("status") == "dispatched"
    return (
        per_run.join(tasks.select("task_id", "competition_id", "is_screener"), "task_id")
        .groupBy("competition_id", "entrant_id", "script_id").agg(
            F.bool_or(dispatched & F.col("is_screener")).alias("has_dispatched_screener"),
            F.bool_or(dispatched & ~F.col("is_screener")).alias("has_dispatched_other"),
            F.count_if(F.col("is_scored")).alias("scored_runs"))
        .join(plan, "competition_id")
        .withColumn("fully_scored", (F.col("expected_runs") > 0) & (F.col("scored_runs") >= F.col("expected_runs"))))


def baseline_complete(tasks: DataFrame, runs: DataFrame, validations: DataFrame) -> DataFrame:
    """Per competition: distinct judged baseline runs against the planned number."""
    plan = tasks.groupBy("competition_id").agg(
        F.sum(F.greatest(F.lit(1), F.coalesce("planned_repeats", F.lit(1)))).alias("expected_runs"))
    judged = validations.where("scored_at IS NOT NULL AND resolved IS NOT NULL").select("run_id")
    done = (runs.where("baseline_run").select("run_id", "task_id").join(judged, "run_id", "left_semi")
            .join(tasks.select("task_id", "competition_id"), "task_id")
            .groupBy("competition_id").agg(F.count(F.lit(1)).alias("judged_runs")))
    n = F.coalesce("judged_runs", F.lit(0))
    return plan.join(done, "competition_id", "left").select(
        "competition_id", "expected_runs", n.alias("judged_runs"), (n >= F.col("expected_runs")).alias("complete"))


def needs_screener(scripts: DataFrame, scored_items: DataFrame, screeners: DataFrame, configs: DataFrame) -> DataFrame:
    """Scripts with fewer distinct scored screener items than screeners x ratios.

    ``scored_items``: script_id, item_id, challenge_id. ``screeners``:
    competition_id, challenge_id. ``configs``: competition_id, ratios (JSON array text).
    """
    expected = screeners.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n_screeners")).join(
        configs, "competition_id", "left").select(
        "competition_id",
        (F.col("n_screeners") * F.coalesce(F.json_array_length("ratios"), F.lit(1))).alias("expected_items"))
    mine = (scored_items.join(screeners.select("challenge_id").distinct(), "challenge_id", "left_semi")
            .groupBy("script_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("script_id").agg(F.count(F.lit(1)).alias("scored_items")))
    done = F.coalesce("scored_items", F.lit(0))
    return (scripts.join(expected, "competition_id").join(mine, "script_id", "left")
            .select("script_id", "competition_id", "expected_items", done.alias("scored_items"),
                    (done < F.col("expected_items")).alias("needs_screener")))


def top_limit(n: Column, fraction: float) -> Column:
    """ceil(fraction * n), 0 for an empty list or a non-positive fraction."""
    if fraction <= 0:
        return F.lit(0)
    return F.when(n <= 0, F.lit(0)).otherwise(F.ceil(n * F.lit(fraction)).cast("int"))


def top_fraction(ranked: DataFrame, fraction: float, key: str = "competition_id") -> DataFrame:
    """Every ranked row of a competition inside its top share, with the total and the limit."""
    totals = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("total_eligible"))
    totals = totals.withColumn("top_limit", top_limit(F.col("total_eligible"), fraction))
    return ranked.join(totals, key).where(F.col("rank") <= F.col("top_limit"))


def screener_rank(scores: DataFrame) -> DataFrame:
    """Rank per competition by mean score; earlier first upload, then hotkey, decide ties.

    The ranking rule of the source system lives outside its repository; this
    order is our definition.
    """
    return ranked(scores, ["competition_id"], "avg_score", [F.col("first_upload").asc_nulls_last(), "hotkey"])


def competition_rank(scores: DataFrame) -> DataFrame:
    """Rank per competition by score (own definition, see `screener_rank`)."""
    return ranked(scores, ["competition_id"], "score", ["hotkey"])


def ratio_rank(scores: DataFrame) -> DataFrame:
    """Rank per (competition, compression ratio) by score (own definition)."""
    return ranked(scores, ["competition_id", "compression_ratio"], "score", ["hotkey"])


def choose_screeners(tasks: DataFrame, runs: DataFrame, validations: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Per competition the ``k`` tasks with most baseline passes; a seeded hash orders equals."""
    wins = (
        runs.where("baseline_run").select("run_id", "task_id")
        .join(validations.where("scored_at IS NOT NULL AND resolved").select("run_id"), "run_id")
        .groupBy("task_id").agg(F.count(F.lit(1)).alias("passes")))
    counted = tasks.select("competition_id", "task_id", "task_name").join(wins, "task_id", "left").withColumn(
        "passes", F.coalesce("passes", F.lit(0)))
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("task_id")))
    return keep_first(counted, ["competition_id"], [F.col("passes").desc(), tie], k, rank_col="pick")


def screeners_with_grace(current: DataFrame, previous: DataFrame, now: Column, start: Column, grace_hours: float = 4.0
                         ) -> DataFrame:
    """Current list, then the previous one while the grace period runs; first position wins.

    Both inputs: id, pos. ``start`` and ``now`` are timestamps.
    """
    deadline = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(grace_hours * 3600).cast("decimal(18,6)"))
    both = current.select("id", F.lit(0).alias("list_no"), "pos").unionByName(
        previous.where(now <= deadline).select("id", F.lit(1).alias("list_no"), "pos"))
    return both.groupBy("id").agg(F.min(F.struct("list_no", "pos")).alias("first")).select(
        "id", "first.list_no", "first.pos")
