"""Runs against baselines: pair fan-out, run scores, task results, entrant totals.

The pair table grows with baselines x runs per task. It is available
(`run_pairs`) because people want to look at it, but nothing downstream
needs it: `run_scores` gets the same means from prefix sums over the
baselines' token counts, so its cost is linear in the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scoring import LOG_RATIO_LIMIT, OUTCOMES, adjust_score, pair_score
from runledger.scale import attach_facts, salt_count, shuffled
from runledger.session import through_parquet

# Buckets per unit of ln(tokens); a bucket is the unit of work of the prefix sum.
BUCKETS_PER_LOG = 256


def with_verdicts(runs: DataFrame, validations: DataFrame) -> DataFrame:
    """Runs with every verdict row they have (left); a run without one stays, pending."""
    return runs.join(shuffled(validations.select("run_id", "resolved")), "run_id", "left")


def run_pairs(tasks: DataFrame, runs: DataFrame, validations: DataFrame, entrants: DataFrame,
              exclude_banned: bool = False, hotkeys: list[str] | None = None,
              competition_id: int | None = None) -> DataFrame:
    """Every (baseline run, entrant run) of a task with both verdicts.

    Tasks are few next to a cluster's cores, so the task key alone would
    leave most of them idle: entrant runs take a random salt and the (much
    smaller) baseline side is repeated once per salt. Both sides come from
    one written join of runs and verdicts, whose shuffle files are gone
    before the sides are dealt out; neither side is ever broadcast.
    """
    if competition_id is not None:
        tasks = tasks.where(F.col("competition_id") == competition_id)
    if exclude_banned:
        entrants = entrants.where(~F.col("banned"))
    if hotkeys:
        entrants = entrants.where(F.col("hotkey").isin(hotkeys))
    salts = salt_count(runs.sparkSession)
    judged = through_parquet(with_verdicts(runs, validations).select(
        "run_id", "task_id", "entrant_id", "attempt_no", "tokens_used", "baseline_run", "resolved"), "pair-runs", release=True)
    task_cols = tasks.select("task_id", "task_name", "competition_id", "is_screener")
    base = judged.where("baseline_run").select(
        "task_id", F.col("run_id").alias("baseline_run_id"), F.col("tokens_used").alias("baseline_tokens"),
        F.col("resolved").alias("baseline_resolved"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    mine = (
        judged.where(~F.col("baseline_run"))
        .join(entrants.select("entrant_id", "hotkey", "banned"), "entrant_id")
        .select("task_id", "entrant_id", "hotkey", "banned", "run_id", "attempt_no",
                F.col("tokens_used").alias("run_tokens"), F.col("resolved").alias("run_resolved"),
                F.pmod(F.xxhash64("run_id"), F.lit(salts)).cast("int").alias("_salt")))
    return (shuffled(base.join(task_cols, "task_id"))
            .join(mine, ["task_id", "_salt"])
            .drop("_salt"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pair_score", pair_score(
        "baseline_resolved", "run_resolved", "baseline_tokens", "run_tokens"))


def judged_runs(runs: DataFrame, validations: DataFrame) -> DataFrame:
    """Every run (unique run_id) with its latest verdict and counts of its verdict rows.

    The one join of runs and verdicts behind run scores, cells, baselines,
    difficulty and screening; jobs that need several of them write it once.
    A run without a verdict row stays, pending, with counts of 0; verdicts
    without a ``scored_at`` column count as not scored.
    """
    scored = F.col("scored_at").isNotNull() if "scored_at" in validations.columns else F.lit(False)
    counts = {"n_verdicts": F.count(F.lit(1)), "v_pass": F.count_if(F.col("resolved")), "v_fail": F.count_if(~F.col("resolved")),
              "n_scored": F.count_if(scored), "n_scored_pass": F.count_if(F.coalesce("resolved", F.lit(False)) & scored)}
    verdicts = validations.groupBy("run_id").agg(
        F.max_by("resolved", "validation_id").alias("run_resolved"), *[c.alias(n) for n, c in counts.items()])
    cols = ["run_id", "task_id", "entrant_id", "attempt_no", "tokens_used", "baseline_run"]
    return runs.select(*cols).join(verdicts, "run_id", "left").select(
        *cols, "run_resolved", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts])


def pair_counts(tasks: DataFrame, runs: DataFrame, validations: DataFrame, entrants: DataFrame, exclude_banned: bool = False,
                hotkeys: list[str] | None = None, competition_id: int | None = None) -> DataFrame:
    """Per (task, hotkey) what `run_pairs` holds: ``n_pairs``, ``n_runs`` and ``n_base``, without a pair.

    Every row of a run meets every row of every baseline of its task, so the
    pairs of a group are a product of two counts. Runs move once and are
    counted per (task, entrant) before anything is joined.
    """
    if competition_id is not None:
        tasks = tasks.where(F.col("competition_id") == competition_id)
    if exclude_banned:
        entrants = entrants.where(~F.col("banned"))
    if hotkeys:
        entrants = entrants.where(F.col("hotkey").isin(hotkeys))
    # a run without a verdict is one row of `with_verdicts`, like one with a single verdict
    counted = judged_runs(runs, validations).where(F.col("baseline_run").isNotNull()).groupBy("task_id", "entrant_id", "baseline_run").agg(
        F.sum(F.greatest("n_verdicts", F.lit(1).cast("long"))).alias("n_rows"), F.count(F.lit(1)).alias("n"))
    counted = through_parquet(counted, "run-counts")
    base = counted.where("baseline_run").join(tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("_t")), "task_id").groupBy("task_id").agg(
        F.sum(F.col("n_rows") * F.col("_t")).alias("_base_rows"), F.sum("n").alias("n_base"))
    keys = entrants.groupBy("entrant_id", "hotkey").agg(F.count(F.lit(1)).alias("_e"))
    mine = counted.where(~F.col("baseline_run")).join(keys, "entrant_id").groupBy("task_id", "hotkey").agg(
        F.sum(F.col("n_rows") * F.col("_e")).alias("_rows"), F.sum("n").alias("n_runs"))
    return mine.join(base, "task_id").select(
        "task_id", "hotkey", (F.col("_rows") * F.col("_base_rows")).alias("n_pairs"), "n_runs", "n_base")


def judged_runs_written(runs: DataFrame, validations: DataFrame) -> DataFrame:
    return through_parquet(judged_runs(runs, validations), "judged-runs")


def judged_baselines(judged: DataFrame) -> DataFrame:
    """Per task: number of baselines, unanimous verdict or null, mean and sum of token counts.

    With several verdict rows per baseline the latest validation id counts.
    """
    verdict = F.col("run_resolved")
    return judged.where("baseline_run").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_baselines"),
        F.when((F.count(verdict) == F.count(F.lit(1))) & (F.min(verdict) == F.max(verdict)), F.min(verdict)).alias("baseline_pass"),
        F.avg("tokens_used").alias("baseline_tokens"),
        F.sum(F.when(F.col("tokens_used") > 0, F.col("tokens_used"))).alias("baseline_token_sum"))


def baseline_summary(runs: DataFrame, validations: DataFrame) -> DataFrame:
    """``judged_baselines`` straight from runs and verdicts."""
    return judged_baselines(judged_runs(runs.where("baseline_run"), validations))


def _entrant_runs(judged: DataFrame, entrants: DataFrame, exclude_banned: bool) -> DataFrame:
    if exclude_banned:
        entrants = entrants.where(~F.col("banned"))
    return judged.where(~F.col("baseline_run")).join(entrants.select("entrant_id", "hotkey", "banned"), "entrant_id")


def _baseline_points(judged: DataFrame) -> DataFrame:
    """Baselines of a task by token count: how many verdicts of each kind, and where they lie on the log axis."""
    x = F.ln(F.col("tokens").cast("double"))
    points = judged.where("baseline_run").groupBy("task_id", F.when(F.col("tokens_used") > 0, F.col("tokens_used")).alias("tokens")).agg(
        F.sum("v_pass").alias("n_pass"), F.sum("v_fail").alias("n_fail"))
    return through_parquet(points.select("task_id", x.alias("x"), F.floor(x * BUCKETS_PER_LOG).alias("bucket"), "n_pass", "n_fail"), "baseline-points")


def _profile(points: DataFrame, per_task: DataFrame) -> DataFrame:
    """State of every log bucket of a task: totals of all earlier buckets, and the bucket's own points.

    Points are distinct token counts, so a bucket holds at most the integers
    of 1 / BUCKETS_PER_LOG of a log unit, however many baselines there are.
    """
    zero = F.lit(0).cast("long")
    per_bucket = points.groupBy("task_id", "bucket").agg(
        F.sum("n_pass").alias("b_n_pass"), F.sum("n_fail").alias("b_n_fail"),
        F.sum(F.col("n_pass") * F.col("x")).alias("b_s_pass"), F.sum(F.col("n_fail") * F.col("x")).alias("b_s_fail"),
        F.collect_list(F.struct("x", "n_pass", "n_fail")).alias("points"))
    spine = per_task.select("task_id", F.explode(F.sequence("first_bucket", "last_bucket")).alias("bucket"))
    before = Window.partitionBy("task_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct(*[F.coalesce(F.sum(f"b_{m}").over(before), zero.cast("double") if m[0] == "s" else zero).alias(m)
                       for m in ("n_pass", "n_fail", "s_pass", "s_fail")])
    return spine.join(per_bucket, ["task_id", "bucket"], "left").select(
        "task_id", "bucket", start.alias("start"), "points")


def _state_at(edge: Column, start: Column, points: Column) -> Column:
    """Counts and log sums of all baselines at or below the edge."""
    def add(acc: Column, p: Column) -> Column:
        more = F.struct(
            (acc["n_pass"] + p["n_pass"]).alias("n_pass"), (acc["n_fail"] + p["n_fail"]).alias("n_fail"),
            (acc["s_pass"] + p["n_pass"] * p["x"]).alias("s_pass"), (acc["s_fail"] + p["n_fail"] * p["x"]).alias("s_fail"))
        return F.when(p["x"] <= edge, more).otherwise(acc)

    return F.when(points.isNull(), start).otherwise(F.aggregate(points, start, add))


def _against_baselines(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Score of every group of equal runs against all baselines of its task.

    ``groups``: task_id, tokens_used, v_pass, v_fail and any payload; runs in
    a group are interchangeable. Adds run_score; tasks without baselines drop out.

    With x the log token count, a baseline at distance <= -2 or >= 2 from the
    run contributes the limit itself, one in between contributes the
    distance. So the sum over baselines follows from the state (counts and
    sums of x) at the two edges x - 2 and x + 2, read from the log-bucket
    profile of the task by two equi joins. Cost is linear in runs plus
    baselines, never their product; a small profile broadcasts.
    """
    limit = LOG_RATIO_LIMIT
    zero = F.lit(0).cast("long")
    usable = F.col("x").isNotNull()
    per_task = points.groupBy("task_id").agg(
        F.sum("n_pass").alias("base_pass"), F.sum("n_fail").alias("base_fail"),
        F.sum(F.when(usable, F.col("n_pass")).otherwise(zero)).alias("with_pass"),
        F.sum(F.when(usable, F.col("n_fail")).otherwise(zero)).alias("with_fail"),
        (F.coalesce(F.min("bucket"), zero) - 1).alias("first_bucket"),
        (F.coalesce(F.max("bucket"), zero) + 1).alias("last_bucket"))
    # read at both edges
    profile = through_parquet(_profile(points, per_task), "baseline-profile")

    def at(edge: Column) -> Column:
        # an edge outside the span of the baselines reads the state at the end of the span
        return F.greatest(F.col("first_bucket"), F.least(F.col("last_bucket"), F.floor(edge * BUCKETS_PER_LOG)))

    x = F.ln(F.when(F.col("tokens_used") > 0, F.col("tokens_used")).cast("double"))
    placed = groups.join(per_task, "task_id").withColumn("x", x)
    placed = placed.withColumns({
        "low": F.when(F.col("x").isNotNull(), at(F.col("x") - limit)),
        "high": F.when(F.col("x").isNotNull(), at(F.col("x") + limit))})
    for side in ("low", "high"):
        placed = placed.join(profile.select(
            "task_id", F.col("bucket").alias(side), F.col("start").alias(f"{side}_start"), F.col("points").alias(f"{side}_points")),
            ["task_id", side], "left")
    placed = placed.withColumns({
        "below": _state_at(F.col("x") - limit, F.col("low_start"), F.col("low_points")),
        "upto": _state_at(F.col("x") + limit, F.col("high_start"), F.col("high_points"))})

    def log_sum(verdict: str) -> Column:
        n_below, n_upto = F.col("below")[f"n_{verdict}"], F.col("upto")[f"n_{verdict}"]
        middle = F.col("upto")[f"s_{verdict}"] - F.col("below")[f"s_{verdict}"] - (n_upto - n_below) * F.col("x")
        value = limit * (F.col(f"with_{verdict}") - n_upto - n_below) + middle
        # unusable token counts on the run side make every log ratio 0
        return F.when(F.col("x").isNotNull(), value).otherwise(0.0)

    def against(passed: bool) -> Column:
        up, down = OUTCOMES[(True, passed)], OUTCOMES[(False, passed)]
        return (up[0] * F.col("base_pass") + down[0] * F.col("base_fail")
                + up[1] * log_sum("pass") + down[1] * log_sum("fail"))

    weight = (F.col("v_pass") + F.col("v_fail")) * (F.col("base_pass") + F.col("base_fail"))
    score = (F.col("v_pass") * against(True) + F.col("v_fail") * against(False)) / F.nullif(weight, zero)
    return placed.select(*groups.columns, score.alias("run_score"))


def judged_run_scores(tasks: DataFrame, judged: DataFrame, entrants: DataFrame, exclude_banned: bool = False) -> DataFrame:
    """Mean pair score of every entrant run over the baselines of its task.

    One row per run of a task that has baselines; the score is null while
    no pair has both verdicts. Several verdict rows of one run average over
    all pairs they form, and the verdict shown is the latest.
    """
    mine = _entrant_runs(judged, entrants, exclude_banned)
    kinds = ["task_id", "tokens_used", "v_pass", "v_fail"]
    groups = mine.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n_runs"))
    facts = through_parquet(_against_baselines(_baseline_points(judged), groups), "run-kinds")
    scored = attach_facts(mine, facts, kinds, "n_runs", how="inner")
    return scored.join(tasks.select("task_id", "task_name", "competition_id", "is_screener"), "task_id").select(
        "entrant_id", "hotkey", "banned", "task_id", "task_name", "competition_id", "is_screener", "run_id",
        "attempt_no", "run_resolved", F.col("tokens_used").alias("run_tokens"), "run_score")


def run_scores(tasks: DataFrame, runs: DataFrame, validations: DataFrame, entrants: DataFrame,
               exclude_banned: bool = False) -> DataFrame:
    """``judged_run_scores`` straight from runs and verdicts, whose join is written once."""
    return judged_run_scores(tasks, judged_runs_written(runs, validations), entrants, exclude_banned)


def scored_cells(tasks: DataFrame, judged: DataFrame, entrants: DataFrame, exclude_banned: bool = False) -> DataFrame:
    """`task_cells` straight from the judged runs: equal runs are counted first, so no run is ever scored twice."""
    mine = _entrant_runs(judged, entrants, exclude_banned)
    groups = mine.groupBy("entrant_id", "hotkey", "task_id", "tokens_used", "run_resolved", "v_pass", "v_fail").agg(
        F.count(F.lit(1)).alias("n_runs"))
    scored = _against_baselines(_baseline_points(judged), groups)
    n = F.col("n_runs")
    known = F.col("run_score").isNotNull()
    tokens = F.col("tokens_used")
    return (
        scored.groupBy("entrant_id", "hotkey", "task_id").agg(
            F.sum(n).alias("n_runs"), F.sum(F.when(F.col("run_resolved"), n).otherwise(0)).alias("n_pass"),
            F.sum(F.col("run_score") * n).alias("score_sum"), F.sum(F.when(known, n).otherwise(0)).alias("n_scored"),
            F.sum(F.when(F.col("run_score") < 0, n).otherwise(0)).alias("n_negative"),
            (F.sum(tokens * n) / F.nullif(F.sum(F.when(tokens.isNotNull(), n)), F.lit(0))).alias("run_tokens"),
            F.sum(F.when(tokens > 0, tokens * n)).alias("run_token_sum"))
        .join(tasks.select("task_id", "task_name", "is_screener"), "task_id")
        .select("entrant_id", "hotkey", "task_id", "task_name", "is_screener", "n_runs", "n_pass", "score_sum",
                "n_scored", "n_negative", "run_tokens", "run_token_sum"))


def task_cells(scores: DataFrame) -> DataFrame:
    """Everything later stages need per (entrant, task), from a table of run scores."""
    return scores.groupBy("entrant_id", "hotkey", "task_id", "task_name", "is_screener").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("run_resolved")).alias("n_pass"),
        F.sum("run_score").alias("score_sum"), F.count("run_score").alias("n_scored"),
        F.count_if(F.col("run_score") < 0).alias("n_negative"), F.avg("run_tokens").alias("run_tokens"),
        F.sum(F.when(F.col("run_tokens") > 0, F.col("run_tokens"))).alias("run_token_sum"))


def mean_score() -> Column:
    """Mean run score of a cell."""
    return F.col("score_sum") / F.nullif("n_scored", F.lit(0))


def pooled_mean(condition: Column | None = None) -> Column:
    """Mean over all runs of the grouped cells, not a mean of means."""
    keep = F.lit(True) if condition is None else condition
    return F.sum(F.when(keep, F.col("score_sum"))) / F.nullif(F.sum(F.when(keep, F.col("n_scored"))), F.lit(0))


def task_results(cells: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per (entrant, task): majority verdict over all runs, mean score and tokens, adjusted score."""
    return cells.join(baselines, "task_id").withColumn("raw_score", mean_score()).select(
        "entrant_id", "hotkey", "task_id", "task_name", "is_screener", "n_runs", "n_pass",
        (F.col("n_pass") >= F.floor((F.col("n_runs") + 1) / 2)).alias("task_passed"), "raw_score",
        "baseline_pass", "baseline_tokens", "run_tokens",
        adjust_score("raw_score", F.floor("baseline_tokens"), F.floor("run_tokens")).alias("score"))


def entrant_totals() -> list[Column]:
    """Aggregates over (cells joined with baselines) of one entrant.

    Baseline tokens count once per task the entrant ran, run tokens once per run.
    """
    return [pooled_mean().alias("raw_total"), pooled_mean(F.col("is_screener")).alias("screener_score"),
            F.sum("baseline_token_sum").alias("baseline_token_sum"), F.sum("run_token_sum").alias("run_token_sum")]


def entrant_scores(cells: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per entrant: pooled mean over runs with the savings multiplier, and the plain screener mean."""
    joined = cells.join(baselines.select("task_id", "baseline_token_sum"), "task_id", "left")
    return joined.groupBy("entrant_id", "hotkey").agg(*entrant_totals()).withColumn(
        "total_score", adjust_score("raw_total", "baseline_token_sum", "run_token_sum"))
