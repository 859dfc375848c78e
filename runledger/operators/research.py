"""Gap, headroom, variance and risk reports; candidate gates.

Task scores: entrant, task_id, task_name, category, baseline_pass,
miner_pass, compression_ratio, score, broke_baseline, negative_score.
Run rows: entrant, task_id, category, run_pass, run_tokens, run_score.
A ratio of 0 means unknown throughout, as in the scoring rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.scale import keep_first, quantiles, same

# Fixed thresholds of the reports.
BARELY = 2.0
DEEP = 4.5
CLEAN_NEG = 1
DEEPER_FACTOR = 1.3
TASKS_TOTAL = 45


def ratio() -> Column:
    return F.nullif(F.col("compression_ratio"), F.lit(0.0))


def no_screeners(ts: DataFrame) -> DataFrame:
    return ts.where("category IS NULL OR category <> 'screener'")


def entrant_aggregates(ts: DataFrame) -> DataFrame:
    """Counts, mean and exact median ratio per entrant on non-screener tasks."""
    rows = no_screeners(ts)
    sums = rows.groupBy("entrant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("miner_pass")).alias("pass_n"),
        F.count_if(F.col("broke_baseline")).alias("broke_n"), F.count_if(F.col("negative_score")).alias("neg_n"),
        F.avg(ratio()).alias("mean_ratio"))
    return with_median(sums, rows.select("entrant", ratio().alias("_r")), ["entrant"], "_r", "median_ratio")


def with_median(sums: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach the exact median of ``value`` to one-row-per-key sums; null where a key has no value."""
    middle = quantiles(rows, keys, value, {name: 0.5}).select(*[F.col(k).alias(f"_m_{k}") for k in keys], name)
    if not keys:
        return sums.join(F.broadcast(middle), how="left")
    on = same([F.col(k) for k in keys], [F.col(f"_m_{k}") for k in keys])
    return sums.join(middle, on, "left").drop(*[f"_m_{k}" for k in keys])


def scoreboard(aggregates: DataFrame, totals: DataFrame) -> DataFrame:
    """Aggregates beside published totals. The report treats a total of 0 as missing; here only null sorts last."""
    return totals.join(aggregates, "entrant", "left").orderBy(F.col("total").desc_nulls_last(), F.col("entrant"))


def task_matrix(ts: DataFrame) -> DataFrame:
    """One row per task with a map keyed by entrant; a real class wins over screener or none."""
    one = keep_first(ts, ["task_id", "entrant"], [F.col("score").desc_nulls_last()])
    real = F.col("category").isNotNull() & (F.col("category") != "screener")
    cell = F.struct(F.col("miner_pass").alias("pass"), ratio().alias("ratio"), "score",
                    F.col("broke_baseline").alias("broke"), F.col("negative_score").alias("neg"), "baseline_pass")
    return one.groupBy("task_id", "task_name").agg(
        F.coalesce(F.max(F.when(real, F.col("category"))), F.max("category")).alias("category"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("entrant"), cell)))).alias("entrants"))


def fragile_tasks(ts: DataFrame, family: Sequence[str], focal: str) -> DataFrame:
    """Tasks where a family member broke the baseline, with who did and the worst score."""
    broken = no_screeners(ts).where(F.col("entrant").isin(list(family)) & F.col("broke_baseline"))
    return broken.groupBy("task_id", "task_name", "category").agg(
        F.array_sort(F.collect_set("entrant")).alias("broke_by"),
        F.bool_or(F.col("entrant") == focal).alias("focal_broke"), F.min("score").alias("severity"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entrant", F.struct(ratio().alias("ratio"), "score"))))).alias("detail"))


def proven_max_ratio(ts: DataFrame, peers: Sequence[str]) -> DataFrame:
    """Highest ratio among passing peers per task, first peer on ties."""
    good = ts.where(F.col("entrant").isin(list(peers)) & F.col("miner_pass") & ratio().isNotNull())
    best = keep_first(good, ["task_id"], [F.col("compression_ratio").desc(), F.col("entrant")])
    return best.select("task_id", F.col("compression_ratio").alias("proven_max_ratio"), F.col("entrant").alias("proven_by"))


def side(ts: DataFrame, entrant: str, prefix: str) -> DataFrame:
    """Passing rows with a known ratio of one entrant, columns prefixed."""
    return ts.where((F.col("entrant") == entrant) & F.col("miner_pass") & ratio().isNotNull()).select(
        "task_id", F.col("compression_ratio").alias(f"{prefix}_ratio"), F.col("score").alias(f"{prefix}_score"))


def shared_pass(ts: DataFrame, focal: str, ref: str, peers: Sequence[str]) -> DataFrame:
    """Tasks that focal and reference both pass: score gap, the part explained by ratio, headroom."""
    ts = no_screeners(ts)
    names = ts.where(F.col("entrant") == focal).select("task_id", "task_name", "category")
    joined = (side(ts, focal, "focal").join(side(ts, ref, "ref"), "task_id").join(names, "task_id")
              .join(proven_max_ratio(ts, peers), "task_id", "left"))
    gap = F.coalesce("ref_score", F.lit(0.0)) - F.coalesce("focal_score", F.lit(0.0))
    explained = 0.5 * F.ln(F.col("ref_ratio") / F.col("focal_ratio"))
    best = F.coalesce("proven_max_ratio", F.lit(0.0))
    return joined.select(
        "task_id", "task_name", "category", "focal_ratio", "focal_score", "ref_ratio", "ref_score",
        gap.alias("actual_score_gap"), explained.alias("ratio_explained_gap"), (gap - explained).alias("residual_gap"),
        best.alias("proven_max_ratio"), "proven_by",
        F.when(best > F.col("focal_ratio"), best / F.col("focal_ratio")).otherwise(1.0).alias("safe_headroom_x"))


def barely_compressed(ts: DataFrame, focal: str) -> DataFrame:
    """Passed tasks with a ratio below two, least compressed first."""
    return no_screeners(ts).where((F.col("entrant") == focal) & F.col("miner_pass") & (ratio() < BARELY)).select(
        "task_id", "task_name", "category", "compression_ratio", "score", "baseline_pass").orderBy("compression_ratio", "task_id")


def gap_decomposition(shared: DataFrame) -> DataFrame:
    """Mean gap per task, the part the ratio explains, the rest."""
    return shared.agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("actual_score_gap").alias("mean_gap"),
                      F.avg("ratio_explained_gap").alias("mean_explained"),
                      (F.avg("actual_score_gap") - F.avg("ratio_explained_gap")).alias("residual"))


def score_lift(shared: DataFrame, fragile: DataFrame, base: float = 0.0) -> DataFrame:
    """Gain still safe to take: proven higher ratios on tasks that are not fragile, over the fixed task count."""
    safe = shared.join(fragile.select("task_name"), "task_name", "left_anti").where(
        F.col("proven_max_ratio") > F.col("focal_ratio"))
    gain = 0.5 * F.ln(F.col("proven_max_ratio") / F.col("focal_ratio"))
    return safe.agg(F.count(F.lit(1)).alias("n_tasks"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("total_gain")).select(
        "n_tasks", "total_gain", (F.col("total_gain") / TASKS_TOTAL).alias("lift_per_task"),
        (F.lit(base) + F.col("total_gain") / TASKS_TOTAL).alias("projected"))


def run_variance(runs: DataFrame) -> DataFrame:
    """Spread per (entrant, task); groups without any score drop out; flaky = both outcomes seen."""
    tokens = F.nullif(F.col("run_tokens"), F.lit(0.0))
    return runs.groupBy("entrant", "task_id", "task_name", "category").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("run_pass")).alias("n_pass"),
        F.min("run_score").alias("score_min"), F.max("run_score").alias("score_max"),
        (F.max("run_score") - F.min("run_score")).alias("score_spread"), F.avg("run_score").alias("score_mean"),
        F.min(tokens).alias("tokens_min"), F.max(tokens).alias("tokens_max"),
        F.coalesce(F.min("run_pass") != F.max("run_pass"), F.lit(False)).alias("flaky")).where("score_mean IS NOT NULL")


def flaky_runs(variance: DataFrame, family: Sequence[str], n: int) -> DataFrame:
    """Flaky cells of the family, widest spread first."""
    return variance.where(F.col("entrant").isin(list(family)) & F.col("flaky")).orderBy(
        F.col("score_spread").desc(), "entrant", "task_id").limit(n)


def run_cells(runs: DataFrame) -> DataFrame:
    """Runs, negative runs (a missing score is not negative) and passes per (entrant, task)."""
    return runs.groupBy("entrant", "task_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("run_score"), F.lit(0.0)) < 0).alias("neg"),
        F.count_if(F.col("run_pass")).alias("passes"))


def negative_rate(runs: DataFrame, entrants: Sequence[str]) -> DataFrame:
    """Share of negative runs per class among scored runs of the given entrants."""
    return runs.where(F.col("entrant").isin(list(entrants)) & F.col("run_score").isNotNull()).groupBy("category").agg(
        F.avg(F.when(F.col("run_score") < 0, 1.0).otherwise(0.0)).alias("neg_rate"))


def category_gap(ts: DataFrame, runs: DataFrame, shared: DataFrame, focal: str, leaders: Sequence[str]) -> DataFrame:
    """Focal against the mean of leader means per class: scores, ratios, negative runs, breaks, shared-pass means."""
    leaders = list(leaders)
    classed = no_screeners(ts).where("category IS NOT NULL")
    mine = F.col("entrant") == focal
    theirs = F.col("entrant").isin(leaders)
    per_entrant = classed.where(mine | theirs).groupBy("category", "entrant").agg(
        F.avg("score").alias("score"), F.avg(ratio()).alias("ratio"), F.count_if(F.col("broke_baseline")).alias("broke"))
    per_class = per_entrant.groupBy("category").agg(
        F.max(F.when(mine, F.col("score"))).alias("focal_score"), F.avg(F.when(theirs, F.col("score"))).alias("leader_score"),
        F.max(F.when(mine, F.col("ratio"))).alias("focal_ratio"), F.avg(F.when(theirs, F.col("ratio"))).alias("leader_ratio"),
        F.max(F.when(mine, F.col("broke"))).alias("focal_broke"), F.sum(F.when(theirs, F.col("broke"))).alias("leader_broke"))
    tasks = classed.groupBy("category", "task_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("category").agg(
        F.count(F.lit(1)).alias("tasks"))
    neg = lambda who, name: negative_rate(runs, who).withColumnRenamed("neg_rate", name)
    means = shared.groupBy("category").agg(
        F.count(F.lit(1)).alias("shared_tasks"), F.avg("actual_score_gap").alias("shared_gap"),
        F.avg("ratio_explained_gap").alias("shared_explained"), F.avg("residual_gap").alias("shared_residual"))
    out = tasks.join(per_class, "category", "left")
    for part in (neg([focal], "focal_neg_rate"), neg(leaders, "leader_neg_rate"), means):
        out = out.join(part, "category", "left")
    return out.withColumn("score_gap", F.col("leader_score") - F.col("focal_score")).withColumn(
        "shared_tasks", F.coalesce("shared_tasks", F.lit(0)))


def counted_cells(cells: DataFrame) -> DataFrame:
    """`run_cells` from task cells, which counted the runs when they were scored: no run row is read again."""
    return cells.groupBy(F.col("hotkey").alias("entrant"), "task_id").agg(
        F.sum("n_runs").alias("n"), F.sum("n_negative").alias("neg"), F.sum("n_pass").alias("passes"))


def with_stability(ts: DataFrame, counts: DataFrame) -> DataFrame:
    """Task scores with the run counts of their cells; cells without runs drop out."""
    cols = ["entrant", "task_id", "task_name", "category", "miner_pass", "broke_baseline", "score"]
    return ts.select(*cols, ratio().alias("ratio")).join(counts, ["entrant", "task_id"]).withColumn(
        "neg_rate", F.col("neg") / F.col("n"))


def cells_with_runs(ts: DataFrame, runs: DataFrame) -> DataFrame:
    """``with_stability`` straight from run rows."""
    return with_stability(ts, run_cells(runs))


def _pearson(x: str, y: str) -> Column:
    """Correlation from moments; null under three points or without variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) >= 3) & (spread > 0), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def depth_correlations(cells: DataFrame, shared: DataFrame, entrants: Sequence[str]) -> DataFrame:
    """Ratio against negative rate, breaks and score on shared-pass tasks, overall and per class in one pass."""
    points = cells.where(F.col("entrant").isin(list(entrants)) & F.col("miner_pass") & F.col("ratio").isNotNull()).join(
        shared.select("task_id"), "task_id", "left_semi").select(
        "category", "ratio", "neg_rate", F.col("broke_baseline").cast("double").alias("broke"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    grouped = points.rollup("category").agg(
        F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n_points"),
        _pearson("ratio", "neg_rate").alias("ratio_vs_neg_rate"), _pearson("ratio", "broke").alias("ratio_vs_broke"),
        _pearson("ratio", "score").alias("ratio_vs_score"), F.avg("ratio").alias("mean_ratio"),
        F.avg("neg_rate").alias("mean_neg_rate"))
    return grouped.withColumn("category", F.when(F.col("_all") == 1, "overall").otherwise(F.col("category"))).drop("_all")


def deep_feasibility(cells: DataFrame, shared: DataFrame, leaders: Sequence[str]) -> DataFrame:
    """Share of shared-pass tasks on which some leader is deep and clean."""
    deep = cells.where(F.col("entrant").isin(list(leaders)) & F.col("miner_pass") & (F.col("ratio") >= DEEP)
                       & (F.col("neg") <= CLEAN_NEG)).select("task_id").distinct().withColumn("_deep", F.lit(1.0))
    return shared.select("task_id").join(deep, "task_id", "left").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count("_deep").alias("n_deep"),
        F.avg(F.coalesce("_deep", F.lit(0.0))).alias("share"))


def deeper_peers(cells: DataFrame, shared: DataFrame, focal: str, leaders: Sequence[str], factor: float = 1.0) -> DataFrame:
    """Passing leaders whose ratio on the same task exceeds the focal ratio (times ``factor``).

    An equality on the task with the inequality as residual; both sides are
    one row per task and entrant.
    """
    mine = cells.where(F.col("entrant") == focal).join(shared.select("task_id"), "task_id", "left_semi").select(
        "task_id", "task_name", "category", F.col("ratio").alias("focal_ratio"), F.col("score").alias("focal_score"),
        F.col("neg").alias("focal_neg"), F.col("n").alias("focal_n"), F.col("miner_pass").alias("focal_pass"))
    peers = cells.where(F.col("entrant").isin(list(leaders)) & F.col("miner_pass") & F.col("ratio").isNotNull()).select(
        "task_id", F.col("entrant").alias("leader"), F.col("ratio").alias("leader_ratio"), F.col("score").alias("leader_score"),
        F.col("neg").alias("leader_neg"), F.col("n").alias("leader_n"))
    above = (F.col("leader_ratio") > F.col("focal_ratio")) if factor == 1.0 else (
        F.col("leader_ratio") >= F.col("focal_ratio") * factor)
    return mine.join(peers, "task_id").where(above)


def best_clean_peer(pairs: DataFrame) -> DataFrame:
    """Deepest clean leader per task, any leader if none is clean."""
    clean = (F.col("leader_neg") <= CLEAN_NEG).alias("clean")
    return keep_first(pairs.withColumn("clean", clean), ["task_id"],
                      [F.col("clean").desc(), F.col("leader_ratio").desc(), F.col("leader")])


def risk_label(fragile: Column, focal_neg: Column, clean: Column, leader_neg: Column) -> Column:
    """safe / moderate / fragile with the reason."""
    label = (F.when(fragile | (focal_neg >= 2), "fragile")
             .when((focal_neg == 0) & clean & (leader_neg == 0), "safe").otherwise("moderate"))
    reason = (F.when(fragile, "baseline broken here before").when(focal_neg >= 2, "two or more negative runs")
              .when((focal_neg == 0) & clean & (leader_neg == 0), "clean here and proven clean deeper")
              .when(clean, "some negative runs").otherwise("no clean deeper run"))
    return F.struct(label.alias("label"), reason.alias("reason"))


def safe_targets(cells: DataFrame, shared: DataFrame, fragile: DataFrame, focal: str, leaders: Sequence[str]) -> DataFrame:
    """Tasks worth pushing, by risk then estimated lift."""
    best = best_clean_peer(deeper_peers(cells, shared, focal, leaders).where(F.col("focal_pass")))
    flagged = best.join(fragile.select("task_id").distinct().withColumn("_fragile", F.lit(True)), "task_id", "left")
    risk = risk_label(F.coalesce("_fragile", F.lit(False)), F.col("focal_neg"), F.col("clean"), F.col("leader_neg"))
    lift = 0.5 * F.ln(F.col("leader_ratio") / F.col("focal_ratio"))
    out = flagged.withColumns({"_risk": risk, "est_lift": lift}).select(
        "task_id", "task_name", "category", "focal_ratio", "leader", "leader_ratio", "focal_neg", "leader_neg", "est_lift",
        F.col("_risk.label").alias("risk"), F.col("_risk.reason").alias("reason"))
    order = F.when(F.col("risk") == "safe", 0).when(F.col("risk") == "moderate", 1).otherwise(2)
    return out.orderBy(order, F.col("est_lift").desc(), "task_id")


def under_compressed(shared: DataFrame, cells: DataFrame, focal: str, n: int = 10) -> DataFrame:
    """Per class the tasks with most proven gain where every focal run passes and none is negative."""
    stable = cells.where((F.col("entrant") == focal) & (F.col("neg") == 0) & (F.col("passes") == F.col("n"))).select("task_id")
    gain = 0.5 * F.ln(F.col("proven_max_ratio") / F.col("focal_ratio"))
    cands = shared.join(stable, "task_id", "left_semi").where(F.col("proven_max_ratio") > F.col("focal_ratio")).withColumn(
        "est_gain", gain)
    return keep_first(cands, ["category"], [F.col("est_gain").desc(), F.col("task_id")], n, rank_col="rank")


def largest_gaps(ts: DataFrame, focal: str, ref: str, category: str, n: int = 10) -> DataFrame:
    """Widest score gaps to the reference in one class."""
    scored = ts.where((F.col("category") == category) & F.col("score").isNotNull())
    mine = scored.where(F.col("entrant") == focal).select("task_id", "task_name", F.col("score").alias("focal_score"))
    theirs = scored.where(F.col("entrant") == ref).select("task_id", F.col("score").alias("ref_score"))
    return mine.join(theirs, "task_id").withColumn("gap", F.col("ref_score") - F.col("focal_score")).orderBy(
        F.col("gap").desc(), "task_id").limit(n)


def headroom(ts: DataFrame, target: str, family: Sequence[str] = ()) -> DataFrame:
    """Tier (SAFE if the baseline passed, else RECOVERED) and proven gain per passed task of the target."""
    mine = ts.where((F.col("entrant") == target) & F.col("miner_pass") & ratio().isNotNull())
    rivals = ts.where((F.col("entrant") != target) & ~F.col("entrant").isin(list(family)) & F.col("miner_pass")
                      & ratio().isNotNull())
    best = keep_first(rivals, ["task_id"], [F.col("compression_ratio").desc(), F.col("entrant")]).select(
        "task_id", F.col("compression_ratio").alias("best_ratio"), F.col("entrant").alias("best_by"))
    r, b = F.col("compression_ratio"), F.coalesce("best_ratio", F.lit(0.0))
    out = mine.join(best, "task_id", "left").select(
        "task_id", "task_name", F.when(F.coalesce("baseline_pass", F.lit(False)), "SAFE").otherwise("RECOVERED").alias("tier"),
        r.alias("ratio"), "best_ratio", "best_by", F.when(b > r, 0.5 * F.ln(b / r)).otherwise(0.0).alias("gain"))
    return out.withColumn("tier", F.when(F.col("gain") > 0, F.col("tier")).otherwise("none")).orderBy(
        F.col("gain").desc(), "task_id")


def subset_metrics(rows: DataFrame) -> DataFrame:
    """Headline metrics of a set of task rows."""
    n = F.count(F.lit(1))
    sums = rows.agg(
        n.alias("n_tasks"), (F.count_if(F.col("miner_pass")) / F.nullif(n, F.lit(0))).alias("pass_rate"),
        F.count_if(F.col("broke_baseline")).alias("broke"), F.count_if(F.col("negative_score")).alias("negative"),
        F.avg(ratio()).alias("avg_ratio"), F.avg("score").alias("score"))
    return with_median(sums, rows.select(ratio().alias("_r")), [], "_r", "median_ratio")


def join_candidate(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """Candidate rows joined to the baseline by the trailing number of the task name."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit(""))
    b = base.select(number(F.col("task_name")).alias("num"), "task_name", F.col("category").alias("base_category"),
                    ratio().alias("base_ratio"), F.col("score").alias("base_score"), F.col("broke_baseline").alias("base_broke"))
    joined = candidate.withColumn("num", number(F.col("task"))).join(b, "num")
    return joined.withColumn("category", F.coalesce("category", "base_category")).withColumn(
        "new_broke", F.coalesce("broke", F.lit(False)) & ~F.coalesce("base_broke", F.lit(False))).drop("base_category")


def changed_tasks(candidate: DataFrame, base: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Tasks whose score moved by more than the tolerance."""
    b = base.select("task_id", F.col("score").alias("base_score"))
    return candidate.select("task_id", "score").join(b, "task_id").where(F.abs(F.col("score") - F.col("base_score")) > tol)


def candidate_metrics(rows: DataFrame) -> DataFrame:
    """Metrics overall and per class; the negative rate pools runs."""
    n = F.count(F.lit(1))
    r = F.nullif(F.col("ratio"), F.lit(0.0))
    out = rows.rollup("category").agg(
        F.grouping("category").alias("_all"), n.alias("n"), (F.count_if(F.col("pass")) / n).alias("pass_rate"),
        F.coalesce(F.sum("neg_runs") / F.nullif(F.sum("n_runs"), F.lit(0)), F.lit(0.0)).alias("neg_rate"),
        F.count_if(F.col("broke")).alias("broke"), F.count_if(F.col("new_broke")).alias("new_broke"),
        F.count_if(F.coalesce(F.col("score"), F.lit(0.0)) < 0).alias("negative"), F.avg(r).alias("avg_ratio"),
        F.avg("score").alias("avg_score"),
        F.count_if(F.col("pairing_error")).alias("pairing_errors"), F.count_if(F.col("missing_patch")).alias("missing_patch"))
    # every row counts for its class and for the whole
    both = F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("_all"), F.col("category").alias("category")),
                             F.struct(F.lit(1).cast("tinyint").alias("_all"), F.lit(None).cast("string").alias("category"))))
    out = with_median(out, rows.select(both.alias("g"), r.alias("_r")).select("g.*", "_r"), ["_all", "category"], "_r", "median_ratio")
    return out.withColumn("category", F.when(F.col("_all") == 1, "overall").otherwise(F.col("category"))).drop("_all")


def full_gate(rows: DataFrame, fragile_rows: DataFrame, base: DataFrame, min_gain: float = 0.08, margin: float = 0.05) -> DataFrame:
    """Five checks of a candidate against the baseline, one row each, with the joint decision.

    ``base``: one row with avg_ratio, medium_neg_rate, medium_score.
    """
    metrics = candidate_metrics(rows)
    overall = metrics.where("category = 'overall'").select("new_broke", "avg_ratio", "pairing_errors", "missing_patch")
    medium = metrics.where("category = 'Medium'").select(F.col("neg_rate").alias("m_neg"), F.col("avg_score").alias("m_score"))
    frag = fragile_rows.agg(F.count_if(F.col("new_broke")).alias("f_broke"),
                            F.count_if(F.col("pairing_error") | F.col("missing_patch")).alias("f_bad"))
    one = base.select(F.col("avg_ratio").alias("b_ratio"), F.coalesce("medium_neg_rate", F.lit(0.0)).alias("b_neg"),
                      F.col("medium_score").alias("b_score"))
    for part in (overall, medium.agg(F.max("m_neg").alias("m_neg"), F.max("m_score").alias("m_score")), frag):
        one = one.crossJoin(F.broadcast(part))  # every part is a single row
    gain = F.col("avg_ratio") / F.nullif("b_ratio", F.lit(0.0)) - 1
    breaks = F.col("new_broke") + F.col("f_broke")
    faults = F.col("pairing_errors") + F.col("missing_patch") + F.col("f_bad")
    checks = [
        ("no new broken baseline", breaks > 0, breaks.cast("double")),
        ("compression improves", ~F.coalesce(gain >= min_gain, F.lit(False)), gain),
        ("medium negative runs not up", F.coalesce("m_neg", F.lit(0.0)) - F.col("b_neg") > margin, F.col("m_neg")),
        ("medium score does not drop", F.coalesce(F.col("m_score") < F.col("b_score"), F.lit(False)), F.col("m_score")),
        ("no integrity errors", faults > 0, faults.cast("double"))]
    listed = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), bad.alias("rejected"), value.cast("double").alias("value")) for n, bad, value in checks])))
    verdict = listed.agg(F.bool_or("rejected").alias("_any"))
    return listed.crossJoin(F.broadcast(verdict)).select(
        "check", "rejected", "value", F.when(F.col("_any"), "REJECT").otherwise("ACCEPT").alias("decision"))


def subset_gate(candidate: DataFrame, base: DataFrame, max_new_breaks: float = 0, min_ratio_gain: float = 0.3) -> DataFrame:
    """Three checks on `subset_metrics` rows of candidate and baseline."""
    c = candidate.select(F.col("broke").alias("c_broke"), F.col("avg_ratio").alias("c_ratio"), F.col("score").alias("c_score"))
    b = base.select(F.col("broke").alias("b_broke"), F.col("avg_ratio").alias("b_ratio"), F.col("score").alias("b_score"))
    known = lambda x: F.coalesce(x, F.lit(False))
    checks = [("broken baselines", F.col("c_broke") - F.col("b_broke") > max_new_breaks, "REJECT"),
              ("ratio improvement", known(F.col("c_ratio") - F.col("b_ratio") < min_ratio_gain), "REJECT"),
              ("score estimate", known(F.col("c_score") < F.col("b_score")), "WARN")]
    return c.crossJoin(F.broadcast(b)).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.when(bad, F.lit(word)).otherwise("PASS").alias("verdict")) for n, bad, word in checks])))


def project_uplift(base: DataFrame, profiles: DataFrame) -> DataFrame:
    """Offline uplift p applied to the baseline ratio: ratio x (1 + p), score + 0.5 ln(1 + p)."""
    return base.crossJoin(F.broadcast(profiles)).select(
        *base.columns, "profile", (F.col("avg_ratio") * (1 + F.col("p"))).alias("projected_ratio"),
        (0.5 * F.ln(1 + F.col("p"))).alias("score_delta"))


def profile_compare(cases: DataFrame, base_label: str) -> DataFrame:
    """Every profile against the base over harvest cases: mean gain, improved, regressed, guarded cases.

    ``cases``: label, case, mode, ratio.
    """
    b = cases.where(F.col("label") == base_label).select("case", F.col("ratio").alias("b_ratio"), F.col("mode").alias("b_mode"))
    joined = cases.join(b, "case").where("b_mode = 'harvest'")
    used = (F.col("mode") == "harvest") & (F.col("b_ratio") > 1.05) & (F.col("ratio") != 0)
    rel = F.when(used, F.col("ratio") / F.nullif("b_ratio", F.lit(0.0)))
    return joined.withColumn("_rel", rel).groupBy("label").agg(
        F.count("_rel").alias("n_cases"), F.avg(F.col("_rel") - 1).alias("mean_pct"),
        F.avg(0.5 * F.ln("_rel")).alias("mean_lift"), F.count_if(F.col("_rel") > 1.005).alias("improved"),
        F.count_if(F.col("_rel") < 0.995).alias("regressed"), F.count_if(F.col("mode") == "rich").alias("guarded"))


def summarize_experiments(metrics: DataFrame) -> DataFrame:
    """One line per experiment run: what was measured and which subsets it covered."""
    return metrics.select("experiment_id", F.concat_ws("+", "subsets").alias("subsets"), "n_tasks", "avg_ratio", "score",
                          F.when(F.col("score").isNull(), "needs data").otherwise("measured").alias("status"))


def coverage(ts: DataFrame) -> DataFrame:
    """Rows without class and tasks with a real class."""
    per_task = ts.groupBy("task_id").agg(
        F.bool_or(F.col("category").isNotNull() & (F.col("category") != "screener")).alias("real"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("category").isNull()).alias("no_category"))
    return per_task.agg(F.sum("n").alias("n_rows"), F.sum("no_category").alias("no_category"),
                        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.coalesce("real", F.lit(False))).alias("classed_tasks"))


def resolve_subsets(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct task ids of the wanted subsets; a subset nobody knows comes back with a null task.

    ``members``: subset, task_id. ``wanted``: subset.
    """
    joined = wanted.distinct().join(members, "subset", "left")
    return joined.groupBy("task_id").agg(F.min(F.when(F.col("task_id").isNull(), F.col("subset"))).alias("missing_subset"))


def target_list(focal: DataFrame, leaders: DataFrame, pattern: str) -> DataFrame:
    """Focal keys, then leaders, each once at its first position, valid keys only. Inputs: hotkey, pos."""
    both = focal.select("hotkey", F.lit(0).alias("src"), "pos").unionByName(leaders.select("hotkey", F.lit(1).alias("src"), "pos"))
    return both.where(F.col("hotkey").rlike(pattern)).groupBy("hotkey").agg(F.min(F.struct("src", "pos")).alias("at")).select(
        "hotkey", "at.src", "at.pos")
