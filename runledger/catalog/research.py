"""Research queries over task scores and run rows derived from the scoring jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.catalog.scoring import baselines, classes, run_scores, task_cells
from runledger.operators import pairs
from runledger.operators import research as R
from runledger.session import through_parquet

FOCAL, REF = "E0", "E1"
LEADERS = ("E1", "E2", "E3", "E4")
FAMILY = ("E0", "E5")
LEADER_SQL = "('E1', 'E2', 'E3', 'E4')"


def task_scores(v, scores=None, cells=None):
    """Task scores as the reports read them, written once per query (entrants x tasks rows); from run scores or cells where the report has them."""
    from runledger.functions.scoring import broke_baseline, compression_ratio, negative_score

    if cells is None:
        cells = task_cells(v) if scores is None else pairs.task_cells(scores)
    results = pairs.task_results(cells, baselines(v)).join(classes(v).select("task_id", "category"), "task_id", "left")
    base_pass = F.col("baseline_tokens") >= 52000
    return through_parquet(results.select(
        F.col("hotkey").alias("entrant"), "hotkey", "task_id", "task_name",
        F.when(F.col("is_screener"), "screener").otherwise(F.col("category")).alias("category"),
        base_pass.alias("baseline_pass"), F.col("task_passed").alias("miner_pass"), "baseline_tokens",
        F.col("run_tokens").alias("miner_tokens"), compression_ratio("baseline_tokens", "run_tokens").alias("compression_ratio"),
        "score", broke_baseline(base_pass, "task_passed").alias("broke_baseline"),
        negative_score("score").alias("negative_score")), "task-scores")


def run_rows(v, scores=None):
    runs = (run_scores(v) if scores is None else scores).join(classes(v).select("task_id", "category"), "task_id", "left")
    return runs.select(
        F.col("hotkey").alias("entrant"), "hotkey", "task_id", "task_name",
        F.when(F.col("is_screener"), "screener").otherwise(F.col("category")).alias("category"), "attempt_no", "run_id",
        F.col("run_resolved").alias("run_pass"), F.col("run_tokens").cast("double").alias("run_tokens"), "run_score")


def stable_scores(v):
    """Task scores, and the same with run stability: runs are scored and counted once, in cells that are written once."""
    cells = through_parquet(task_cells(v), "task-cells")
    ts = task_scores(v, cells=cells)
    return ts, R.with_stability(ts, R.counted_cells(cells))


TS = "(SELECT *, nullif(compression_ratio, 0) AS ratio FROM fx_task_scores WHERE category IS NULL OR category <> 'screener')"

SHARED_SQL = f"""
    SELECT f.task_id, f.task_name, f.category, f.ratio AS focal_ratio, f.score AS focal_score, r.ratio AS ref_ratio, r.score AS ref_score,
           coalesce(r.score, 0) - coalesce(f.score, 0) AS actual_score_gap, 0.5 * ln(r.ratio / f.ratio) AS ratio_explained_gap,
           coalesce(r.score, 0) - coalesce(f.score, 0) - 0.5 * ln(r.ratio / f.ratio) AS residual_gap,
           coalesce(p.ratio, 0) AS proven_max_ratio, p.entrant AS proven_by,
           CASE WHEN coalesce(p.ratio, 0) > f.ratio THEN p.ratio / f.ratio ELSE 1.0 END AS safe_headroom_x
    FROM {TS} f JOIN {TS} r ON r.task_id = f.task_id AND r.entrant = 'E1' AND r.miner_pass AND r.ratio IS NOT NULL
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ratio DESC, entrant) AS rn FROM {TS}
               WHERE entrant IN {LEADER_SQL} AND miner_pass AND ratio IS NOT NULL) WHERE rn = 1) p ON p.task_id = f.task_id
    WHERE f.entrant = 'E0' AND f.miner_pass AND f.ratio IS NOT NULL"""

CELLS_SQL = """
    SELECT t.*, nullif(t.compression_ratio, 0) AS ratio, r.n, r.neg, r.passes, r.neg / r.n AS neg_rate
    FROM fx_task_scores t JOIN (SELECT entrant, task_id, count(*) AS n, count(*) FILTER (WHERE coalesce(run_score, 0) < 0) AS neg,
         count(*) FILTER (WHERE run_pass) AS passes FROM fx_research_runs GROUP BY ALL) r ON r.entrant = t.entrant AND r.task_id = t.task_id"""

FRAGILE_SQL = f"""
    SELECT task_id, task_name, category, string_agg(entrant, ',' ORDER BY entrant) AS broke_by, bool_or(entrant = 'E0') AS focal_broke,
           min(score) AS severity FROM {TS} WHERE entrant IN ('E0', 'E5') AND broke_baseline GROUP BY ALL"""


def shared(ts):
    return R.shared_pass(ts, FOCAL, REF, LEADERS)


@query("agg24_entrant_aggregates", f"""
    SELECT entrant, count(*) AS n, count(*) FILTER (WHERE miner_pass) AS pass_n, count(*) FILTER (WHERE broke_baseline) AS broke_n,
           count(*) FILTER (WHERE negative_score) AS neg_n, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio
    FROM {TS} GROUP BY entrant""")
def agg24(v):
    return rounded(R.entrant_aggregates(task_scores(v)), "mean_ratio", "median_ratio")


@query("agg40_task_matrix", """
    SELECT task_id, task_name, max(category) AS category, string_agg(entrant || ':' || CASE WHEN miner_pass THEN 'pass' ELSE 'fail' END
           || ':' || CASE WHEN broke_baseline THEN 'broke' ELSE 'kept' END, ',' ORDER BY entrant) AS cells
    FROM fx_task_scores GROUP BY task_id, task_name""")
def agg40(v):
    m = R.task_matrix(task_scores(v))
    cell = lambda e: F.concat_ws(
        ":", e["key"], F.when(e["value"]["pass"], "pass").otherwise("fail"), F.when(e["value"]["broke"], "broke").otherwise("kept"))
    return m.select("task_id", "task_name", "category",
                    F.array_join(F.transform(F.array_sort(F.map_entries("entrants")), cell), ",").alias("cells"))


@query("agg41_fragile_tasks", f"SELECT task_id, task_name, category, broke_by, focal_broke, round(severity, 6) AS severity FROM ({FRAGILE_SQL})")
def agg41(v):
    f = R.fragile_tasks(task_scores(v), FAMILY, FOCAL)
    return rounded(f.select("task_id", "task_name", "category", F.array_join("broke_by", ",").alias("broke_by"), "focal_broke",
                            "severity"), "severity")


@query("joi17_shared_pass", f"""
    SELECT task_id, task_name, category, round(actual_score_gap, 6) AS actual_score_gap, round(ratio_explained_gap, 6) AS ratio_explained_gap,
           round(residual_gap, 6) AS residual_gap, proven_by, round(safe_headroom_x, 6) AS safe_headroom_x FROM ({SHARED_SQL})""")
def joi17(v):
    return rounded(shared(task_scores(v)).select(
        "task_id", "task_name", "category", "actual_score_gap", "ratio_explained_gap", "residual_gap", "proven_by",
        "safe_headroom_x"), "actual_score_gap", "ratio_explained_gap", "residual_gap", "safe_headroom_x")


@query("win10_proven_max_ratio", f"""
    SELECT task_id, ratio AS proven_max_ratio, entrant AS proven_by FROM (
      SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ratio DESC, entrant) AS rn FROM {TS}
      WHERE entrant IN {LEADER_SQL} AND miner_pass AND ratio IS NOT NULL) WHERE rn = 1""")
def win10(v):
    return R.proven_max_ratio(R.no_screeners(task_scores(v)), LEADERS)


@query("top11_barely_compressed", f"""
    SELECT task_id, compression_ratio, round(score, 6) AS score FROM {TS} WHERE entrant = 'E0' AND miner_pass AND ratio < 2""")
def top11(v):
    return rounded(R.barely_compressed(task_scores(v), FOCAL).select("task_id", "compression_ratio", "score"), "score")


@query("agg42_gap_decomposition", f"""
    SELECT count(*) AS n_tasks, round(avg(actual_score_gap), 6) AS mean_gap, round(avg(ratio_explained_gap), 6) AS mean_explained,
           round(avg(actual_score_gap) - avg(ratio_explained_gap), 6) AS residual FROM ({SHARED_SQL})""")
def agg42(v):
    return rounded(R.gap_decomposition(shared(task_scores(v))), "mean_gap", "mean_explained", "residual")


@query("agg43_score_lift", f"""
    SELECT count(*) AS n_tasks, round(coalesce(sum(g), 0), 6) AS total_gain, round(coalesce(sum(g), 0) / 45, 6) AS lift_per_task,
           round(1.5 + coalesce(sum(g), 0) / 45, 6) AS projected
    FROM (SELECT 0.5 * ln(proven_max_ratio / focal_ratio) AS g FROM ({SHARED_SQL}) s
          WHERE proven_max_ratio > focal_ratio AND task_name NOT IN (SELECT task_name FROM ({FRAGILE_SQL})))""")
def agg43(v):
    ts = task_scores(v)
    return rounded(R.score_lift(shared(ts), R.fragile_tasks(ts, FAMILY, FOCAL), 1.5), "total_gain", "lift_per_task", "projected")


VARIANCE_SQL = """
    SELECT entrant, task_id, category, count(*) AS n_runs, count(*) FILTER (WHERE run_pass) AS n_pass, min(run_score) AS score_min,
           max(run_score) AS score_max, max(run_score) - min(run_score) AS score_spread, avg(run_score) AS score_mean,
           min(nullif(run_tokens, 0)) AS tokens_min, max(nullif(run_tokens, 0)) AS tokens_max,
           coalesce(bool_or(run_pass) AND NOT bool_and(run_pass), FALSE) AS flaky
    FROM fx_research_runs GROUP BY entrant, task_id, task_name, category HAVING count(run_score) > 0"""


@query("agg21_run_variance", f"""
    SELECT entrant, task_id, category, n_runs, n_pass, round(score_min, 6) + 0.0 AS score_min, round(score_max, 6) + 0.0 AS score_max,
           round(score_spread, 6) AS score_spread, round(score_mean, 6) + 0.0 AS score_mean, tokens_min, tokens_max, flaky FROM ({VARIANCE_SQL})""")
def agg21(v):
    return rounded(R.run_variance(run_rows(v)).drop("task_name"), "score_min", "score_max", "score_spread", "score_mean")


@query("top12_flaky_runs", f"""
    SELECT entrant, task_id, n_runs, n_pass, round(score_spread, 6) AS score_spread FROM ({VARIANCE_SQL})
    WHERE entrant IN ('E0', 'E5') AND flaky ORDER BY round(score_spread, 9) DESC, entrant, task_id LIMIT 20""")
def top12(v):
    variance = R.run_variance(run_rows(v)).withColumn("score_spread", F.round("score_spread", 9))
    return rounded(R.flaky_runs(variance, FAMILY, 20).select("entrant", "task_id", "n_runs", "n_pass", "score_spread"), "score_spread")


@query("agg22_run_cells", """
    SELECT entrant, task_id, count(*) AS n, count(*) FILTER (WHERE coalesce(run_score, 0) < 0) AS neg, count(*) FILTER (WHERE run_pass) AS passes
    FROM fx_research_runs GROUP BY ALL""")
def agg22(v):
    return R.run_cells(run_rows(v))


@query("agg23_negative_rate", f"""
    SELECT category, round(avg(CASE WHEN run_score < 0 THEN 1.0 ELSE 0.0 END), 6) AS neg_rate FROM fx_research_runs
    WHERE entrant IN {LEADER_SQL} AND run_score IS NOT NULL GROUP BY category""")
def agg23(v):
    return rounded(R.negative_rate(run_rows(v), LEADERS), "neg_rate")


@query("agg25_category_gap", f"""
    WITH e AS (SELECT category, entrant, avg(score) AS score, avg(ratio) AS ratio, count(*) FILTER (WHERE broke_baseline) AS broke
               FROM {TS} WHERE category IS NOT NULL AND (entrant = 'E0' OR entrant IN {LEADER_SQL}) GROUP BY ALL),
    neg AS (SELECT category, avg(CASE WHEN run_score < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE entrant = 'E0') AS f,
                   avg(CASE WHEN run_score < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE entrant IN {LEADER_SQL}) AS l
            FROM fx_research_runs WHERE run_score IS NOT NULL GROUP BY 1),
    sh AS (SELECT category, count(*) AS n, avg(actual_score_gap) AS gap FROM ({SHARED_SQL}) GROUP BY 1)
    SELECT t.category, t.tasks, round(avg(score) FILTER (WHERE entrant <> 'E0') - max(score) FILTER (WHERE entrant = 'E0'), 6) AS score_gap,
           round(max(ratio) FILTER (WHERE entrant = 'E0'), 6) AS focal_ratio, round(avg(ratio) FILTER (WHERE entrant <> 'E0'), 6) AS leader_ratio,
           round(any_value(neg.f), 6) AS focal_neg_rate, round(any_value(neg.l), 6) AS leader_neg_rate,
           max(broke) FILTER (WHERE entrant = 'E0') AS focal_broke, CAST(sum(broke) FILTER (WHERE entrant <> 'E0') AS BIGINT) AS leader_broke,
           coalesce(any_value(sh.n), 0) AS shared_tasks, round(any_value(sh.gap), 6) AS shared_gap
    FROM (SELECT category, count(DISTINCT task_id) AS tasks FROM {TS} WHERE category IS NOT NULL GROUP BY 1) t
    LEFT JOIN e ON e.category = t.category LEFT JOIN neg ON neg.category = t.category LEFT JOIN sh ON sh.category = t.category
    GROUP BY t.category, t.tasks""")
def agg25(v):
    # runs are scored once; cells and run rows both come from the written scores
    scores = through_parquet(run_scores(v), "run-scores")
    ts = task_scores(v, scores)
    gap = R.category_gap(ts, run_rows(v, scores), shared(ts), FOCAL, LEADERS)
    return rounded(gap.select("category", "tasks", "score_gap", "focal_ratio", "leader_ratio", "focal_neg_rate", "leader_neg_rate",
                              "focal_broke", "leader_broke", "shared_tasks", "shared_gap"),
                   "score_gap", "focal_ratio", "leader_ratio", "focal_neg_rate", "leader_neg_rate", "shared_gap")


@query("agg26_depth_correlations", f"""
    WITH p AS (SELECT category, ratio, neg_rate, CAST(broke_baseline AS INTEGER) AS broke, coalesce(score, 0) AS score FROM ({CELLS_SQL})
               WHERE (entrant = 'E0' OR entrant IN {LEADER_SQL}) AND miner_pass AND ratio IS NOT NULL
                 AND task_id IN (SELECT task_id FROM ({SHARED_SQL})))
    SELECT coalesce(category, 'overall') AS category, count(*) AS n_points,
           CASE WHEN count(*) >= 3 AND stddev_pop(neg_rate) > 0 THEN round(corr(ratio, neg_rate), 6) END AS ratio_vs_neg_rate,
           CASE WHEN count(*) >= 3 AND stddev_pop(broke) > 0 THEN round(corr(ratio, broke), 6) END AS ratio_vs_broke,
           CASE WHEN count(*) >= 3 AND stddev_pop(score) > 0 THEN round(corr(ratio, score), 6) END AS ratio_vs_score,
           round(avg(ratio), 6) AS mean_ratio
    FROM p GROUP BY ROLLUP (category)""")
def agg26(v):
    ts, cells = stable_scores(v)
    c = R.depth_correlations(cells, shared(ts), (FOCAL, *LEADERS))
    cols = ["ratio_vs_neg_rate", "ratio_vs_broke", "ratio_vs_score", "mean_ratio"]
    return rounded(c.select("category", "n_points", *cols), *cols)


# Run counts per cell are far above the reports' five, so the clean bound is scaled in the derived cells.
def scaled_cells(v):
    ts, cells = stable_scores(v)
    return ts, through_parquet(cells.withColumn("neg", F.floor(F.col("neg") / 12)), "cells")


SCALED = f"(SELECT * EXCLUDE (neg), CAST(floor(neg / 12) AS BIGINT) AS neg FROM ({CELLS_SQL}))"


@query("agg27_deep_feasibility", f"""
    SELECT count(*) AS n_tasks, count(*) FILTER (WHERE d) AS n_deep, round(avg(CAST(d AS INTEGER)), 6) AS share
    FROM (SELECT s.task_id, s.task_id IN (SELECT task_id FROM {SCALED} WHERE entrant IN {LEADER_SQL} AND miner_pass AND ratio >= 4.5 AND neg <= 1) AS d
          FROM ({SHARED_SQL}) s)""")
def agg27(v):
    ts, cells = scaled_cells(v)
    return rounded(R.deep_feasibility(cells, shared(ts), LEADERS), "share")


DEEPER_SQL = f"""
    SELECT f.task_id, f.task_name, f.category, f.ratio AS focal_ratio, f.neg AS focal_neg, l.entrant AS leader, l.ratio AS leader_ratio,
           l.neg AS leader_neg, f.miner_pass AS focal_pass
    FROM {SCALED} f JOIN {SCALED} l ON l.task_id = f.task_id AND l.entrant IN {LEADER_SQL} AND l.miner_pass AND l.ratio IS NOT NULL
    WHERE f.entrant = 'E0' AND f.task_id IN (SELECT task_id FROM ({SHARED_SQL})) AND l.ratio > f.ratio"""


@query("joi18_deeper_peers", f"SELECT task_id, leader, focal_ratio, leader_ratio, focal_neg, leader_neg FROM ({DEEPER_SQL})")
def joi18(v):
    ts, cells = scaled_cells(v)
    return R.deeper_peers(cells, shared(ts), FOCAL, LEADERS).select(
        "task_id", "leader", "focal_ratio", "leader_ratio", "focal_neg", "leader_neg")


BEST_SQL = f"""
    SELECT * FROM (SELECT *, leader_neg <= 1 AS clean, row_number() OVER (PARTITION BY task_id ORDER BY leader_neg <= 1 DESC, leader_ratio DESC, leader) AS rn
      FROM ({DEEPER_SQL})) WHERE rn = 1"""


@query("win11_best_clean_peer", f"SELECT task_id, leader, leader_ratio, clean FROM ({BEST_SQL})")
def win11(v):
    ts, cells = scaled_cells(v)
    pairs_ = R.deeper_peers(cells, shared(ts), FOCAL, LEADERS)
    return R.best_clean_peer(pairs_).select("task_id", "leader", "leader_ratio", "clean")


@query("prj23_risk_label", """
    SELECT event_id, CASE WHEN k % 7 = 0 OR k % 4 >= 2 THEN 'fragile' WHEN k % 4 = 0 AND k % 3 <> 0 AND k % 5 = 0 THEN 'safe' ELSE 'moderate' END AS label
    FROM fx_pairs_trace""")
def prj23(v):
    k = F.col("k")
    return v.trace_pairs.select("event_id", R.risk_label(k % 7 == 0, k % 4, k % 3 != 0, k % 5)["label"].alias("label"))


@query("top7_safe_targets", f"""
    SELECT task_id, leader, round(0.5 * ln(leader_ratio / focal_ratio), 6) AS est_lift,
           CASE WHEN task_id IN (SELECT task_id FROM ({FRAGILE_SQL})) OR focal_neg >= 2 THEN 'fragile'
                WHEN focal_neg = 0 AND clean AND leader_neg = 0 THEN 'safe' ELSE 'moderate' END AS risk
    FROM ({BEST_SQL}) WHERE focal_pass""")
def top7(v):
    ts, cells = scaled_cells(v)
    out = R.safe_targets(cells, shared(ts), R.fragile_tasks(ts, FAMILY, FOCAL), FOCAL, LEADERS)
    return rounded(out.select("task_id", "leader", "est_lift", "risk"), "est_lift")


@query("top8_under_compressed", f"""
    SELECT category, task_id, round(est_gain, 6) AS est_gain, CAST(rn AS INTEGER) AS rank FROM (
      SELECT s.*, 0.5 * ln(proven_max_ratio / focal_ratio) AS est_gain,
             row_number() OVER (PARTITION BY s.category ORDER BY 0.5 * ln(proven_max_ratio / focal_ratio) DESC, s.task_id) AS rn
      FROM ({SHARED_SQL}) s JOIN (SELECT task_id FROM {SCALED} WHERE entrant = 'E0' AND neg <= 1) c ON c.task_id = s.task_id
      WHERE proven_max_ratio > focal_ratio) WHERE rn <= 10""")
def top8(v):
    ts, cells = scaled_cells(v)
    # with dozens of runs per cell no task is spotless: up to one scaled negative counts as stable
    cells = cells.withColumns({
        "neg": F.when(F.col("neg") <= 1, F.lit(0).cast("long")).otherwise(F.col("neg")), "passes": F.col("n")})
    return rounded(R.under_compressed(shared(ts), cells, FOCAL).select("category", "task_id", "est_gain", "rank"), "est_gain")


@query("top9_largest_gaps", f"""
    SELECT f.task_id, round(f.score, 6) AS focal_score, round(r.score, 6) AS ref_score, round(r.score - f.score, 6) AS gap
    FROM {TS} f JOIN {TS} r ON r.task_id = f.task_id AND r.entrant = 'E1' WHERE f.entrant = 'E0' AND f.category = 'Hard'
    ORDER BY r.score - f.score DESC, f.task_id LIMIT 10""")
def top9(v):
    return rounded(R.largest_gaps(task_scores(v), FOCAL, REF, "Hard").select("task_id", "focal_score", "ref_score", "gap"),
                   "focal_score", "ref_score", "gap")


@query("top10_headroom", """
    SELECT m.task_id, CASE WHEN coalesce(b.r, 0) <= m.compression_ratio THEN 'none' WHEN m.baseline_pass THEN 'SAFE' ELSE 'RECOVERED' END AS tier,
           b.entrant AS best_by, round(CASE WHEN coalesce(b.r, 0) > m.compression_ratio THEN 0.5 * ln(b.r / m.compression_ratio) ELSE 0.0 END, 6) AS gain
    FROM fx_task_scores m LEFT JOIN (SELECT task_id, entrant, compression_ratio AS r, row_number() OVER (PARTITION BY task_id ORDER BY compression_ratio DESC, entrant) AS rn
      FROM fx_task_scores WHERE entrant NOT IN ('E0', 'E5') AND miner_pass AND compression_ratio <> 0) b ON b.task_id = m.task_id AND b.rn = 1
    WHERE m.entrant = 'E0' AND m.miner_pass AND m.compression_ratio <> 0""")
def top10(v):
    return rounded(R.headroom(task_scores(v), FOCAL, FAMILY).select("task_id", "tier", "best_by", "gain"), "gain")


METRIC_SQL = """count(*) AS n_tasks, round(count(*) FILTER (WHERE miner_pass) / count(*), 6) AS pass_rate, count(*) FILTER (WHERE broke_baseline) AS broke,
    count(*) FILTER (WHERE negative_score) AS negative, round(avg(ratio), 6) AS avg_ratio, round(median(ratio), 6) AS median_ratio, round(avg(score), 6) AS score"""


@query("agg28_subset_metrics", f"SELECT {METRIC_SQL} FROM {TS} WHERE entrant = 'E2' AND task_id % 3 = 0")
def agg28(v):
    rows = R.no_screeners(task_scores(v)).where("entrant = 'E2' AND task_id % 3 = 0")
    return rounded(R.subset_metrics(rows), "pass_rate", "avg_ratio", "median_ratio", "score")


# A candidate export: one row per customer-sized task name, joined to the baseline by its trailing number.
CANDIDATE_SQL = """
    SELECT 'bench-' || p_partkey % 120 AS task, p_size % 3 <> 0 AS pass, p_size % 5 AS neg_runs, 5 AS n_runs,
           CASE WHEN p_size = 7 THEN NULL ELSE p_size / 10.0::DOUBLE END AS ratio, CASE WHEN p_size = 9 THEN NULL ELSE p_size / 8.0::DOUBLE - 1 END AS score,
           p_size % 11 = 0 AS broke, p_size = 50 AS pairing_error, FALSE AS missing_patch, CAST(NULL AS VARCHAR) AS category
    FROM part"""
JOINED_SQL = f"""
    SELECT c.task, coalesce(c.category, b.category) AS category, c.pass, c.neg_runs, c.n_runs, c.ratio, c.score, c.broke, c.pairing_error, c.missing_patch,
           b.score AS base_score, c.broke AND NOT b.broke_baseline AS new_broke
    FROM ({CANDIDATE_SQL}) c JOIN (SELECT * FROM {TS} WHERE entrant = 'E0') b ON regexp_extract(b.task_name, '(\\d+)$', 1) = regexp_extract(c.task, '(\\d+)$', 1)"""


def candidate(v):
    return v.table("part").selectExpr(
        "concat('bench-', p_partkey % 120) AS task", "p_size % 3 <> 0 AS pass", "p_size % 5 AS neg_runs", "5 AS n_runs",
        "CASE WHEN p_size = 7 THEN NULL ELSE p_size / 10.0D END AS ratio", "CASE WHEN p_size = 9 THEN NULL ELSE p_size / 8.0D - 1 END AS score",
        "p_size % 11 = 0 AS broke", "p_size = 50 AS pairing_error", "false AS missing_patch", "cast(NULL AS string) AS category")


def joined_candidate(v, ts):
    return R.join_candidate(candidate(v), R.no_screeners(ts).where(F.col("entrant") == FOCAL))


@query("joi19_join_candidate", f"SELECT task, category, ratio, score, round(base_score, 6) AS base_score, new_broke FROM ({JOINED_SQL})")
def joi19(v):
    return rounded(joined_candidate(v, task_scores(v)).select("task", "category", "ratio", "score", "base_score", "new_broke"), "base_score")


@query("joi20_changed_tasks", f"""
    SELECT a.task_id, round(a.score, 6) AS score, round(b.score, 6) AS base_score FROM {TS} a JOIN {TS} b ON b.task_id = a.task_id AND b.entrant = 'E0'
    WHERE a.entrant = 'E1' AND abs(a.score - b.score) > 0.05""")
def joi20(v):
    ts = R.no_screeners(task_scores(v))
    return rounded(R.changed_tasks(ts.where("entrant = 'E1'"), ts.where("entrant = 'E0'"), 0.05), "score", "base_score")


CAND_METRICS = f"""
    SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS n, count(*) FILTER (WHERE pass) / count(*) AS pass_rate,
           sum(neg_runs) / sum(n_runs) AS neg_rate, count(*) FILTER (WHERE broke) AS broke, count(*) FILTER (WHERE new_broke) AS new_broke,
           count(*) FILTER (WHERE coalesce(score, 0) < 0) AS negative, avg(nullif(ratio, 0)) AS avg_ratio, median(nullif(ratio, 0)) AS median_ratio,
           avg(score) AS avg_score, count(*) FILTER (WHERE pairing_error) AS pairing_errors, count(*) FILTER (WHERE missing_patch) AS missing_patch
    FROM ({JOINED_SQL}) GROUP BY ROLLUP (category)"""
CAND_FLOATS = ["pass_rate", "neg_rate", "avg_ratio", "median_ratio", "avg_score"]


@query("agg29_candidate_metrics", f"""
    SELECT category, n, broke, new_broke, negative, pairing_errors, missing_patch, {', '.join(f'round({c}, 6) AS {c}' for c in CAND_FLOATS)} FROM ({CAND_METRICS})""")
def agg29(v):
    return rounded(R.candidate_metrics(joined_candidate(v, task_scores(v))), *CAND_FLOATS)


@query("agg30_full_gate", f"""
    WITH m AS ({CAND_METRICS}), o AS (SELECT * FROM m WHERE category = 'overall'), d AS (SELECT * FROM m WHERE category = 'Medium'),
    f AS (SELECT count(*) FILTER (WHERE new_broke) AS fb, count(*) FILTER (WHERE pairing_error OR missing_patch) AS fx FROM ({JOINED_SQL}) WHERE category = 'Hard'),
    checks AS (
      SELECT 'no new broken baseline' AS "check", o.new_broke + f.fb > 0 AS rejected, CAST(o.new_broke + f.fb AS DOUBLE) AS value FROM o, f
      UNION ALL SELECT 'compression improves', NOT o.avg_ratio / 2.0 - 1 >= 0.08, o.avg_ratio / 2.0 - 1 FROM o
      UNION ALL SELECT 'medium negative runs not up', d.neg_rate - 0.1 > 0.05, d.neg_rate FROM d
      UNION ALL SELECT 'medium score does not drop', d.avg_score < 0.5, d.avg_score FROM d
      UNION ALL SELECT 'no integrity errors', o.pairing_errors + o.missing_patch + f.fx > 0, CAST(o.pairing_errors + o.missing_patch + f.fx AS DOUBLE) FROM o, f)
    SELECT "check", rejected, round(value, 6) AS value, CASE WHEN (SELECT bool_or(rejected) FROM checks) THEN 'REJECT' ELSE 'ACCEPT' END AS decision FROM checks""")
def agg30(v):
    rows = through_parquet(joined_candidate(v, task_scores(v)), "candidate-rows")
    base = rows.agg(F.lit(2.0).alias("avg_ratio"), F.lit(0.1).alias("medium_neg_rate"), F.lit(0.5).alias("medium_score"))
    return rounded(R.full_gate(rows, rows.where("category = 'Hard'"), base), "value")


@query("agg31_subset_gate", f"""
    WITH c AS (SELECT {METRIC_SQL} FROM {TS} WHERE entrant = 'E1'), b AS (SELECT {METRIC_SQL} FROM {TS} WHERE entrant = 'E0')
    SELECT 'broken baselines' AS "check", CASE WHEN c.broke - b.broke > 0 THEN 'REJECT' ELSE 'PASS' END AS verdict FROM c, b
    UNION ALL SELECT 'ratio improvement', CASE WHEN c.avg_ratio - b.avg_ratio < 0.3 THEN 'REJECT' ELSE 'PASS' END FROM c, b
    UNION ALL SELECT 'score estimate', CASE WHEN c.score < b.score THEN 'WARN' ELSE 'PASS' END FROM c, b""")
def agg31(v):
    ts = R.no_screeners(task_scores(v))
    return R.subset_gate(R.subset_metrics(ts.where("entrant = 'E1'")), R.subset_metrics(ts.where("entrant = 'E0'")))


@query("agg32_project_uplift", f"""
    SELECT entrant, profile, round(avg_ratio * (1 + p), 6) AS projected_ratio, round(0.5 * ln(1 + p), 6) AS score_delta
    FROM (SELECT entrant, avg(ratio) AS avg_ratio FROM {TS} GROUP BY 1), (VALUES ('light', 0.026), ('medium', 0.108), ('deep', 0.137)) AS t(profile, p)""")
def agg32(v):
    base = R.no_screeners(task_scores(v)).groupBy("entrant").agg(F.avg(R.ratio()).alias("avg_ratio"))
    profiles = v.spark.createDataFrame([("light", 0.026), ("medium", 0.108), ("deep", 0.137)], "profile string, p double")
    return rounded(R.project_uplift(base, profiles).drop("avg_ratio"), "projected_ratio", "score_delta")


@query("agg33_profile_compare", """
    WITH cases AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'mid' ELSE 'deep' END AS label, o_orderkey // 3 AS "case",
                          CASE WHEN o_custkey % 7 = 0 THEN 'rich' ELSE 'harvest' END AS mode, 1 + (o_custkey % 40) / 10.0::DOUBLE AS ratio FROM orders)
    SELECT c.label, count(rel) AS n_cases, round(avg(rel - 1), 6) AS mean_pct, round(avg(0.5 * ln(rel)), 6) + 0.0 AS mean_lift,
           count(*) FILTER (WHERE rel > 1.005) AS improved, count(*) FILTER (WHERE rel < 0.995) AS regressed, count(*) FILTER (WHERE mode = 'rich') AS guarded
    FROM (SELECT c.label, c.mode, CASE WHEN c.mode = 'harvest' AND b.ratio > 1.05 THEN c.ratio / b.ratio END AS rel
          FROM cases c JOIN cases b ON b."case" = c."case" AND b.label = 'base' WHERE b.mode = 'harvest') c GROUP BY c.label""")
def agg33(v):
    cases = v.table("orders").selectExpr(
        "CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'mid' ELSE 'deep' END AS label", "o_orderkey div 3 AS case",
        "CASE WHEN o_custkey % 7 = 0 THEN 'rich' ELSE 'harvest' END AS mode", "1 + (o_custkey % 40) / 10.0D AS ratio")
    return rounded(R.profile_compare(cases, "base"), "mean_pct", "mean_lift")


@query("agg34_summarize_experiments", f"""
    SELECT entrant || '-' || category AS experiment_id, category || '+' || entrant AS subsets, count(*) AS n_tasks, round(avg(ratio), 6) AS avg_ratio,
           round(avg(score), 6) AS score, 'measured' AS status FROM {TS} WHERE category IS NOT NULL GROUP BY entrant, category""")
def agg34(v):
    from runledger.session import scratch_path
    from runledger.sources import snapshots

    runs = R.no_screeners(task_scores(v)).where("category IS NOT NULL").groupBy("entrant", "category").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg(R.ratio()).alias("avg_ratio"), F.avg("score").alias("score"))
    path = scratch_path(v.spark, "experiments")
    runs.select(F.concat_ws("-", "entrant", "category").alias("experiment_id"), F.array("category", "entrant").alias("subsets"),
                "n_tasks", "avg_ratio", "score").write.json(path)
    return rounded(R.summarize_experiments(snapshots.scan_experiments(v.spark, path)), "avg_ratio", "score")


@query("agg39_coverage", """
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE category IS NULL) AS no_category, count(DISTINCT task_id) AS n_tasks,
           count(DISTINCT CASE WHEN category <> 'screener' THEN task_id END) AS classed_tasks FROM fx_task_scores""")
def agg39(v):
    return R.coverage(task_scores(v))


@query("set3_resolve_subsets", """
    SELECT DISTINCT p_partkey AS task_id, CAST(NULL AS VARCHAR) AS missing_subset FROM part WHERE p_type IN ('ECONOMY', 'PROMO') OR p_brand = 'Brand#2'
    UNION ALL SELECT NULL, 'nope'""")
def set3(v):
    part = v.table("part")
    members = part.selectExpr("p_type AS subset", "p_partkey AS task_id").unionByName(part.selectExpr("p_brand AS subset", "p_partkey AS task_id"))
    wanted = v.spark.createDataFrame([("ECONOMY",), ("PROMO",), ("Brand#2",), ("nope",)], "subset string")
    return R.resolve_subsets(members, wanted)


@query("set6_target_list", """
    SELECT hotkey, CAST(f.src AS INTEGER) AS src, f.pos FROM (SELECT hotkey, min(struct_pack(src, pos)) AS f FROM (
      SELECT 'Customer' || c_custkey AS hotkey, 0 AS src, c_custkey AS pos FROM customer WHERE c_nationkey = 3
      UNION ALL SELECT 'Customer' || c_custkey, 1, c_custkey FROM customer WHERE c_custkey % 4 = 0)
      WHERE regexp_full_match(hotkey, 'Customer[0-9]{2,}') GROUP BY hotkey)""")
def set6(v):
    c = v.table("customer").select(F.concat(F.lit("Customer"), "c_custkey").alias("hotkey"), F.col("c_custkey").alias("pos"), "c_nationkey")
    return R.target_list(c.where("c_nationkey = 3"), c.where("pos % 4 = 0"), r"^Customer[0-9]{2,}$")
