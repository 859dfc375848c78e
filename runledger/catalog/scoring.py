"""Scoring arithmetic, run pairs, run / task / entrant scores, difficulty, leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.functions import scoring as S
from runledger.operators import boards, difficulty, pairs
from runledger.plans import leaderboard


def run_scores(v):
    return pairs.judged_run_scores(v.tasks, v.judged, v.entrants)


def task_cells(v):
    return pairs.scored_cells(v.tasks, v.judged, v.entrants)


def baselines(v):
    return pairs.judged_baselines(v.judged)


def classes(v):
    return v.classes


PAIR_COLS = ["baseline_run_id", "run_id"]

# The scalar rules run on neighbouring line items: one row per order line, its
# own price as the baseline count and quantity * 1500 as the compressed count.
LINE_INPUT = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS base_tokens,
           CASE WHEN l_discount = 0.01 THEN NULL WHEN l_tax = 0.01 THEN 0 ELSE CAST(l_quantity * 1500 AS BIGINT) END AS comp_tokens,
           CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END AS base_pass,
           CASE WHEN l_tax = 0.02 THEN NULL ELSE l_linestatus = 'F' END AS comp_pass
    FROM fx_li"""


def line_input(v):
    return v.lineitems.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN 0 ELSE cast(floor(l_extendedprice) AS bigint) END AS base_tokens",
        "CASE WHEN l_discount = 0.01 THEN NULL WHEN l_tax = 0.01 THEN 0 ELSE cast(l_quantity * 1500 AS bigint) END AS comp_tokens",
        "CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS base_pass",
        "CASE WHEN l_tax = 0.02 THEN NULL ELSE l_linestatus = 'F' END AS comp_pass")


KEY = "l_orderkey, l_linenumber"


def keyed(df, **cols):
    return df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query("prj1_compression_ratio", f"""
    SELECT {KEY}, CASE WHEN base_tokens <> 0 AND comp_tokens <> 0
           THEN floor(base_tokens * 10000.0::DOUBLE / comp_tokens + 0.5) / 10000 END AS ratio FROM ({LINE_INPUT})""")
def prj1(v):
    return keyed(line_input(v), ratio=S.compression_ratio("base_tokens", "comp_tokens"))


@query("prj2_log_token_ratio", f"""
    SELECT {KEY}, round(CASE WHEN base_tokens > 0 AND comp_tokens > 0
           THEN greatest(-2.0, least(2.0, ln(base_tokens / comp_tokens))) ELSE 0.0 END, 6) + 0.0 AS log_ratio
    FROM ({LINE_INPUT})""")
def prj2(v):
    return rounded(keyed(line_input(v), log_ratio=S.log_token_ratio("base_tokens", "comp_tokens")), "log_ratio")


@query("prj3_outcome_score", f"""
    SELECT {KEY}, CAST(CASE WHEN base_pass AND comp_pass THEN 1 WHEN base_pass AND NOT comp_pass THEN -4
             WHEN NOT base_pass AND comp_pass THEN 4 WHEN NOT base_pass AND NOT comp_pass THEN 0 END AS DOUBLE) AS base_score,
           CAST(CASE WHEN base_pass AND comp_pass THEN 0.5 WHEN base_pass AND NOT comp_pass THEN 0
             WHEN NOT base_pass AND comp_pass THEN 0.5 WHEN NOT base_pass AND NOT comp_pass THEN 0.1 END AS DOUBLE) AS lam
    FROM ({LINE_INPUT})""")
def prj3(v):
    o = S.outcome_score("base_pass", "comp_pass")
    return keyed(line_input(v), base_score=o["base"], lam=o["lam"])


@query("prj4_pair_score", """
    SELECT baseline_run_id, run_id, task_id, hotkey,
           round(CAST(base_score AS DOUBLE) + lam * log_ratio, 6) + 0.0 AS pair_score FROM fx_pair_scores""")
def prj4(v):
    v = v.settled()
    p = pairs.pair_scores(pairs.run_pairs(v.tasks, v.runs, v.validations, v.entrants))
    return rounded(p.select(*PAIR_COLS, "task_id", "hotkey", "pair_score"), "pair_score")


@query("prj5_savings_ratio", f"""
    SELECT {KEY}, round(CASE WHEN base_tokens > 0 AND comp_tokens > 0
           THEN 1.0 - CAST(comp_tokens AS DOUBLE) / base_tokens END, 6) + 0.0 AS savings FROM ({LINE_INPUT})""")
def prj5(v):
    return rounded(keyed(line_input(v), savings=S.savings_ratio("base_tokens", "comp_tokens")), "savings")


SMOOTH = """
    SELECT *, CASE WHEN savings IS NULL THEN 1.0 ELSE 3 * x * x - 2 * x * x * x END AS multiplier
    FROM (SELECT *, greatest(0.0, least(1.0, (savings + 0.2) / 0.4)) AS x
          FROM (SELECT *, CASE WHEN base_tokens > 0 AND comp_tokens > 0
                THEN 1.0 - CAST(comp_tokens AS DOUBLE) / base_tokens END AS savings FROM ({})))""".format(LINE_INPUT)


@query("prj6_savings_multiplier", f"SELECT {KEY}, round(multiplier, 6) AS multiplier FROM ({SMOOTH})")
def prj6(v):
    m = S.savings_multiplier(S.savings_ratio("base_tokens", "comp_tokens"))
    return rounded(keyed(line_input(v), multiplier=m), "multiplier")


@query("prj7_adjust_score", f"""
    SELECT {KEY}, round(-4.0 + (CAST(l_partkey % 9 AS DOUBLE) / 2 + 4.0) * multiplier, 6) + 0.0 AS adjusted
    FROM ({SMOOTH})""")
def prj7(v):
    raw = (F.col("l_partkey") % 9).cast("double") / 2
    return rounded(keyed(line_input(v), adjusted=S.adjust_score(raw, "base_tokens", "comp_tokens")), "adjusted")


@query("prj8_outcome_flags", f"""
    SELECT {KEY}, coalesce(base_pass, FALSE) AND NOT coalesce(comp_pass, FALSE) AS broke_baseline,
           coalesce(base_tokens - comp_tokens < 0, FALSE) AS negative_score FROM ({LINE_INPUT})""")
def prj8(v):
    return keyed(line_input(v), broke_baseline=S.broke_baseline("base_pass", "comp_pass"),
                 negative_score=S.negative_score(F.col("base_tokens") - F.col("comp_tokens")))


@query("joi1_run_pairs", """
    SELECT task_id, task_name, hotkey, baseline_run_id, baseline_tokens, baseline_resolved, run_id, attempt_no,
           run_tokens, run_resolved FROM fx_pairs""")
def joi1(v):
    v = v.settled()
    return pairs.run_pairs(v.tasks, v.runs, v.validations, v.entrants).select(
        "task_id", "task_name", "hotkey", "baseline_run_id", "baseline_tokens", "baseline_resolved", "run_id",
        "attempt_no", "run_tokens", "run_resolved")


@query("joi2_reward_pairs", """
    SELECT task_id, hotkey, count(*) AS n_pairs, count(DISTINCT run_id) AS n_runs, count(DISTINCT baseline_run_id) AS n_base
    FROM fx_pairs WHERE NOT banned AND competition_id = 1 GROUP BY task_id, hotkey""")
def joi2(v):
    return pairs.pair_counts(v.tasks, v.runs, v.validations, v.entrants, exclude_banned=True, competition_id=1)


@query("agg1_run_scores", """
    SELECT hotkey, task_id, run_id, attempt_no, run_resolved, run_tokens, round(run_score, 6) + 0.0 AS run_score
    FROM fx_run_scores""")
def agg1(v):
    return rounded(run_scores(v).select(
        "hotkey", "task_id", "run_id", "attempt_no", "run_resolved", "run_tokens", "run_score"), "run_score")


@query("agg2_baseline_summary", """
    SELECT task_id, n_baselines, baseline_pass, round(baseline_tokens, 6) AS baseline_tokens, baseline_token_sum
    FROM fx_baselines""")
def agg2(v):
    return rounded(baselines(v), "baseline_tokens")


@query("agg3_task_results", """
    SELECT hotkey, task_id, task_name, is_screener, n_runs, n_pass, task_passed, round(raw_score, 6) + 0.0 AS raw_score,
           baseline_pass, round(baseline_tokens, 6) AS baseline_tokens, round(run_tokens, 6) AS run_tokens,
           round(score, 6) + 0.0 AS score
    FROM fx_task_results""")
def agg3(v):
    return rounded(pairs.task_results(task_cells(v), baselines(v)).drop("entrant_id"),
                   "raw_score", "baseline_tokens", "run_tokens", "score")


ENTRANT_SQL = """
    SELECT s.hotkey, s.raw_total, s.screener_score, b.baseline_token_sum, s.run_token_sum,
           -4.0 + (s.raw_total + 4.0) * CASE WHEN b.baseline_token_sum > 0 AND s.run_token_sum > 0 THEN
             3 * pow(greatest(0.0, least(1.0, (1.2 - CAST(s.run_token_sum AS DOUBLE) / b.baseline_token_sum) / 0.4)), 2)
             - 2 * pow(greatest(0.0, least(1.0, (1.2 - CAST(s.run_token_sum AS DOUBLE) / b.baseline_token_sum) / 0.4)), 3)
             ELSE 1.0 END AS total_score
    FROM (SELECT hotkey, avg(run_score) AS raw_total, avg(run_score) FILTER (WHERE is_screener) AS screener_score,
                 CAST(sum(run_tokens) FILTER (WHERE run_tokens > 0) AS BIGINT) AS run_token_sum
          FROM fx_run_scores GROUP BY hotkey) s
    LEFT JOIN (SELECT hotkey, CAST(sum(baseline_token_sum) AS BIGINT) AS baseline_token_sum
          FROM (SELECT DISTINCT hotkey, task_id FROM fx_run_scores) JOIN fx_baselines USING (task_id)
          GROUP BY hotkey) b USING (hotkey)"""


@query("agg4_entrant_scores", f"""
    SELECT hotkey, round(raw_total, 6) AS raw_total, round(screener_score, 6) AS screener_score, baseline_token_sum,
           run_token_sum, round(total_score, 6) AS total_score FROM ({ENTRANT_SQL})""")
def agg4(v):
    return rounded(pairs.entrant_scores(task_cells(v), baselines(v)).drop("entrant_id"),
                   "raw_total", "screener_score", "total_score")


@query("agg5_difficulty_inputs", """
    SELECT task_name, round(loss_ratio, 6) AS loss_ratio, round(avg_tokens, 6) AS avg_tokens FROM fx_difficulty""")
def agg5(v):
    return rounded(difficulty.difficulty_inputs(v.tasks, v.judged).select(
        "task_name", "loss_ratio", "avg_tokens"), "loss_ratio", "avg_tokens")


@query("win5_difficulty_score", """
    SELECT task_name, round(token_score, 6) AS token_score, round(difficulty_score, 6) AS difficulty_score
    FROM fx_difficulty""")
def win5(v):
    inputs = difficulty.difficulty_inputs(v.tasks, v.judged)
    return rounded(difficulty.difficulty_score(inputs).select("task_name", "token_score", "difficulty_score"),
                   "token_score", "difficulty_score")


@query("win4_assign_difficulty", "SELECT task_name, category FROM fx_difficulty")
def win4(v):
    return classes(v).select("task_name", "category")


@query("joi24_with_category", """
    SELECT s.hotkey, d.category, count(*) AS n_tasks, round(avg(s.score), 6) AS mean_score
    FROM fx_task_results s JOIN fx_difficulty d ON d.task_id = s.task_id GROUP BY s.hotkey, d.category""")
def joi24(v):
    scored = difficulty.with_category(pairs.task_results(task_cells(v), baselines(v)), classes(v), "inner")
    return rounded(scored.groupBy("hotkey", "category").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg("score").alias("mean_score")), "mean_score")


CATEGORY_SQL = """
    SELECT hotkey, category, avg(task_score) AS category_score, count(*) AS n_tasks
    FROM (SELECT s.hotkey, s.task_id, d.category, avg(run_score) AS task_score
          FROM fx_run_scores s JOIN fx_difficulty d ON d.task_id = s.task_id
          WHERE run_score IS NOT NULL GROUP BY s.hotkey, s.task_id, d.category)
    WHERE hotkey IN (SELECT s.hotkey FROM fx_run_scores s JOIN fx_difficulty d ON d.task_id = s.task_id
                     WHERE run_score IS NOT NULL GROUP BY s.hotkey
                     HAVING count(DISTINCT s.task_id) = (SELECT count(*) FROM fx_difficulty))
    GROUP BY hotkey, category"""


def category_scores(v):
    return difficulty.category_scores(task_cells(v), classes(v))


@query("agg6_category_scores", f"""
    SELECT hotkey, category, round(category_score, 6) AS category_score, n_tasks FROM ({CATEGORY_SQL})""")
def agg6(v):
    return rounded(category_scores(v).drop("entrant_id"), "category_score")


ELIGIBLE_SQL = """
    SELECT e.hotkey, e.entrant_id, r.resolved_tasks
    FROM (SELECT entrant_id, count(*) FILTER (WHERE total_scored > 0
                 AND resolved_count >= ceil(3.0 * total_scored / 5.0)) AS resolved_tasks
          FROM (SELECT r.entrant_id, r.task_id, count(*) FILTER (WHERE v.scored_at IS NOT NULL) AS total_scored,
                       count(*) FILTER (WHERE v.resolved AND v.scored_at IS NOT NULL) AS resolved_count
                FROM fx_runs r JOIN fx_validations v ON v.run_id = r.run_id JOIN fx_tasks t ON t.task_id = r.task_id
                WHERE t.is_screener AND NOT r.baseline_run GROUP BY r.entrant_id, r.task_id)
          GROUP BY entrant_id) r
    JOIN fx_entrants e ON e.entrant_id = r.entrant_id WHERE NOT e.banned AND r.resolved_tasks >= 4"""


@query("top1_leaderboard", f"""
    SELECT CAST(row_number() OVER (ORDER BY total_score DESC NULLS LAST, screener_passed DESC, hotkey) AS INTEGER) AS position,
           hotkey, round(total_score, 6) AS total_score, round(screener_score, 6) AS screener_score,
           round(easy, 6) AS easy, round(medium, 6) AS medium, round(hard, 6) AS hard, screener_passed,
           count(*) OVER () AS total_rows
    FROM (SELECT t.hotkey, t.total_score, t.screener_score, c.easy, c.medium, c.hard, e.hotkey IS NOT NULL AS screener_passed
          FROM ({ENTRANT_SQL}) t
          LEFT JOIN (SELECT hotkey, max(category_score) FILTER (WHERE category = 'Easy') AS easy,
                            max(category_score) FILTER (WHERE category = 'Medium') AS medium,
                            max(category_score) FILTER (WHERE category = 'Hard') AS hard
                     FROM ({CATEGORY_SQL}) GROUP BY hotkey) c ON c.hotkey = t.hotkey
          LEFT JOIN ({ELIGIBLE_SQL}) e ON e.hotkey = t.hotkey)""")
def top1(v):
    board = leaderboard.build(v.tasks, v.runs, v.validations, v.entrants)
    return rounded(board.select("position", "hotkey", "total_score", "screener_score", "easy", "medium", "hard",
                                "screener_passed", "total_rows"),
                   "total_score", "screener_score", "easy", "medium", "hard")


@query("top2_entrant_page", """
    SELECT CAST(rn AS INTEGER) AS position, hotkey, last_submit, total_rows
    FROM (SELECT *, row_number() OVER (ORDER BY last_submit DESC NULLS LAST, hotkey) AS rn, count(*) OVER () AS total_rows
          FROM (SELECT 'C' || (o_custkey) AS hotkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_submit
                FROM orders GROUP BY o_custkey)) WHERE rn > 50 AND rn <= 100""")
def top2(v):
    submits = v.table("orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("hotkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_submit"))
    return boards.entrant_page(submits, 2, 50).select("position", "hotkey", "last_submit", "total_rows")


@query("top2_deep_page", """
    SELECT CAST(rn AS INTEGER) AS position, id, last_submit, total_rows
    FROM (SELECT *, row_number() OVER (ORDER BY last_submit DESC NULLS LAST, id) AS rn, count(*) OVER () AS total_rows
          FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS last_submit FROM orders)) WHERE rn > 12000 AND rn <= 12500""")
def top2b(v):
    submits = v.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_submit"))
    return boards.page(submits, [F.col("last_submit").desc_nulls_last(), F.col("id").asc()], 25, 500)


@query("set5_required_set", """
    SELECT s.hotkey, count(DISTINCT s.task_id) AS n_scored_tasks, (SELECT count(*) FROM fx_difficulty) AS n_required,
           count(DISTINCT s.task_id) = (SELECT count(*) FROM fx_difficulty) AS complete
    FROM fx_run_scores s JOIN fx_difficulty d ON d.task_id = s.task_id WHERE run_score IS NOT NULL GROUP BY s.hotkey""")
def set5(v):
    return difficulty.complete_entrants(task_cells(v), classes(v)).drop("entrant_id")
