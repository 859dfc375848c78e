"""Evaluation tables derived from the given business tables.

Every view exists twice: as a DataFrame (`Views`) and as SQL text
(`VIEW_SQL`) for the side-by-side check. Both use the same integer
arithmetic, so that they agree row for row at any scale.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.operators.difficulty import task_difficulty
from runledger.operators.pairs import judged_runs_written
from runledger.scale import positions
from runledger.session import spread, through_parquet

NOW = "1998-06-01 00:00:00"

VIEW_SQL: dict[str, str] = {
    "fx_tasks": """
        SELECT CAST(range AS BIGINT) AS task_id, 'task-' || range AS task_name,
               CAST(range % 2 AS BIGINT) AS competition_id, range % 20 < 2 AS is_screener,
               CAST(1 + range % 3 AS INTEGER) AS planned_repeats
        FROM range(100)""",
    "fx_li": """
        SELECT * EXCLUDE (rn) REPLACE (CAST(l_linenumber + 10 * (rn - 1) AS INTEGER) AS l_linenumber) FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
                 l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) AS rn
          FROM lineitem)""",
    "fx_runs": """
        SELECT l_orderkey * 1000 + l_linenumber AS run_id, l_partkey % 100 AS task_id,
               l_suppkey % 8 AS entrant_id, l_suppkey % 24 AS script_id, l_linenumber AS attempt_no,
               CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS tokens_used,
               l_quantity * 10 AS time_taken_seconds, CAST(l_linenumber * 3 AS INTEGER) AS agent_steps,
               (l_orderkey % 25 = 0 AND l_linenumber = 1) AS baseline_run,
               CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_orderkey % 3 = 0 THEN 'pending'
                    ELSE 'dispatched' END AS status,
               l_shipdate AS created_at, l_shipdate + to_hours(CAST(l_linenumber AS INTEGER)) AS updated_at
        FROM fx_li""",
    "fx_validations": """
        SELECT l_orderkey * 1000 + l_linenumber AS validation_id, l_orderkey * 1000 + l_linenumber AS run_id,
               CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag <> 'R' END AS resolved,
               CASE WHEN l_tax = 0 THEN NULL ELSE l_shipdate END AS scored_at,
               l_suppkey % 5 AS validator_id,
               CASE WHEN l_quantity > 10 THEN l_shipdate END AS claimed_at,
               CASE WHEN l_quantity > 10 THEN l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) END AS claim_expires_at
        FROM fx_li""",
    "fx_entrants": """
        SELECT CAST(range AS BIGINT) AS entrant_id, 'E' || range AS hotkey, range = 7 AS banned FROM range(8)""",
    "fx_uploads": """
        SELECT o_orderkey AS upload_id, o_orderkey % 24 AS script_id, o_orderkey % 8 AS entrant_id,
               CAST(o_custkey % 2 AS BIGINT) AS competition_id, o_orderdate AS created_at
        FROM orders""",
    "fx_api_keys": """
        SELECT CASE c_custkey % 8 WHEN 5 THEN 4 ELSE c_custkey % 8 END AS entrant_id,
               CASE WHEN c_acctbal < 0 OR c_custkey % 8 = 3 THEN TIMESTAMP '1997-01-01 00:00:00' END AS revoked_at
        FROM customer""",
    "fx_competitions": """
        SELECT s_suppkey AS competition_id, s_name AS name, s_suppkey % 3 <> 0 AS is_active,
               TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 2000 AS INTEGER)) AS upload_starts_at,
               TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 2000 + 7 AS INTEGER)) AS upload_ends_at,
               TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 2000 + 7 AS INTEGER)) AS eval_starts_at,
               TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 2000 + 14 AS INTEGER)) AS eval_ends_at,
               TIMESTAMP '1994-06-01 00:00:00' + to_days(CAST(s_suppkey % 50 AS INTEGER)) AS created_at
        FROM supplier""",
    "fx_reward_rows": """
        SELECT o_orderkey AS reward_id, 'E' || (o_custkey % 12) AS hotkey, o_custkey % 2 AS competition_id,
               o_totalprice / 1e7 AS weight, o_orderstatus = 'F' AS approved,
               o_orderdate AS starts_at, o_orderdate + to_days(14) AS ends_at, o_orderdate AS created_at
        FROM orders""",
    "fx_burns": """
        SELECT c_custkey AS request_id,
               TIMESTAMP '1996-01-01 00:00:00' + to_hours(CAST(c_custkey * 7919 % 20000 AS INTEGER)) AS created_at,
               c_custkey % 3 <> 1 AS is_active, c_acctbal / 12000.0 AS burn_ratio
        FROM customer""",
    "fx_difficulty_base": """
        SELECT 'task-' || r.task_id AS task_name, r.task_id, v.resolved, r.tokens_used
        FROM fx_runs r LEFT JOIN fx_validations v ON v.run_id = r.run_id
        WHERE r.baseline_run""",
    # One row per (run, baseline) pair of a task.
    "fx_pairs": """
        SELECT t.task_id, t.task_name, t.competition_id, t.is_screener, e.entrant_id, e.hotkey, e.banned,
               b.run_id AS baseline_run_id, b.tokens_used AS baseline_tokens, bv.resolved AS baseline_resolved,
               r.run_id, r.attempt_no, r.tokens_used AS run_tokens, rv.resolved AS run_resolved
        FROM fx_tasks t
        JOIN fx_runs b ON b.task_id = t.task_id AND b.baseline_run
        LEFT JOIN fx_validations bv ON bv.run_id = b.run_id
        JOIN fx_runs r ON r.task_id = t.task_id AND NOT r.baseline_run
        JOIN fx_entrants e ON e.entrant_id = r.entrant_id
        LEFT JOIN fx_validations rv ON rv.run_id = r.run_id""",
    "fx_pair_scores": """
        SELECT *, CASE WHEN baseline_tokens > 0 AND run_tokens > 0
                  THEN greatest(-2.0, least(2.0, ln(CAST(baseline_tokens AS DOUBLE) / run_tokens))) ELSE 0.0 END AS log_ratio,
               CASE WHEN baseline_resolved AND run_resolved THEN 1.0 WHEN baseline_resolved AND NOT run_resolved THEN -4.0
                    WHEN NOT baseline_resolved AND run_resolved THEN 4.0
                    WHEN NOT baseline_resolved AND NOT run_resolved THEN 0.0 END AS base_score,
               CASE WHEN baseline_resolved AND run_resolved THEN 0.5 WHEN baseline_resolved AND NOT run_resolved THEN 0.0
                    WHEN NOT baseline_resolved AND run_resolved THEN 0.5
                    WHEN NOT baseline_resolved AND NOT run_resolved THEN 0.1 END AS lam
        FROM fx_pairs""",
    "fx_run_scores": """
        SELECT entrant_id, hotkey, banned, task_id, task_name, competition_id, is_screener, run_id, attempt_no,
               any_value(run_resolved) AS run_resolved, any_value(run_tokens) AS run_tokens,
               avg(CAST(base_score AS DOUBLE) + lam * log_ratio) AS run_score
        FROM fx_pair_scores
        GROUP BY entrant_id, hotkey, banned, task_id, task_name, competition_id, is_screener, run_id, attempt_no""",
    "fx_baselines": """
        SELECT r.task_id, count(*) AS n_baselines,
               CASE WHEN count(*) = count(v.resolved) AND min(CAST(v.resolved AS INTEGER)) = max(CAST(v.resolved AS INTEGER))
                    THEN min(CAST(v.resolved AS INTEGER)) = 1 END AS baseline_pass,
               avg(CAST(r.tokens_used AS DOUBLE)) AS baseline_tokens,
               CAST(sum(CASE WHEN r.tokens_used > 0 THEN r.tokens_used END) AS BIGINT) AS baseline_token_sum
        FROM fx_runs r LEFT JOIN fx_validations v ON v.run_id = r.run_id
        WHERE r.baseline_run GROUP BY r.task_id""",
    "fx_difficulty": """
        SELECT task_name, task_id, loss_ratio, avg_tokens, token_score, difficulty_score,
               CASE ntile(3) OVER (ORDER BY difficulty_score DESC, task_name) WHEN 1 THEN 'Hard' WHEN 2 THEN 'Medium'
                    ELSE 'Easy' END AS category
        FROM (SELECT *, CASE WHEN max(avg_tokens) OVER () > 0 THEN avg_tokens / max(avg_tokens) OVER () ELSE 0.0 END
                     AS token_score, 0.75 * loss_ratio + 0.25 * CASE WHEN max(avg_tokens) OVER () > 0
                     THEN avg_tokens / max(avg_tokens) OVER () ELSE 0.0 END AS difficulty_score
              FROM (SELECT task_name, task_id, 1.0 - avg(CAST(resolved AS INTEGER)) AS loss_ratio,
                           coalesce(avg(CAST(tokens_used AS DOUBLE)), 0.0) AS avg_tokens
                    FROM fx_difficulty_base GROUP BY task_name, task_id HAVING count(resolved) > 0))""",
    "fx_task_results": """
        SELECT s.entrant_id, s.hotkey, s.task_id, s.task_name, s.is_screener, s.n_runs, s.n_pass,
               s.n_pass >= (s.n_runs + 1) // 2 AS task_passed, s.raw_score, b.baseline_pass,
               b.baseline_tokens, s.run_tokens,
               -4.0 + (s.raw_score + 4.0) * CASE
                 WHEN floor(b.baseline_tokens) > 0 AND floor(s.run_tokens) > 0 THEN
                   3.0 * pow(greatest(0.0, least(1.0, (1.0 - floor(s.run_tokens) / floor(b.baseline_tokens) + 0.2) / 0.4)), 2)
                   - 2.0 * pow(greatest(0.0, least(1.0, (1.0 - floor(s.run_tokens) / floor(b.baseline_tokens) + 0.2) / 0.4)), 3)
                 ELSE 1.0 END AS score
        FROM (SELECT entrant_id, hotkey, task_id, task_name, is_screener, count(*) AS n_runs,
                     count(*) FILTER (WHERE run_resolved) AS n_pass, avg(run_score) AS raw_score,
                     avg(CAST(run_tokens AS DOUBLE)) AS run_tokens
              FROM fx_run_scores GROUP BY ALL) s
        JOIN fx_baselines b ON b.task_id = s.task_id""",
    "fx_task_scores": """
        SELECT r.hotkey AS entrant, r.hotkey, r.task_id, r.task_name,
               CASE WHEN r.is_screener THEN 'screener' ELSE d.category END AS category,
               r.baseline_tokens >= 52000 AS baseline_pass, r.task_passed AS miner_pass,
               r.baseline_tokens, r.run_tokens AS miner_tokens,
               CASE WHEN r.baseline_tokens <> 0 AND r.run_tokens <> 0
                    THEN floor(r.baseline_tokens * 10000 / r.run_tokens + 0.5) / 10000 END AS compression_ratio,
               r.score, r.baseline_tokens >= 52000 AND NOT coalesce(r.task_passed, FALSE) AS broke_baseline,
               coalesce(r.score < 0, FALSE) AS negative_score
        FROM fx_task_results r LEFT JOIN fx_difficulty d ON d.task_id = r.task_id""",
    # Long run table as the research jobs see it.
    "fx_research_runs": """
        SELECT s.hotkey AS entrant, s.hotkey, s.task_id, s.task_name,
               CASE WHEN s.is_screener THEN 'screener' ELSE d.category END AS category, s.attempt_no, s.run_id,
               s.run_resolved AS run_pass, CAST(s.run_tokens AS DOUBLE) AS run_tokens, s.run_score
        FROM fx_run_scores s LEFT JOIN fx_difficulty d ON d.task_id = s.task_id""",
    # Text question rounds: items of batches, their scores and assignments.
    "fx_items": """
        SELECT l_orderkey * 1000 + l_linenumber AS item_id, l_orderkey AS batch_id, l_partkey AS challenge_id,
               l_orderkey % 24 AS script_id, l_orderkey % 8 AS entrant_id,
               CASE CAST(l_linenumber AS INTEGER) % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS compression_ratio
        FROM fx_li""",
    "fx_item_scores": """
        SELECT l_orderkey * 1000 + l_linenumber AS item_id, l_suppkey % 5 AS validator_id,
               l_extendedprice / 100000 AS score, l_shipdate AS scored_at,
               '{"n": ' || l_linenumber || '}' AS details
        FROM fx_li WHERE l_returnflag <> 'N'""",
    "fx_assignments": """
        SELECT o_orderkey AS batch_id, o_custkey % 5 AS validator_id, o_orderdate AS assigned_at,
               CASE WHEN o_totalprice > 200000 THEN o_orderdate + to_hours(6) END AS done_at
        FROM orders WHERE o_orderstatus = 'P'""",
    "fx_links": """
        SELECT p_partkey AS link_id, p_partkey AS challenge_id, p_partkey % 2 AS competition_id, p_size < 25 AS is_active,
               TIMESTAMP '1996-01-01 00:00:00' + to_hours(CAST(p_partkey * 31 % 5000 AS INTEGER)) AS generated_at
        FROM part""",
    "fx_screeners": """
        SELECT p_partkey AS challenge_id, p_partkey % 2 AS competition_id FROM part WHERE p_size % 10 = 0""",
    "fx_messages": """
        SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS msg_idx, role, text FROM conversations""",
    "fx_pairs_trace": r"""
        SELECT user_id AS session_id, event_id, event_type, props,
               CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events""",
    "fx_trace": """
        SELECT session_id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role,
               'Please fix the failing check in app/mod' || (session_id % 9) || '.py and keep the public names.' AS text,
               CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS args
        FROM fx_pairs_trace WHERE i = 1
        UNION ALL
        SELECT session_id, 2 * i - 1, 'assistant', 'Step ' || i || ': look at ' || event_type, event_id, event_type, props
        FROM fx_pairs_trace
        UNION ALL
        SELECT session_id, 2 * i, 'toolresult',
               CASE event_type
                 WHEN 'error' THEN 'FAILED app/mod' || (k % 9) || '.py::test_case_' || k || chr(10)
                      || 'AssertionError: expected ' || k || chr(10) || '1 failed, ' || k || ' passed'
                 WHEN 'purchase' THEN k || ' passed in 0.1s'
                 WHEN 'view' THEN '# app/mod' || (k % 9) || '.py' || chr(10)
                      || repeat('value_' || (k % 9) || ' = compute(alpha, beta, gamma)' || chr(10), 60)
                 ELSE 'ok ' || event_type || ' ' || k END,
               event_id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
        FROM fx_pairs_trace""",
    "fx_lines": """
        SELECT doc_id, CAST(pos - 1 AS BIGINT) AS line_no, lines[pos] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d,
             LATERAL (SELECT unnest(generate_series(1, len(d.lines))) AS pos)""",
}


def compose(body: str) -> str:
    """Prefix ``body`` with the derived views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in sorted(set(re.findall(r"\bfx_\w+", sql))):
            if name in VIEW_SQL and name not in ordered:
                visit(VIEW_SQL[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in ordered)
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


class Views:
    """The same tables as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> DataFrame:
        i = F.col("id")
        return self.spark.range(100).select(
            i.alias("task_id"), F.concat(F.lit("task-"), i).alias("task_name"),
            (i % 2).alias("competition_id"), (i % 20 < 2).alias("is_screener"),
            (1 + i % 3).cast("int").alias("planned_repeats"))

    @cached_property
    def lineitems(self) -> DataFrame:
        """All line items; where an order repeats a line number, its copies are numbered on by tens."""
        return self._numbered(spread(self.table("lineitem"), "l_orderkey", "l_linenumber"))

    @cached_property
    def lineitems_by_order(self) -> DataFrame:
        """The same, moved by order alone: what follows by order finds its rows in place."""
        return self._numbered(self.table("lineitem").repartition("l_orderkey"))

    @staticmethod
    def _numbered(source: DataFrame) -> DataFrame:
        order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax",
                 "l_discount", "l_returnflag", "l_linestatus"]
        copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
        return source.withColumn("_copy", copy).withColumn(
            "l_linenumber", (F.col("l_linenumber") + 10 * (F.col("_copy") - 1)).cast("int")).drop("_copy")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents for row-heavy text work."""
        return spread(self.table("documents"))

    def settled(self) -> "Views":
        """Write the deduplicated line items once, for queries that read runs and verdicts several times."""
        if not getattr(self, "_settled", False):
            self.__dict__["lineitems"] = through_parquet(self.lineitems.select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
                "l_tax", "l_returnflag", "l_linestatus"), "line-items", release=True)
            self._settled = True
        return self

    @cached_property
    def runs(self) -> DataFrame:
        return self.lineitems.selectExpr(
            "l_orderkey * 1000 + l_linenumber AS run_id", "l_partkey % 100 AS task_id",
            "l_suppkey % 8 AS entrant_id", "l_suppkey % 24 AS script_id", "l_linenumber AS attempt_no",
            "CASE WHEN l_quantity = 13 THEN NULL ELSE cast(floor(l_extendedprice) AS bigint) END AS tokens_used",
            "l_quantity * 10 AS time_taken_seconds", "l_linenumber * 3 AS agent_steps",
            "l_orderkey % 25 = 0 AND l_linenumber = 1 AS baseline_run",
            "CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_orderkey % 3 = 0 THEN 'pending' "
            "ELSE 'dispatched' END AS status",
            "l_shipdate AS created_at", "l_shipdate + make_interval(0, 0, 0, 0, l_linenumber) AS updated_at")

    @cached_property
    def validations(self) -> DataFrame:
        return self.lineitems.selectExpr(
            "l_orderkey * 1000 + l_linenumber AS validation_id", "l_orderkey * 1000 + l_linenumber AS run_id",
            "CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag <> 'R' END AS resolved",
            "CASE WHEN l_tax = 0 THEN NULL ELSE l_shipdate END AS scored_at",
            "l_suppkey % 5 AS validator_id",
            "CASE WHEN l_quantity > 10 THEN l_shipdate END AS claimed_at",
            "CASE WHEN l_quantity > 10 THEN l_shipdate + make_interval(0, 0, 0, 0, cast(l_quantity AS int)) END "
            "AS claim_expires_at")

    @cached_property
    def judged(self) -> DataFrame:
        """Runs with their verdicts, written once per query."""
        return judged_runs_written(self.runs, self.validations)

    @cached_property
    def classes(self) -> DataFrame:
        """Difficulty classes (one row per task), written once per query."""
        return through_parquet(task_difficulty(self.tasks, self.judged), "task-classes")

    @cached_property
    def entrants(self) -> DataFrame:
        i = F.col("id")
        return self.spark.range(8).select(
            i.alias("entrant_id"), F.concat(F.lit("E"), i).alias("hotkey"), (i == 7).alias("banned"))

    @cached_property
    def uploads(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS upload_id", "o_orderkey % 24 AS script_id", "o_orderkey % 8 AS entrant_id",
            "o_custkey % 2 AS competition_id", "o_orderdate AS created_at")

    @cached_property
    def api_keys(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "CASE c_custkey % 8 WHEN 5 THEN 4 ELSE c_custkey % 8 END AS entrant_id",
            "CASE WHEN c_acctbal < 0 OR c_custkey % 8 = 3 THEN timestamp'1997-01-01 00:00:00' END AS revoked_at")

    @cached_property
    def competitions(self) -> DataFrame:
        def day(offset: int) -> str:
            return (f"timestamp'1995-01-01 00:00:00' + make_dt_interval(cast(s_suppkey * 37 % 2000 + {offset} AS int))")
        return self.table("supplier").selectExpr(
            "s_suppkey AS competition_id", "s_name AS name", "s_suppkey % 3 <> 0 AS is_active",
            f"{day(0)} AS upload_starts_at", f"{day(7)} AS upload_ends_at", f"{day(7)} AS eval_starts_at",
            f"{day(14)} AS eval_ends_at",
            "timestamp'1994-06-01 00:00:00' + make_dt_interval(cast(s_suppkey % 50 AS int)) AS created_at")

    @cached_property
    def reward_rows(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS reward_id", "concat('E', o_custkey % 12) AS hotkey", "o_custkey % 2 AS competition_id",
            "o_totalprice / 1e7D AS weight", "o_orderstatus = 'F' AS approved", "o_orderdate AS starts_at",
            "o_orderdate + make_dt_interval(14) AS ends_at", "o_orderdate AS created_at")

    @cached_property
    def burns(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS request_id",
            "timestamp'1996-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey * 7919 % 20000 AS int)) AS created_at",
            "c_custkey % 3 <> 1 AS is_active", "c_acctbal / 12000.0D AS burn_ratio")

    @cached_property
    def items(self) -> DataFrame:
        return self.lineitems.selectExpr(
            "l_orderkey * 1000 + l_linenumber AS item_id", "l_orderkey AS batch_id", "l_partkey AS challenge_id",
            "l_orderkey % 24 AS script_id", "l_orderkey % 8 AS entrant_id",
            "CASE l_linenumber % 3 WHEN 0 THEN 0.2D WHEN 1 THEN 0.4D ELSE 0.6D END AS compression_ratio")

    @cached_property
    def item_scores(self) -> DataFrame:
        return self.lineitems.where("l_returnflag <> 'N'").selectExpr(
            "l_orderkey * 1000 + l_linenumber AS item_id", "l_suppkey % 5 AS validator_id",
            "l_extendedprice / 100000 AS score", "l_shipdate AS scored_at",
            "concat('{\"n\": ', l_linenumber, '}') AS details")

    @cached_property
    def assignments(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'P'").selectExpr(
            "o_orderkey AS batch_id", "o_custkey % 5 AS validator_id", "o_orderdate AS assigned_at",
            "CASE WHEN o_totalprice > 200000 THEN o_orderdate + make_dt_interval(0, 6) END AS done_at")

    @cached_property
    def links(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS link_id", "p_partkey AS challenge_id", "p_partkey % 2 AS competition_id",
            "p_size < 25 AS is_active",
            "timestamp'1996-01-01 00:00:00' + make_dt_interval(0, cast(p_partkey * 31 % 5000 AS int)) AS generated_at")

    @cached_property
    def screeners(self) -> DataFrame:
        return self.table("part").where("p_size % 10 = 0").selectExpr(
            "p_partkey AS challenge_id", "p_partkey % 2 AS competition_id")

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "conv_id AS session_id", "turn AS msg_idx", "role", "text")

    @cached_property
    def trace_pairs(self) -> DataFrame:
        calls = self.table("events").selectExpr(
            "user_id AS session_id", "ts", "event_id", "event_type", "props",
            r"cast(regexp_extract(props, '(\\d+)', 1) AS bigint) AS k")
        return positions(calls, ["session_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "i")

    @cached_property
    def trace(self) -> DataFrame:
        """Tool transcripts: session, position, role, text and the call that a row makes or answers."""
        message_set = F.expr(r"""
            filter(array(
              CASE WHEN i = 1 THEN named_struct('msg_idx', 0L, 'role', 'user',
                'text', concat('Please fix the failing check in app/mod', session_id % 9,
                               '.py and keep the public names.'),
                'call_id', cast(NULL AS bigint), 'tool', cast(NULL AS string), 'args', cast(NULL AS string)) END,
              named_struct('msg_idx', 2L * i - 1, 'role', 'assistant',
                'text', concat('Step ', i, ': look at ', event_type),
                'call_id', event_id, 'tool', event_type, 'args', props),
              named_struct('msg_idx', 2L * i, 'role', 'toolresult',
                'text', CASE event_type
                  WHEN 'error' THEN concat('FAILED app/mod', k % 9, '.py::test_case_', k, '\n',
                       'AssertionError: expected ', k, '\n', '1 failed, ', k, ' passed')
                  WHEN 'purchase' THEN concat(k, ' passed in 0.1s')
                  WHEN 'view' THEN concat('# app/mod', k % 9, '.py', '\n',
                       repeat(concat('value_', k % 9, ' = compute(alpha, beta, gamma)', '\n'), 60))
                  ELSE concat('ok ', event_type, ' ', k) END,
                'call_id', event_id, 'tool', cast(NULL AS string), 'args', cast(NULL AS string))),
              m -> m IS NOT NULL)""")
        return self.trace_pairs.select("session_id", F.inline(message_set))

    @cached_property
    def lines(self) -> DataFrame:
        return self.documents.select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
            "doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
