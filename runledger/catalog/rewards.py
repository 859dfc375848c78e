"""Subset lattice, reward weights, burn state, payout."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.catalog.scoring import CATEGORY_SQL, category_scores
from runledger.catalog.views import NOW
from runledger.operators import queues, rewards
from runledger.plans import reward_round
from runledger.session import through_parquet

def now_col():
    return F.lit(NOW).cast("timestamp")

SUBSETS_SQL = """
    SELECT * FROM (VALUES ('Easy+Medium+Hard', 'Easy', 3, 1.0), ('Easy+Medium+Hard', 'Medium', 3, 1.0),
      ('Easy+Medium+Hard', 'Hard', 3, 1.0), ('Easy+Medium', 'Easy', 2, 1/6.0), ('Easy+Medium', 'Medium', 2, 1/6.0),
      ('Easy+Hard', 'Easy', 2, 1/6.0), ('Easy+Hard', 'Hard', 2, 1/6.0), ('Medium+Hard', 'Medium', 2, 1/6.0),
      ('Medium+Hard', 'Hard', 2, 1/6.0), ('Easy', 'Easy', 1, 1/12.0), ('Medium', 'Medium', 1, 1/12.0),
      ('Hard', 'Hard', 1, 1/12.0)) AS t(element, category, size, weight)"""

SUBSET_SCORE_SQL = f"""
    SELECT c.hotkey, s.element, s.size, CAST(s.weight AS DOUBLE) AS weight, avg(c.category_score) AS subset_score
    FROM ({CATEGORY_SQL}) c JOIN ({SUBSETS_SQL}) s ON s.category = c.category
    GROUP BY c.hotkey, s.element, s.size, s.weight HAVING count(*) = s.size"""

WINNER_SQL = f"""
    SELECT *, weight / count(*) OVER (PARTITION BY element) AS share
    FROM (SELECT *, max(subset_score) OVER (PARTITION BY element) AS winning_score FROM ({SUBSET_SCORE_SQL}))
    WHERE abs(subset_score - winning_score) <= 1e-12 * greatest(1.0, abs(winning_score))"""

BURN_SQL = """
    SELECT is_active, greatest(0.0, least(1.0, burn_ratio)) AS burn_ratio FROM fx_burns
    ORDER BY created_at DESC, request_id DESC LIMIT 1"""


@query("agg7_subset_scores", f"""
    SELECT hotkey, element, size, round(subset_score, 6) AS subset_score FROM ({SUBSET_SCORE_SQL})""")
def agg7(v):
    s = rewards.subset_scores(category_scores(v))
    return rounded(s.select("hotkey", "element", "size", "subset_score"), "subset_score")


@query("win6_winners", f"""
    SELECT hotkey, element, round(winning_score, 6) AS winning_score, round(share, 6) AS share FROM ({WINNER_SQL})""")
def win6(v):
    w = rewards.winners(rewards.subset_scores(through_parquet(category_scores(v), "category-scores")))
    return rounded(w.select("hotkey", "element", "winning_score", "share"), "winning_score", "share")


@query("agg8_reward_weights", f"""
    WITH raw AS (SELECT hotkey, sum(share) AS raw_weight FROM ({WINNER_SQL}) GROUP BY hotkey)
    SELECT hotkey, round(raw_weight, 6) AS raw_weight,
           round(raw_weight * (1 - (SELECT burn_ratio FROM ({BURN_SQL}))) / (SELECT sum(raw_weight) FROM raw), 6) AS final_weight
    FROM raw""")
def agg8(v):
    out = reward_round.build(v.tasks, v.runs, v.validations, v.entrants, v.burns, exclude_banned=False)
    return rounded(out.select("hotkey", "raw_weight", "final_weight"), "raw_weight", "final_weight")


@query("agg10_burn_state", BURN_SQL)
def agg10(v):
    return rewards.burn_state(v.burns)


BOARD_SQL = """
    SELECT c_custkey AS hotkey_id, 'C' || c_custkey AS hotkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 END AS easy,
           CAST(c_custkey % 97 AS DOUBLE) AS medium, CAST(c_custkey % 89 AS DOUBLE) AS hard,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'Failed review' ELSE 'ok' END AS review_status
    FROM customer"""


def board(v):
    return v.table("customer").selectExpr(
        "c_custkey AS hotkey_id", "concat('C', c_custkey) AS hotkey",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 END AS easy",
        "cast(c_custkey % 97 AS double) AS medium", "cast(c_custkey % 89 AS double) AS hard",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Failed review' ELSE 'ok' END AS review_status")


PROJECTION_SQL = f"""
    SELECT *, weight / count(*) OVER (PARTITION BY element) AS share FROM (
      SELECT *, max(subset_score) OVER (PARTITION BY element) AS winning_score FROM (
        SELECT hotkey, unnest(['Overall (E,M,H)', 'Pair (E,M)', 'Pair (E,H)', 'Pair (M,H)', 'Single (E)', 'Single (M)', 'Single (H)']) AS element,
               unnest([1.0::DOUBLE, 1/6.0, 1/6.0, 1/6.0, 1/12.0, 1/12.0, 1/12.0]) AS weight,
               unnest([(easy + medium + hard) / 3, (easy + medium) / 2, (easy + hard) / 2, (medium + hard) / 2, easy, medium, hard]) AS subset_score
        FROM ({BOARD_SQL}) WHERE easy IS NOT NULL AND NOT contains(lower(review_status), 'fail')))
    WHERE abs(subset_score - winning_score) < 1e-9"""


@query("prj10_eligible_entrants", f"""
    SELECT hotkey, round(easy, 6) AS easy, medium, hard FROM ({BOARD_SQL})
    WHERE easy IS NOT NULL AND NOT contains(lower(review_status), 'fail')""")
def prj10(v):
    return rounded(rewards.eligible_entrants(board(v)).select("hotkey", "easy", "medium", "hard"), "easy")


@query("agg9_element_winners", f"""
    SELECT hotkey, element, round(winning_score, 6) AS winning_score, round(share, 6) AS share FROM ({PROJECTION_SQL})""")
def agg9(v):
    w = rewards.element_winners(board(v))
    return rounded(w.select("hotkey", "element", "winning_score", "share"), "winning_score", "share")


@query("agg9_projected_shares", f"""
    SELECT hotkey, round(sum(share) / (SELECT sum(share) FROM ({PROJECTION_SQL})), 4) AS pool_share
    FROM ({PROJECTION_SQL}) GROUP BY hotkey""")
def agg9b(v):
    return rewards.projected_shares(board(v))


@query("joi12_active_at", f"""
    SELECT reward_id, hotkey, weight FROM fx_reward_rows
    WHERE approved AND starts_at <= TIMESTAMP '{NOW}' AND ends_at >= TIMESTAMP '{NOW}'""")
def joi12(v):
    return queues.active_at(v.reward_rows.where("approved"), now_col()).select("reward_id", "hotkey", "weight")


@query("joi12_valid_at_many", """
    SELECT r.reward_id, count(*) AS n_lines FROM fx_reward_rows r
    JOIN (SELECT DISTINCT l_shipdate AS ts FROM lineitem) i ON i.ts BETWEEN r.starts_at AND r.ends_at
    GROUP BY r.reward_id""")
def joi12b(v):
    instants = v.table("lineitem").select(F.col("l_shipdate").alias("ts")).distinct()
    hits = queues.valid_at(instants, v.reward_rows.select("reward_id", "starts_at", "ends_at"), "ts")
    return hits.groupBy("reward_id").agg(F.count(F.lit(1)).alias("n_lines"))


# Registered ids of entrants: every third hotkey is unknown to the registry.
REGISTRY_SQL = "SELECT hotkey, 10 + entrant_id AS uid FROM fx_entrants WHERE entrant_id % 3 <> 2"


def registry(v):
    return v.entrants.where("entrant_id % 3 <> 2").selectExpr("hotkey", "10 + entrant_id AS uid")


@query("joi15_assign_uids", f"""
    SELECT coalesce(g.uid, 0) AS uid, round(sum(r.weight), 6) AS weight
    FROM fx_reward_rows r LEFT JOIN ({REGISTRY_SQL}) g ON g.hotkey = r.hotkey GROUP BY 1""")
def joi15(v):
    return rounded(rewards.assign_uids(v.reward_rows, registry(v)), "weight")


def _payout_sql(scale: str) -> str:
    return f"""
    WITH active AS (SELECT hotkey, sum(weight / {scale}) AS weight FROM fx_reward_rows
        WHERE approved AND starts_at <= TIMESTAMP '{NOW}' AND ends_at >= TIMESTAMP '{NOW}' GROUP BY hotkey),
    parts AS (
      SELECT coalesce(g.uid, 0) AS uid, a.weight FROM active a LEFT JOIN ({REGISTRY_SQL}) g ON g.hotkey = a.hotkey
      UNION ALL SELECT uid, 0.002 FROM ({REGISTRY_SQL})),
    used AS (SELECT sum(weight) AS used FROM parts),
    everything AS (
      SELECT p.uid, p.weight FROM parts p, used u WHERE u.used <= 1.0 + 1e-6
      UNION ALL SELECT 0, CASE WHEN used > 1.0 + 1e-6 THEN 1.0 ELSE greatest(0.0, 1.0 - used) END FROM used)
    SELECT CAST(uid AS BIGINT) AS uid, round(sum(weight), 6) AS weight FROM everything GROUP BY uid"""


@query("agg11_payout", _payout_sql("100"))
def agg11(v):
    active = queues.active_at(v.reward_rows.where("approved"), now_col()).withColumn("weight", F.col("weight") / 100)
    return rounded(rewards.payout(registry(v).select("uid"), 0.002, active, registry(v)), "weight")


@query("agg11_payout_overflow", _payout_sql("0.001"))
def agg11b(v):
    active = queues.active_at(v.reward_rows.where("approved"), now_col()).withColumn("weight", F.col("weight") / 0.001)
    return rounded(rewards.payout(registry(v).select("uid"), 0.002, active, registry(v)), "weight")


@query("agg12_normalize_weights", """
    SELECT hotkey, round(w / sum(w) OVER (), 6) AS weight
    FROM (SELECT hotkey, sum(weight) AS w FROM fx_reward_rows GROUP BY hotkey)""")
def agg12(v):
    sums = v.reward_rows.groupBy("hotkey").agg(F.sum("weight").alias("weight"))
    return rounded(rewards.normalize_weights(sums), "weight")


@query("str10_apply_approval", f"""
    WITH now_rows AS (SELECT *, starts_at <= TIMESTAMP '{NOW}' AND ends_at >= TIMESTAMP '{NOW}' AS live FROM fx_reward_rows),
    hit AS (SELECT DISTINCT competition_id, starts_at, ends_at FROM now_rows
            WHERE approved AND live AND reward_id % 10 = 3),
    kept AS (SELECT n.reward_id, n.hotkey, n.competition_id, n.starts_at, n.ends_at, n.weight, n.approved AND n.reward_id % 10 <> 3 AS approved FROM now_rows n
             WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.competition_id = n.competition_id
                               AND h.starts_at = n.starts_at AND h.ends_at = n.ends_at))
    SELECT hotkey, competition_id, starts_at, ends_at, round(sum(weight), 6) AS weight, count(*) AS n_rows,
           bool_or(approved) AS approved
    FROM (SELECT hotkey, competition_id, starts_at, ends_at, weight, approved FROM kept
          UNION ALL
          SELECT c.hotkey, h.competition_id, h.starts_at, h.ends_at, 0.125, FALSE
          FROM hit h JOIN (SELECT DISTINCT hotkey, competition_id FROM fx_reward_rows) c USING (competition_id))
    GROUP BY hotkey, competition_id, starts_at, ends_at""")
def str10(v):
    changes = v.reward_rows.where("reward_id % 10 = 3").select("reward_id", F.lit(False).alias("approved"))
    candidates = v.reward_rows.select("hotkey", "competition_id").distinct().withColumn("weight", F.lit(0.125))
    out = reward_round.apply_approval(v.reward_rows, changes, candidates, now_col())
    return rounded(out.groupBy("hotkey", "competition_id", "starts_at", "ends_at").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_rows"), F.bool_or("approved").alias("approved")),
        "weight")
