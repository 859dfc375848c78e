"""Screening gates, queues, statuses, competition lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.catalog.rewards import now_col
from runledger.catalog.scoring import ELIGIBLE_SQL
from runledger.catalog.views import NOW
from runledger.operators import gates, queues, screening
from runledger.scale import ranked

STATS_SQL = """
    SELECT t.competition_id, r.entrant_id, r.task_id, count(*) FILTER (WHERE v.scored_at IS NOT NULL) AS total_scored,
           count(*) FILTER (WHERE v.resolved AND v.scored_at IS NOT NULL) AS resolved_count
    FROM fx_runs r JOIN fx_validations v ON v.run_id = r.run_id JOIN fx_tasks t ON t.task_id = r.task_id
    WHERE t.is_screener AND NOT r.baseline_run GROUP BY ALL"""


@query("agg13_screener_task_stats", STATS_SQL)
def agg13(v):
    return screening.screener_task_stats(v.tasks, v.judged)


@query("agg14_screener_eligible", f"SELECT hotkey, resolved_tasks FROM ({ELIGIBLE_SQL})")
def agg14(v):
    return screening.screener_eligible(v.tasks, v.judged, v.entrants).select("hotkey", "resolved_tasks")


def scripts(v):
    return queues.latest_scripts(v.uploads, ("competition_id", "entrant_id", "script_id")).select(
        "competition_id", "entrant_id", "script_id")


VERDICT_SQL = """
    SELECT s.competition_id, s.entrant_id, s.script_id, coalesce(n.n_screeners, 0) AS n_screeners,
           CAST(coalesce(p.judged, 0) AS BIGINT) AS judged, coalesce(p.tasks_won, 0) AS tasks_won,
           coalesce(p.judged, 0) >= coalesce(n.n_attempts, 0) AS complete,
           coalesce(p.judged, 0) >= coalesce(n.n_attempts, 0)
             AND coalesce(p.tasks_won, 0) >= least(n.n_screeners, greatest(1, ceil(n.n_screeners * 0.6))) AS passed
    FROM (SELECT DISTINCT competition_id, entrant_id, script_id FROM fx_uploads) s
    LEFT JOIN (SELECT competition_id, count(*) AS n_screeners, sum(planned_repeats) AS n_attempts
               FROM fx_tasks WHERE is_screener GROUP BY competition_id) n ON n.competition_id = s.competition_id
    LEFT JOIN (SELECT competition_id, entrant_id, script_id, sum(judged) AS judged,
                      count(*) FILTER (WHERE won > repeats // 2) AS tasks_won
               FROM (SELECT competition_id, entrant_id, script_id, task_id, repeats, count(verdict) AS judged,
                            count(*) FILTER (WHERE verdict) AS won
                     FROM (SELECT t.competition_id, r.entrant_id, r.script_id, r.task_id, t.planned_repeats AS repeats, r.attempt_no,
                                  arg_max(struct_pack(v := CASE WHEN v.scored_at IS NOT NULL THEN v.resolved END), v.validation_id).v AS verdict
                           FROM fx_runs r JOIN fx_tasks t ON t.task_id = r.task_id
                           JOIN fx_validations v ON v.run_id = r.run_id
                           WHERE t.is_screener AND NOT r.baseline_run AND r.attempt_no BETWEEN 1 AND t.planned_repeats
                           GROUP BY ALL)
                     GROUP BY ALL) GROUP BY ALL) p
      ON p.competition_id = s.competition_id AND p.entrant_id = s.entrant_id AND p.script_id = s.script_id"""


@query("agg15_screening_verdict", VERDICT_SQL)
def agg15(v):
    return screening.screening_verdict(v.tasks, v.runs, v.validations, scripts(v))


PROGRESS_SQL = """
    SELECT p.*, n.expected_runs, p.scored_runs >= n.expected_runs AS fully_scored
    FROM (SELECT t.competition_id, r.entrant_id, r.script_id,
                 bool_or(r.status = 'dispatched' AND t.is_screener) AS has_dispatched_screener,
                 bool_or(r.status = 'dispatched' AND NOT t.is_screener) AS has_dispatched_other,
                 count(DISTINCT r.run_id) FILTER (WHERE v.scored_at IS NOT NULL AND v.resolved IS NOT NULL) AS scored_runs
          FROM fx_runs r JOIN fx_tasks t ON t.task_id = r.task_id LEFT JOIN fx_validations v ON v.run_id = r.run_id
          WHERE NOT r.baseline_run GROUP BY ALL) p
    JOIN (SELECT competition_id, CAST(sum(planned_repeats) AS BIGINT) AS expected_runs FROM fx_tasks GROUP BY 1) n
      ON n.competition_id = p.competition_id"""


@query("agg16_run_progress", PROGRESS_SQL)
def agg16(v):
    return screening.run_progress(v.tasks, v.runs, v.validations)


@query("agg17_baseline_complete", """
    SELECT t.competition_id, t.expected_runs, coalesce(d.n, 0) AS judged_runs, coalesce(d.n, 0) >= t.expected_runs AS complete
    FROM (SELECT competition_id, CAST(sum(planned_repeats) AS BIGINT) AS expected_runs FROM fx_tasks GROUP BY 1) t
    LEFT JOIN (SELECT t.competition_id, count(DISTINCT r.run_id) AS n FROM fx_runs r JOIN fx_tasks t ON t.task_id = r.task_id
               JOIN fx_validations v ON v.run_id = r.run_id
               WHERE r.baseline_run AND v.scored_at IS NOT NULL AND v.resolved IS NOT NULL GROUP BY 1) d
      ON d.competition_id = t.competition_id""")
def agg17(v):
    return screening.baseline_complete(v.tasks, v.runs, v.validations)


@query("agg18_needs_screener", """
    SELECT s.script_id, s.competition_id, e.expected_items, coalesce(d.n, 0) AS scored_items,
           coalesce(d.n, 0) < e.expected_items AS needs_screener
    FROM (SELECT DISTINCT script_id, competition_id FROM fx_uploads) s
    JOIN (SELECT competition_id, count(*) * CASE competition_id WHEN 0 THEN 3 ELSE 1 END AS expected_items
          FROM fx_screeners GROUP BY 1) e ON e.competition_id = s.competition_id
    LEFT JOIN (SELECT i.script_id, count(DISTINCT i.item_id) AS n FROM fx_items i JOIN fx_item_scores c ON c.item_id = i.item_id
               WHERE i.challenge_id IN (SELECT challenge_id FROM fx_screeners) GROUP BY 1) d ON d.script_id = s.script_id""")
def agg18(v):
    done = v.items.join(v.item_scores.select("item_id"), "item_id", "left_semi").select(
        "script_id", "item_id", "challenge_id")
    # configurations per competition come from the screener table itself
    configs = v.screeners.select("competition_id").distinct().withColumn(
        "ratios", F.when(F.col("competition_id") == 0, F.lit("[0.2, 0.4, 0.6]")))
    who = v.uploads.select("script_id", "competition_id").distinct()
    return screening.needs_screener(who, done, v.screeners, configs)


CUSTOMER_RANK_SQL = """
    SELECT *, CAST(rank() OVER (PARTITION BY competition_id ORDER BY avg_score DESC NULLS LAST, first_upload ASC NULLS LAST, hotkey)
           AS INTEGER) AS rank
    FROM (SELECT c_nationkey AS competition_id, 'C' || c_custkey AS hotkey, CASE WHEN c_custkey % 13 = 0 THEN NULL
                 ELSE CAST(c_custkey % 50 AS DOUBLE) END AS avg_score, min(o_orderdate) AS first_upload
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey)"""


def ranked_customers(v):
    first = v.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_upload"))
    scores = v.table("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "c_nationkey AS competition_id", "concat('C', c_custkey) AS hotkey",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(c_custkey % 50 AS double) END AS avg_score", "first_upload")
    return screening.screener_rank(scores)


@query("win8_screener_rank", CUSTOMER_RANK_SQL)
def win8(v):
    return ranked_customers(v)


@query("joi11_top_fraction", f"""
    SELECT competition_id, hotkey, rank, total_eligible, top_limit
    FROM (SELECT *, count(*) OVER (PARTITION BY competition_id) AS total_eligible,
                 CAST(ceil(0.2 * count(*) OVER (PARTITION BY competition_id)) AS INTEGER) AS top_limit
          FROM ({CUSTOMER_RANK_SQL})) WHERE rank <= top_limit""")
def joi11(v):
    return screening.top_fraction(ranked_customers(v), 0.2).select(
        "competition_id", "hotkey", "rank", "total_eligible", "top_limit")


@query("win7_top_screeners", f"""
    SELECT competition_id, count(*) AS n_top, max(rank) AS last_rank
    FROM (SELECT *, ceil(0.35 * count(*) OVER (PARTITION BY competition_id)) AS top_limit FROM ({CUSTOMER_RANK_SQL}))
    WHERE rank <= top_limit GROUP BY competition_id""")
def win7(v):
    return screening.top_fraction(ranked_customers(v), 0.35).groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("n_top"), F.max("rank").alias("last_rank"))


ITEM_MEAN_SQL = """
    SELECT l.competition_id, e.hotkey, i.compression_ratio, avg(s.score) AS score
    FROM fx_items i JOIN fx_item_scores s ON s.item_id = i.item_id JOIN fx_links l ON l.challenge_id = i.challenge_id
    JOIN fx_entrants e ON e.entrant_id = i.entrant_id GROUP BY ALL"""


def item_means(v, *keys):
    joined = (v.items.join(v.item_scores, "item_id").join(v.links.select("challenge_id", "competition_id"), "challenge_id")
              .join(v.entrants.select("entrant_id", "hotkey"), "entrant_id"))
    return joined.groupBy("competition_id", "hotkey", *keys).agg(F.avg("score").alias("score"))


@query("win9_competition_rank", f"""
    SELECT competition_id, hotkey, round(score, 6) AS score,
           CAST(rank() OVER (PARTITION BY competition_id ORDER BY score DESC NULLS LAST, hotkey) AS INTEGER) AS rank
    FROM ({ITEM_MEAN_SQL.replace("i.compression_ratio, ", "")})""")
def win9(v):
    return rounded(screening.competition_rank(item_means(v)), "score")


@query("win9_ratio_rank", f"""
    SELECT competition_id, hotkey, compression_ratio, round(score, 6) AS score,
           CAST(rank() OVER (PARTITION BY competition_id, compression_ratio ORDER BY score DESC NULLS LAST, hotkey) AS INTEGER) AS rank
    FROM ({ITEM_MEAN_SQL})""")
def win9b(v):
    return rounded(screening.ratio_rank(item_means(v, "compression_ratio")), "score")


@query("top5_choose_screeners", """
    SELECT competition_id, task_id, passes, CAST(pick AS INTEGER) AS pick FROM (
      SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY passes DESC, md5('7:' || task_id)) AS pick
      FROM (SELECT t.competition_id, t.task_id, count(v.run_id) AS passes FROM fx_tasks t
            LEFT JOIN fx_runs r ON r.task_id = t.task_id AND r.baseline_run
            LEFT JOIN fx_validations v ON v.run_id = r.run_id AND v.resolved AND v.scored_at IS NOT NULL
            GROUP BY ALL)) WHERE pick <= 5""")
def top5(v):
    return screening.choose_screeners(v.tasks, v.runs, v.validations, 5, seed=7).select(
        "competition_id", "task_id", "passes", "pick")


@query("set1_screeners_with_grace", """
    WITH ranked AS (SELECT c_custkey AS id, c_nationkey, row_number() OVER (PARTITION BY c_nationkey % 2 ORDER BY c_acctbal DESC, c_custkey) AS pos
                    FROM customer),
    both_lists AS (SELECT id, 0 AS list_no, pos FROM ranked WHERE c_nationkey % 2 = 0 OR id % 3 = 0
                   UNION ALL SELECT id, 1, pos FROM ranked WHERE c_nationkey % 2 = 1)
    SELECT id, CAST(f.list_no AS INTEGER) AS list_no, CAST(f.pos AS INTEGER) AS pos
    FROM (SELECT id, min(struct_pack(list_no, pos)) AS f FROM both_lists GROUP BY id)""")
def set1(v):
    placed = ranked(v.table("customer").select(
        F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_nationkey") % 2).alias("half"), "c_acctbal"),
        ["half"], "c_acctbal", ["id"], "pos")
    current = placed.where("c_nationkey % 2 = 0 OR id % 3 = 0")
    previous = placed.where("c_nationkey % 2 = 1")
    start = F.lit("1998-05-31 22:00:00").cast("timestamp")
    return screening.screeners_with_grace(current, previous, now_col(), start)


@query("win1_latest_scripts", """
    SELECT entrant_id, competition_id, upload_id, script_id, created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY entrant_id ORDER BY created_at DESC, upload_id DESC) AS rn FROM fx_uploads)
    WHERE rn = 1""")
def win1(v):
    return queues.latest_scripts(v.uploads)


ELIGIBLE_UPLOADS_SQL = """
    SELECT u.* FROM fx_uploads u
    WHERE EXISTS (SELECT 1 FROM fx_api_keys k WHERE k.entrant_id = u.entrant_id AND k.revoked_at IS NULL)
      AND EXISTS (SELECT 1 FROM fx_entrants e WHERE e.entrant_id = u.entrant_id AND NOT e.banned)"""


@query("joi5_eligible_scripts", ELIGIBLE_UPLOADS_SQL)
def joi5(v):
    return queues.eligible_scripts(v.uploads, v.api_keys, v.entrants)


@query("win2_latest_eligible_script", f"""
    SELECT competition_id, entrant_id, script_id, upload_id
    FROM (SELECT *, row_number() OVER (PARTITION BY competition_id, entrant_id ORDER BY created_at DESC, upload_id DESC) AS rn
          FROM ({ELIGIBLE_UPLOADS_SQL})) WHERE rn = 1""")
def win2(v):
    return queues.latest_eligible_script(v.uploads, v.api_keys, v.entrants).select(
        "competition_id", "entrant_id", "script_id", "upload_id")


@query("top3_dispatch_queue", f"""
    SELECT run_id, task_id, competition_id, attempt_no, baseline_run, first_upload_at, created_at FROM (
      SELECT r.run_id, r.task_id, t.competition_id, r.attempt_no, r.baseline_run, r.created_at,
             CASE WHEN NOT r.baseline_run THEN u.first_upload END AS first_upload_at
      FROM fx_runs r JOIN fx_tasks t ON t.task_id = r.task_id
      LEFT JOIN (SELECT script_id, competition_id, min(created_at) AS first_upload FROM fx_uploads GROUP BY ALL) u
        ON u.script_id = r.script_id AND u.competition_id = t.competition_id
      WHERE r.status = 'pending' AND (r.baseline_run OR EXISTS (
        SELECT 1 FROM ({ELIGIBLE_UPLOADS_SQL}) e WHERE e.entrant_id = r.entrant_id AND e.script_id = r.script_id
          AND e.competition_id = t.competition_id)))
    ORDER BY baseline_run DESC, first_upload_at ASC NULLS LAST, created_at, run_id LIMIT 500""")
def top3(v):
    return queues.dispatch_queue(v.runs, v.tasks, v.uploads, v.api_keys, v.entrants, 500)


@query("set2_missing_baseline_runs", """
    SELECT task_id, competition_id, CAST(attempt_no AS INTEGER) AS attempt_no
    FROM (SELECT task_id, competition_id, unnest(generate_series(1, planned_repeats)) AS attempt_no FROM fx_tasks) p
    WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE r.baseline_run AND r.task_id = p.task_id AND r.attempt_no = p.attempt_no)""")
def set2(v):
    return queues.missing_runs(v.tasks, v.runs)


@query("set2_missing_script_runs", """
    SELECT p.task_id, p.competition_id, p.entrant_id, p.script_id, CAST(p.attempt_no AS INTEGER) AS attempt_no
    FROM (SELECT t.task_id, t.competition_id, s.entrant_id, s.script_id, unnest(generate_series(1, t.planned_repeats)) AS attempt_no
          FROM fx_tasks t JOIN (SELECT DISTINCT competition_id, entrant_id, script_id FROM fx_uploads) s USING (competition_id)) p
    WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE NOT r.baseline_run AND r.task_id = p.task_id
                      AND r.attempt_no = p.attempt_no AND r.entrant_id = p.entrant_id AND r.script_id = p.script_id)""")
def set2b(v):
    return queues.missing_runs(v.tasks, v.runs, scripts(v))


@query("joi10_filter_pairs", """
    SELECT r.run_id, r.entrant_id, r.script_id FROM fx_runs r
    WHERE (r.entrant_id, r.script_id) IN (SELECT entrant_id, script_id FROM fx_uploads WHERE competition_id = 1)""")
def joi10(v):
    return queues.filter_pairs(v.runs, v.uploads.where("competition_id = 1")).select("run_id", "entrant_id", "script_id")


@query("joi7_unassigned_challenges", """
    SELECT script_id, challenge_id FROM (
      SELECT s.script_id, l.challenge_id, row_number() OVER (PARTITION BY s.script_id ORDER BY l.challenge_id) AS rn
      FROM (SELECT DISTINCT script_id, competition_id FROM fx_uploads WHERE competition_id = 0) s
      JOIN fx_links l ON l.competition_id = s.competition_id AND l.is_active
      WHERE NOT EXISTS (SELECT 1 FROM fx_items i WHERE i.script_id = s.script_id AND i.challenge_id = l.challenge_id))
    WHERE rn <= 10""")
def joi7(v):
    who = v.uploads.where("competition_id = 0").select("script_id", "competition_id").distinct()
    active = v.links.where("is_active").select("competition_id", "challenge_id")
    return queues.unassigned_challenges(active, v.items, who, 10).select("script_id", "challenge_id")


# Counters per entrant, derived from uploads so that they grow with the data.
STATUS_SQL = """
    SELECT entrant_id, max(created_at) AS last_submit, count(*) % 7 AS n_screener, count(*) % 5 AS scored_screener,
           count(*) % 2 AS pending_screener, count(*) % 11 AS n_competition, count(*) % 3 AS scored_competition,
           CASE WHEN entrant_id = 2 THEN NULL ELSE count(*) % 2 END AS pending_competition
    FROM fx_uploads GROUP BY entrant_id"""


def status(v):
    n = F.count(F.lit(1))
    return v.uploads.groupBy("entrant_id").agg(
        F.max("created_at").alias("last_submit"), (n % 7).alias("n_screener"), (n % 5).alias("scored_screener"),
        (n % 2).alias("pending_screener"), (n % 11).alias("n_competition"), (n % 3).alias("scored_competition"),
        F.when(F.col("entrant_id") != 2, n % 2).alias("pending_competition"))


OPEN_SQL = """
    SELECT i.* FROM fx_items i WHERE NOT EXISTS (SELECT 1 FROM fx_item_scores s WHERE s.item_id = i.item_id)
      AND NOT EXISTS (SELECT 1 FROM fx_assignments a WHERE a.batch_id = i.batch_id)"""

SCREENER_WORK_SQL = f"""
    SELECT s.entrant_id, s.last_submit, s.scored_screener + s.pending_screener < s.n_screener
           OR s.entrant_id IN (SELECT entrant_id FROM ({OPEN_SQL}) WHERE entrant_id <> 4 AND challenge_id IN
              (SELECT challenge_id FROM fx_screeners)) AS has_work
    FROM ({STATUS_SQL}) s"""


@query("joi8_has_screener_work", SCREENER_WORK_SQL)
def joi8(v):
    return queues.has_screener_work(status(v), v.items.where("entrant_id <> 4"), v.item_scores, v.assignments,
                                    v.screeners).select("entrant_id", "last_submit", "has_work")


@query("joi9_has_competition_work", f"""
    SELECT s.entrant_id, s.last_submit, coalesce(s.scored_competition, 0) + coalesce(s.pending_competition, 0) < s.n_competition
           OR s.entrant_id IN (SELECT entrant_id FROM ({OPEN_SQL}) WHERE entrant_id < 3
              AND challenge_id IN (SELECT challenge_id FROM fx_links WHERE is_active AND competition_id = 0)
              AND challenge_id NOT IN (SELECT challenge_id FROM fx_screeners)) AS has_work
    FROM ({STATUS_SQL}) s""")
def joi9(v):
    return queues.has_competition_work(
        status(v), v.items.where("entrant_id < 3"), v.item_scores, v.assignments,
        v.links.where("is_active AND competition_id = 0"), v.screeners).select("entrant_id", "last_submit", "has_work")


@query("top4_next_entrant", f"""
    SELECT entrant_id, last_submit FROM ({SCREENER_WORK_SQL}) WHERE has_work ORDER BY last_submit ASC NULLS LAST, entrant_id LIMIT 1""")
def top4(v):
    return queues.next_entrant(joi8(v)).select("entrant_id", "last_submit")


@query("top6_activate_latest", """
    SELECT link_id, is_active, rn <= 300 AS new_active, is_active <> (rn <= 300) AS flipped
    FROM (SELECT *, row_number() OVER (ORDER BY generated_at DESC, challenge_id DESC, link_id) AS rn FROM fx_links)""")
def top6(v):
    return queues.activate_latest(v.links, 300).select("link_id", "is_active", "new_active", "flipped")


@query("joi13_previous_competition", """
    SELECT c.competition_id, c.upload_starts_at, max(p.upload_starts_at) AS previous_start,
           arg_max(p.competition_id, (p.upload_starts_at, p.competition_id)) AS previous_id
    FROM fx_competitions c LEFT JOIN fx_competitions p ON p.upload_starts_at < c.upload_starts_at GROUP BY ALL""")
def joi13(v):
    return queues.previous_competition(v.competitions)


@query("joi14_active_competition", f"""
    SELECT competition_id, name, CAST(priority AS INTEGER) AS priority FROM (
      SELECT *, CASE WHEN upload_starts_at <= TIMESTAMP '{NOW}' AND eval_ends_at >= TIMESTAMP '{NOW}' THEN 0 ELSE 1 END AS priority
      FROM fx_competitions WHERE is_active) ORDER BY priority, upload_starts_at DESC, competition_id DESC LIMIT 1""")
def joi14(v):
    return queues.active_competition(v.competitions, now_col()).select("competition_id", "name", "priority")


@query("prj13_status_overrides", f"""
    WITH latest AS (SELECT competition_id, entrant_id, script_id FROM (
        SELECT *, row_number() OVER (PARTITION BY competition_id, entrant_id ORDER BY created_at DESC, upload_id DESC) AS rn
        FROM fx_uploads) WHERE rn = 1),
    prog AS ({PROGRESS_SQL}), verd AS ({VERDICT_SQL})
    SELECT l.competition_id, l.entrant_id, e.hotkey, CASE WHEN e.banned THEN 'failed review'
        WHEN NOT EXISTS (SELECT 1 FROM fx_api_keys k WHERE k.entrant_id = l.entrant_id AND k.revoked_at IS NULL) THEN 'no api key'
        WHEN p.fully_scored THEN 'scored' WHEN p.has_dispatched_other THEN 'evaluating'
        WHEN p.has_dispatched_screener THEN 'screening' WHEN v.complete AND NOT v.passed THEN 'not qualified' END AS status
    FROM latest l JOIN fx_entrants e ON e.entrant_id = l.entrant_id
    LEFT JOIN prog p ON p.competition_id = l.competition_id AND p.entrant_id = l.entrant_id AND p.script_id = l.script_id
    LEFT JOIN verd v ON v.competition_id = l.competition_id AND v.entrant_id = l.entrant_id AND v.script_id = l.script_id""")
def prj13(v):
    latest = queues.latest_scripts(v.uploads, ("competition_id", "entrant_id"))
    return gates.status_overrides(
        v.entrants, latest, v.api_keys, screening.run_progress(v.tasks, v.runs, v.validations),
        screening.screening_verdict(v.tasks, v.runs, v.validations, scripts(v)))


COUNTER_SQL = """
    SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 5 END AS n_competition,
           CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 7 % 4 END AS scored_competition,
           CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS n_screener, c_custkey % 6 % 5 AS scored_screener,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 9 = 0 AS INTEGER) END AS pending_screener,
           CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 2 END AS pending_competition,
           c_custkey % 2 = 0 AS in_top, c_custkey % 23 <> 0 AS has_script, c_custkey % 29 = 0 AS banned
    FROM customer"""


@query("prj12_entrant_status", f"""
    SELECT c_custkey, CASE WHEN banned THEN 'banned' WHEN NOT has_script THEN 'idle'
        WHEN n_competition IS NOT NULL AND scored_competition IS NOT NULL AND scored_competition >= n_competition THEN 'scored'
        WHEN n_competition IS NOT NULL AND scored_competition IS NOT NULL AND scored_competition > 0 THEN 'evaluating'
        WHEN pending_screener > 0 THEN 'screening'
        WHEN n_screener > 0 AND scored_screener < n_screener THEN 'screening'
        WHEN n_screener > 0 AND in_top AND coalesce(pending_competition, 0) = 0 AND coalesce(scored_competition, 0) = 0 THEN 'qualified'
        WHEN n_screener > 0 AND NOT in_top THEN 'not qualified'
        WHEN pending_competition > 0 THEN 'evaluating' ELSE 'in queue' END AS status
    FROM ({COUNTER_SQL})""")
def prj12(v):
    counters = v.table("customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 5 END AS n_competition",
        "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 7 % 4 END AS scored_competition",
        "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS n_screener", "c_custkey % 6 % 5 AS scored_screener",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(c_custkey % 9 = 0 AS int) END AS pending_screener",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 2 END AS pending_competition",
        "c_custkey % 2 = 0 AS in_top", "c_custkey % 23 <> 0 AS has_script", "c_custkey % 29 = 0 AS banned")
    return counters.select("c_custkey", gates.entrant_status().alias("status"))


@query("prj14_competition_type", """
    SELECT competition_id, name, CASE WHEN competition_id IN (SELECT competition_id FROM fx_tasks)
           THEN 'agent tasks' ELSE 'text compression' END AS competition_type FROM fx_competitions""")
def prj14(v):
    return gates.competition_type(v.competitions.select("competition_id", "name"), v.tasks)


@query("prj20_stake_gate", """
    SELECT c.hotkey, s.stake, CASE WHEN s.hotkey IS NULL THEN 'not registered'
             WHEN s.stake IS NULL OR s.stake < 3000 THEN 'insufficient total stake'
             WHEN s.alpha_stake IS NULL THEN 'alpha stake unavailable'
             WHEN s.alpha_stake < 500 THEN 'insufficient alpha stake' ELSE 'sufficient' END AS reason,
           coalesce(s.stake >= 3000 AND s.alpha_stake >= 500, FALSE) AS is_valid
    FROM (SELECT 'V' || s_suppkey AS hotkey FROM supplier) c
    LEFT JOIN (SELECT 'V' || (s_suppkey + 1) AS hotkey, s_acctbal AS stake,
                      CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal / 8 END AS alpha_stake FROM supplier) s
      ON s.hotkey = c.hotkey""")
def prj20(v):
    who = v.table("supplier").selectExpr("concat('V', s_suppkey) AS hotkey")
    stakes = v.table("supplier").selectExpr(
        "concat('V', s_suppkey + 1) AS hotkey", "s_acctbal AS stake",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal / 8 END AS alpha_stake")
    return gates.stake_gate(who, stakes, 3000.0, 500.0)


REQUESTS_SQL = """
    SELECT o_orderkey AS request_id, o_custkey AS entrant_id, o_custkey % 40 AS competition_id, o_orderdate AS requested_at FROM orders"""


@query("prj21_upload_gate", f"""
    SELECT r.request_id, r.entrant_id, r.competition_id,
      CASE WHEN w.competition_id IS NULL OR r.requested_at < w.upload_starts_at OR r.requested_at > w.upload_ends_at THEN 'uploads closed'
           WHEN r.entrant_id % 9 = 0 THEN 'banned'
           WHEN epoch(r.requested_at) - epoch(r.prev) < 2592000 THEN 'too frequent'
           WHEN r.nth > 1 THEN 'already uploaded' ELSE 'ok' END AS reason
    FROM (SELECT *, lag(requested_at) OVER (PARTITION BY entrant_id ORDER BY requested_at, request_id) AS prev,
                 row_number() OVER (PARTITION BY entrant_id, competition_id ORDER BY requested_at, request_id) AS nth
          FROM ({REQUESTS_SQL})) r
    LEFT JOIN (SELECT s_suppkey AS competition_id, TIMESTAMP '1995-06-01 00:00:00' + to_days(CAST(s_suppkey % 50 AS INTEGER)) AS upload_starts_at,
                      TIMESTAMP '2000-06-01 00:00:00' AS upload_ends_at FROM supplier WHERE s_suppkey % 40 <> 7) w
      ON w.competition_id = r.competition_id""")
def prj21(v):
    requests = v.table("orders").selectExpr(
        "o_orderkey AS request_id", "o_custkey AS entrant_id", "o_custkey % 40 AS competition_id", "o_orderdate AS requested_at")
    people = v.table("customer").selectExpr("c_custkey AS entrant_id", "c_custkey % 9 = 0 AS banned")
    windows = v.table("supplier").where("s_suppkey % 40 <> 7").selectExpr(
        "s_suppkey AS competition_id",
        "timestamp'1995-06-01 00:00:00' + make_dt_interval(cast(s_suppkey % 50 AS int)) AS upload_starts_at",
        "timestamp'2000-06-01 00:00:00' AS upload_ends_at")
    return gates.upload_gate(requests, people, windows, 2592000)


@query("prj22_validate_windows", f"""
    SELECT r.reward_id AS request_id, r.competition_id, CASE WHEN (s IS NULL) <> (e IS NULL) THEN 'both ends needed together'
        WHEN s IS NULL THEN 'window required' WHEN c.competition_id IS NULL THEN 'competition not found'
        WHEN TIMESTAMP '{NOW}' < c.eval_ends_at THEN 'evaluation not ended' WHEN s >= e THEN 'start not before end' ELSE 'ok' END AS reason
    FROM (SELECT reward_id, reward_id % 150 AS competition_id, CASE WHEN reward_id % 11 IN (0, 1) THEN NULL ELSE starts_at END AS s,
                 CASE WHEN reward_id % 11 IN (1, 2) THEN NULL WHEN reward_id % 13 = 0 THEN starts_at ELSE ends_at END AS e
          FROM fx_reward_rows) r LEFT JOIN fx_competitions c ON c.competition_id = r.competition_id""")
def prj22(v):
    requests = v.reward_rows.selectExpr(
        "reward_id AS request_id", "reward_id % 150 AS competition_id",
        "CASE WHEN reward_id % 11 IN (0, 1) THEN NULL ELSE starts_at END AS starts_at",
        "CASE WHEN reward_id % 11 IN (1, 2) THEN NULL WHEN reward_id % 13 = 0 THEN starts_at ELSE ends_at END AS ends_at")
    return gates.validate_windows(requests, v.competitions, now_col())


@query("prj11_mask_until", f"""
    SELECT competition_id, CASE WHEN TIMESTAMP '{NOW}' >= eval_starts_at THEN name ELSE '[hidden]' END AS name,
           eval_starts_at FROM fx_competitions""")
def prj11(v):
    return gates.mask_until(v.competitions.select("competition_id", "name", "eval_starts_at"), ["name"],
                            F.col("eval_starts_at"), now_col())


PAGE_STATUS_SQL = """
    SELECT c_nationkey AS competition_id, 'C' || c_custkey AS hotkey, c_mktsegment AS status, max(o_orderdate) AS last_submit
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_nationkey, c_custkey, c_mktsegment"""


@query("joi3_leaderboard_page", f"""
    SELECT CAST(rn AS INTEGER) AS position, competition_id, hotkey, status, last_submit, score, screener_score, total_rows FROM (
      SELECT s.*, c.score, q.screener_score, row_number() OVER (ORDER BY s.last_submit DESC NULLS LAST, s.hotkey, s.competition_id) AS rn,
             count(*) OVER () AS total_rows
      FROM ({PAGE_STATUS_SQL}) s
      LEFT JOIN (SELECT c_nationkey AS competition_id, 'C' || c_custkey AS hotkey, c_acctbal AS score FROM customer WHERE c_custkey % 3 <> 0) c
        ON c.competition_id = s.competition_id AND c.hotkey = s.hotkey
      LEFT JOIN (SELECT c_nationkey AS competition_id, 'C' || c_custkey AS hotkey, -c_acctbal AS screener_score FROM customer WHERE c_custkey % 4 <> 0) q
        ON q.competition_id = s.competition_id AND q.hotkey = s.hotkey) WHERE rn <= 100""")
def joi3(v):
    from runledger.operators import boards

    c = v.table("customer")
    submits = v.table("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_submit"))
    key = ["c_nationkey AS competition_id", "concat('C', c_custkey) AS hotkey"]
    status_rows = c.join(submits, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(*key, "c_mktsegment AS status", "last_submit")
    out = boards.board_page(status_rows, c.where("c_custkey % 3 <> 0").selectExpr(*key, "c_acctbal AS score"),
                            c.where("c_custkey % 4 <> 0").selectExpr(*key, "-c_acctbal AS screener_score"), 1, 100)
    return out.select("position", "competition_id", "hotkey", "status", "last_submit", "score", "screener_score", "total_rows")
