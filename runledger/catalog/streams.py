"""Streaming jobs drained over the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.catalog.rewards import now_col
from runledger.catalog.views import NOW
from runledger.session import scratch_path, through_parquet
from runledger.streaming import leases, live, timers
from runledger.streaming.tables import AppendTable, FoldedTable, drain


PARTS = 3
# rows arrive up to a day early or late; streams wait for three days
JITTER_DAYS, LATE, LATE_SECONDS = 1, "3 days", 3 * 86_400


def arrivals(rows, ts: str, tie: str):
    """The rows in three parts by time, out of order at the seams: each row is shifted by a hash of ``tie`` within the jitter."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [rows]
    shift = (F.pmod(F.xxhash64(tie), F.lit(2001)) / 1000 - 1) * JITTER_DAYS * 86_400_000_000
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((at - low + shift) * PARTS / (high - low + 1))))
    return [rows.where(part == i) for i in range(PARTS)]


def drain_parts(v, parts, run) -> None:
    """Deliver the parts one after the other; the stream is started anew for each, from its checkpoint."""
    path = scratch_path(v.spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(path)
        run(v.spark.readStream.schema(part.schema).parquet(path))


def folded(v, label: str, schema: str, fold) -> FoldedTable:
    return FoldedTable(v.spark, scratch_path(v.spark, label), schema, fold)


def marked(v, schema: str):
    """Table of late rows, table of newest times and checkpoint of a stream that `timers.follow_marked` drains."""
    return AppendTable(v.spark, scratch_path(v.spark, "late"), schema), folded(v, "marks", timers.MARKS, timers.fold_marks), scratch_path(v.spark, "cp")


def timed(df, *cols: str):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def beats(events):
    return timed(events.selectExpr(
        "user_id AS entity", "event_type AS status", "CASE WHEN value > 15 THEN concat('v', cast(value AS int)) END AS version",
        "CASE WHEN event_type = 'signup' THEN concat('m', event_id % 5) END AS model", "ts", "event_id AS beat_id"), "ts")


HEARTBEAT_SQL = """
    SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_seen,
           arg_max('v' || CAST(trunc(value) AS INTEGER), (ts, event_id)) FILTER (WHERE value > 15) AS version,
           arg_max('m' || (event_id % 5), (ts, event_id)) FILTER (WHERE event_type = 'signup') AS model, count(*) AS n_beats
    FROM events GROUP BY user_id"""


@query("str1_heartbeat_state", HEARTBEAT_SQL)
def str1(v):
    return live.heartbeat_state(beats(v.table("events")))


def followed_beats(v):
    state, checkpoint = folded(v, "heartbeats", live.STATE, live.fold_heartbeats), scratch_path(v.spark, "cp")
    history = AppendTable(v.spark, scratch_path(v.spark, "history"), live.HISTORY)
    drain_parts(v, arrivals(beats(v.table("events")), "ts", "beat_id"), lambda stream: live.follow_heartbeats(stream, state, history, checkpoint))
    return state, history


@query("str1_heartbeat_stream", HEARTBEAT_SQL)
def str1b(v):
    return live.heartbeat_view(followed_beats(v)[0].current())


@query("str1_heartbeat_history", "SELECT user_id AS entity, event_type AS status, ts, event_id AS beat_id FROM events")
def str1c(v):
    return followed_beats(v)[1].current()


@query("str2_requeue_stale", f"""
    SELECT run_id, s AS requeued, CASE WHEN s THEN 'pending' ELSE status END AS status
    FROM (SELECT *, status = 'dispatched' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 2400 SECOND AS s FROM fx_runs)""")
def str2(v):
    return leases.requeue_stale(v.runs, now_col()).select("run_id", "requeued", "status")


REQUEUE_TTL = 6 * 3600
# one run per user and day
REQUEUE_SQL = f"""
    WITH b AS (SELECT user_id * 100 + day(ts) AS run_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'pending' ELSE 'dispatched' END AS status,
                      ts, event_id FROM events),
    n AS (SELECT run_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS t_at FROM b GROUP BY run_id),
    w AS (SELECT *, status = 'dispatched' AND date_trunc('millisecond', t_at) + INTERVAL {REQUEUE_TTL} SECOND
             < (SELECT date_trunc('millisecond', max(ts)) FROM b) - INTERVAL 3 DAY AS stale FROM n)
    SELECT run_id, stale AS requeued, CASE WHEN stale THEN 'pending' ELSE status END AS status,
           CASE WHEN stale THEN t_at + INTERVAL {REQUEUE_TTL} SECOND ELSE t_at END AS updated_at FROM w"""


@query("str2_requeue_stream", REQUEUE_SQL)
def str2b(v):
    rows = timed(v.table("events").selectExpr(
        "user_id * 100 + day(ts) AS run_id", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'pending' ELSE 'dispatched' END AS status",
        "ts", "event_id AS beat_id"), "ts")
    state, (late, marks, checkpoint) = folded(v, "dispatches", timers.DISPATCHES, timers.fold_dispatches), marked(v, timers.BEATS)
    drain_parts(v, arrivals(rows, "ts", "beat_id"), lambda stream: timers.follow_dispatches(stream, state, late, marks, checkpoint, LATE_SECONDS))
    settled = timers.requeued_at(state.current(), timers.watermark_millis(marks, LATE_SECONDS), REQUEUE_TTL)
    return timers.dispatch_view(settled, REQUEUE_TTL).select("run_id", "requeued", "status", "updated_at")


@query("str3_expire_assignments", f"""
    SELECT batch_id, validator_id FROM fx_assignments WHERE done_at IS NOT NULL OR assigned_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR""")
def str3(v):
    kept, _ = leases.expire_assignments(v.assignments, v.items, v.item_scores, now_col(), 48)
    return kept.select("batch_id", "validator_id")


@query("str3_expire_derived_rows", f"""
    SELECT item_id, validator_id FROM fx_item_scores WHERE item_id NOT IN (SELECT item_id FROM fx_items WHERE batch_id IN (
      SELECT batch_id FROM fx_assignments WHERE done_at IS NULL AND assigned_at < TIMESTAMP '{NOW}' - INTERVAL 48 HOUR))""")
def str3b(v):
    _, derived = leases.expire_assignments(v.assignments, v.items, v.item_scores, now_col(), 48)
    return derived.select("item_id", "validator_id")


LEASE_SQL = """
    WITH a AS (SELECT o_orderkey AS batch_id, o_custkey % 5 AS validator_id, o_orderdate AS t_at, o_totalprice > 200000 AS done FROM orders),
    d AS (SELECT l_orderkey AS batch_id, l_suppkey % 5 AS validator_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS item_id,
                 min(o_orderdate + to_hours(CAST(l_linenumber * 13 AS INTEGER))) AS t_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    w AS (SELECT max(t_at) - INTERVAL 3 DAY AS w FROM (SELECT CASE WHEN done THEN t_at + INTERVAL 6 HOUR ELSE t_at END AS t_at FROM a UNION ALL SELECT t_at FROM d)),
    gone AS (SELECT batch_id, t_at + INTERVAL 48 HOUR AS until FROM a, w WHERE NOT done AND t_at + INTERVAL 48 HOUR < w)
    SELECT batch_id, validator_id, CAST(NULL AS BIGINT) AS item_id FROM a WHERE batch_id NOT IN (SELECT batch_id FROM gone)
    UNION ALL
    SELECT d.batch_id, validator_id, item_id FROM d LEFT JOIN gone g ON g.batch_id = d.batch_id AND d.t_at <= g.until WHERE g.batch_id IS NULL"""


@query("str3_lease_stream", LEASE_SQL)
def str3c(v):
    orders = v.table("orders")
    assigned = orders.selectExpr("o_orderkey AS batch_id", "'assigned' AS kind", "o_custkey % 5 AS validator_id", "cast(NULL AS bigint) AS item_id", "o_orderdate AS ts")
    done = orders.where("o_totalprice > 200000").selectExpr(
        "o_orderkey", "'done'", "o_custkey % 5", "cast(NULL AS bigint)", "o_orderdate + make_dt_interval(0, 6)")
    derived = v.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey AS batch_id", "l_suppkey % 5 AS validator_id", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS item_id",
        "o_orderdate + make_dt_interval(0, l_linenumber * 13) AS ts").groupBy("batch_id", "validator_id", "item_id").agg(F.min("ts").alias("ts"))
    rows = timed(assigned.unionAll(done).unionAll(derived.selectExpr("batch_id", "'derived'", "validator_id", "item_id", "ts")), "ts")
    # every part reads the rows
    rows = through_parquet(rows, "changes")
    state, (late, marks, checkpoint) = folded(v, "changes", timers.CHANGES, timers.fold_changes), marked(v, timers.CHANGES)
    drain_parts(v, arrivals(rows, "ts", "batch_id"), lambda stream: timers.follow_leases(stream, state, late, marks, checkpoint, LATE_SECONDS))
    held = timers.leases_at(state.current(), timers.watermark_millis(marks, LATE_SECONDS), 48 * 3600)
    return held.where("live").select("batch_id", "validator_id", "item_id")


@query("str4_claimable", f"""
    SELECT v.validation_id, v.run_id, CASE WHEN r.status = 'failed' THEN 'score false' ELSE 'claim' END AS action
    FROM fx_validations v JOIN (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'failed' ELSE status END AS status FROM fx_runs) r ON r.run_id = v.run_id
    WHERE v.scored_at IS NULL AND v.resolved IS NULL AND r.status IN ('completed', 'failed') AND coalesce(v.validator_id = 4 OR v.claim_expires_at < TIMESTAMP '{NOW}'
      OR (v.claim_expires_at IS NULL AND (v.claimed_at IS NULL OR v.claimed_at < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND)), FALSE)""")
def str4(v):
    runs = v.runs.withColumn("status", F.when(F.col("run_id") % 7 == 0, "failed").otherwise(F.col("status")))
    verdicts = v.validations.withColumn("validator_id", F.when(F.col("validator_id") != 4, F.col("validator_id")))
    return leases.claimable(verdicts, runs, now_col(), 900).select("validation_id", "run_id", "action")


RATE_SQL = """
    SELECT key_id, unit, bucket, n, CASE unit WHEN 'minute' THEN greatest(1, 60 - CAST(floor(epoch(last_ts)) AS BIGINT) % 60)
           ELSE greatest(1, 86400 - CAST(floor(epoch(last_ts)) AS BIGINT) % 86400) END AS retry_after
    FROM (SELECT user_id % 10 AS key_id, 'minute' AS unit, date_trunc('minute', ts) AS bucket, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ALL
          UNION ALL SELECT user_id % 10, 'day', date_trunc('day', ts), count(*), max(ts) FROM events GROUP BY ALL)
    WHERE n > CASE unit WHEN 'minute' THEN 1 ELSE 30 END"""


def requests(events):
    return events.selectExpr("user_id % 10 AS key_id", "ts")


@query("str5_rate_windows", RATE_SQL)
def str5(v):
    return live.rate_windows(requests(v.table("events")), 1, 30)


@query("str5_rate_windows_stream", RATE_SQL)
def str5b(v):
    windows, checkpoint = folded(v, "windows", live.WINDOWS, live.fold_windows), scratch_path(v.spark, "cp")
    late = AppendTable(v.spark, scratch_path(v.spark, "late"), live.LATE)
    rows = timed(requests(v.table("events")), "ts")
    drain_parts(v, arrivals(rows, "ts", "ts"), lambda stream: live.follow_requests(stream, windows, late, checkpoint, 3 * 86_400))
    return live.over_limit(windows.current(), 1, 30)


BOARD_SQL = "SELECT user_id AS entity, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS best FROM events GROUP BY user_id"


@query("str6_refresh_views", BOARD_SQL)
def str6(v):
    board, checkpoint = folded(v, "board", live.BOARD, live.fold_board), scratch_path(v.spark, "cp")
    rows = v.table("events").selectExpr("user_id AS entity", "value", "ts", "event_id")
    drain_parts(v, arrivals(rows, "ts", "event_id"), lambda stream: live.follow_board(stream, board, checkpoint))
    return rounded(live.board_view(board.current()), "mean")


FOLLOW_SQL = """
    WITH outs AS (SELECT conv_id AS session_id, c AS call_no, turn AS msg_idx, role, CASE WHEN turn = conv_id % 4 AND c = 2 THEN text || '!' ELSE text END AS text
                  FROM conversations, (SELECT unnest([1, 2, 3]) AS c) WHERE turn <= c + 1),
    sizes AS (SELECT session_id, call_no, count(*) AS n FROM outs GROUP BY ALL),
    same AS (SELECT a.session_id, a.call_no, count(*) AS k FROM outs a JOIN outs b ON b.session_id = a.session_id AND b.call_no + 1 = a.call_no
             AND b.msg_idx = a.msg_idx AND b.role = a.role AND b.text = a.text GROUP BY ALL)
    SELECT s.session_id, CAST(s.call_no AS BIGINT) AS call_no, coalesce(m.k = p.n, FALSE) AS continued, s.n AS n_messages,
           s.n - CASE WHEN m.k = p.n THEN p.n ELSE 0 END AS new_messages
    FROM sizes s LEFT JOIN sizes p ON p.session_id = s.session_id AND p.call_no + 1 = s.call_no
    LEFT JOIN same m ON m.session_id = s.session_id AND m.call_no = s.call_no"""


def call_rows(conversations):
    calls = conversations.select(F.col("conv_id").alias("session_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))
                                 .alias("call_no"), F.col("turn").alias("msg_idx"), "role", "text").where("msg_idx <= call_no + 1")
    changed = F.when((F.col("msg_idx") == F.col("session_id") % 4) & (F.col("call_no") == 2), F.concat("text", F.lit("!")))
    return calls.withColumn("text", F.coalesce(changed, "text"))


@query("str7_follow_sessions", FOLLOW_SQL)
def str7(v):
    return live.follow_sessions(call_rows(v.table("conversations")))


# inputs go on from the previous output (session % 3 = 0), from the previous input (1) or from neither (2); one session in seven is silent for 40 days
SESSION_TTL = 30 * 86_400
CALLS_SQL = f"""
    WITH sz AS (SELECT conv_id AS s, c, count(*) AS n FROM conversations, (SELECT unnest([1, 2, 3]) AS c) WHERE turn <= c + 1 GROUP BY ALL),
    i AS (SELECT conv_id AS s, sz.c, turn AS t, role, CASE WHEN conv_id % 3 = 0 AND turn < p.n - 1 THEN 'kept ' || turn WHEN conv_id % 3 = 2 THEN text || sz.c ELSE text END AS x
          FROM conversations m JOIN sz ON sz.s = conv_id AND turn <= sz.c + 1 LEFT JOIN sz p ON p.s = conv_id AND p.c = sz.c - 1),
    o AS (SELECT conv_id AS s, c, turn AS t, role, 'kept ' || turn AS x FROM conversations JOIN sz ON sz.s = conv_id AND turn < n - 1),
    so AS (SELECT i.s, i.c, count(*) AS k FROM i JOIN o ON o.s = i.s AND o.c = i.c - 1 AND o.t = i.t AND o.role = i.role AND o.x = i.x GROUP BY ALL),
    si AS (SELECT i.s, i.c, count(*) AS k FROM i JOIN i j ON j.s = i.s AND j.c = i.c - 1 AND j.t = i.t AND j.role = i.role AND j.x = i.x GROUP BY ALL),
    f AS (SELECT sz.s, sz.c, sz.n, p.n AS pn, CASE WHEN p.n IS NULL OR (sz.c = 3 AND sz.s % 7 = 6) THEN 'reset'
            WHEN coalesce(so.k, 0) = p.n - 1 THEN 'output' WHEN coalesce(si.k, 0) = p.n THEN 'input' ELSE 'reset' END AS matched
          FROM sz LEFT JOIN sz p ON p.s = sz.s AND p.c = sz.c - 1 LEFT JOIN so ON so.s = sz.s AND so.c = sz.c LEFT JOIN si ON si.s = sz.s AND si.c = sz.c)
    SELECT s AS session_id, CAST(c AS BIGINT) AS call_no, matched, n AS n_messages,
           CASE matched WHEN 'output' THEN n - (pn - 1) WHEN 'input' THEN n - pn ELSE n END AS new_messages,
           CASE matched WHEN 'input' THEN pn - 1 + n - pn ELSE n END AS n_working FROM f"""


def stateful_calls(conversations):
    """One row per call: the keys of its messages and of those that were made of them."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    calls = turns.select("conv_id", "m", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("c"))
    size = lambda c: F.size(F.filter("m", lambda x: x["turn"] <= c + 1))
    kept = lambda x: F.concat(F.lit("kept "), x["turn"])
    text = lambda x: (F.when((F.col("conv_id") % 3 == 0) & (F.col("c") > 1) & (x["turn"] < size(F.col("c") - 1) - 1), kept(x))
                      .when(F.col("conv_id") % 3 == 2, F.concat(x["text"], F.col("c"))).otherwise(x["text"]))
    key = lambda role, t: F.sha2(F.concat_ws("|", role, t), 256)
    silent = F.when((F.col("c") == 3) & (F.col("conv_id") % 7 == 6), 40 * 24).otherwise(0)
    return calls.select(
        F.col("conv_id").alias("session_id"), F.col("c").cast("long").alias("call_no"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("c") + silent)).alias("ts"),
        F.transform(F.filter("m", lambda x: x["turn"] <= F.col("c") + 1), lambda x: key(x["role"], text(x))).alias("input_keys"),
        F.transform(F.filter("m", lambda x: x["turn"] < size(F.col("c")) - 1), lambda x: key(x["role"], kept(x))).alias("output_keys"))


@query("str7_calls", CALLS_SQL)
def str7c(v):
    return timers.follow_calls(stateful_calls(v.table("conversations")), SESSION_TTL).drop("ts")


@query("str7_stateful_stream", CALLS_SQL)
def str7b(v):
    calls = through_parquet(stateful_calls(v.table("conversations")), "calls")
    out, checkpoint = AppendTable(v.spark, scratch_path(v.spark, "sessions"), timers.CALLS), scratch_path(v.spark, "cp")
    drain_parts(v, [calls.where(F.col("call_no") == i) for i in (1, 2, 3)], lambda stream: drain(
        timers.session_stream(stream, SESSION_TTL, "60 days"), lambda batch, n: out.commit(n, batch), checkpoint, "update"))
    return out.current().drop("ts")


INGEST_SQL = """
    SELECT user_id, props, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id) AS rn FROM events)
    WHERE rn = 1"""


@query("str8_ingest_newest_stream", INGEST_SQL)
def str8(v):
    table = folded(v, "ingest", "user_id bigint, props string, ts timestamp, event_id bigint", live.keep_newest(["user_id", "props"], "ts", "event_id"))
    checkpoint, rows = scratch_path(v.spark, "cp"), timed(v.table("events").select("user_id", "props", "ts", "event_id"), "ts")
    drain_parts(v, arrivals(rows, "ts", "event_id"), lambda stream: live.follow_newest(stream, table, checkpoint))
    return table.current()


@query("str8_ingest_distinct_stream", "SELECT DISTINCT event_id FROM events")
def str8b(v):
    # every event is delivered twice; the second copy falls inside the watermark
    table, checkpoint = AppendTable(v.spark, scratch_path(v.spark, "distinct"), "event_id bigint"), scratch_path(v.spark, "cp")
    twice = timed(v.table("events").select("event_id", "ts"), "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    drain_parts(v, arrivals(twice, "ts", "event_id"), lambda stream: drain(
        live.ingest_stream(stream, ["event_id"], "ts", LATE).select("event_id"), lambda batch, n: table.commit(n, batch), checkpoint))
    return table.current()


QUEUE_SQL = """
    SELECT event_id AS id, user_id % 6 AS attempts, ts AS next_attempt_at, CASE WHEN user_id % 17 = 3 THEN '{broken' ELSE props END AS payload FROM events"""
DUE = "2024-01-12 00:00:00"


def delivery_queue(v):
    return v.table("events").selectExpr("event_id AS id", "user_id % 6 AS attempts", "ts AS next_attempt_at",
                                        "CASE WHEN user_id % 17 = 3 THEN '{broken' ELSE props END AS payload")


@query("str9_retry_due", f"""
    SELECT id, attempts, next_attempt_at FROM (SELECT * FROM ({QUEUE_SQL}) WHERE next_attempt_at <= TIMESTAMP '{DUE}' ORDER BY next_attempt_at, id LIMIT 1000)
    WHERE payload <> '{{broken'""")
def str9(v):
    return leases.retry_due(delivery_queue(v), F.lit(DUE).cast("timestamp"), 1000).select("id", "attempts", "next_attempt_at")


@query("str9_retry_stats", f"""
    SELECT count(*) AS queued, count(*) FILTER (WHERE attempts > 0) AS retry_backlog, count(*) FILTER (WHERE next_attempt_at <= TIMESTAMP '{DUE}') AS due_now
    FROM ({QUEUE_SQL})""")
def str9b(v):
    return leases.retry_stats(delivery_queue(v), F.lit(DUE).cast("timestamp"))


@query("str9_reschedule", f"""
    SELECT id, attempts + 1 AS attempts, TIMESTAMP '{DUE}' + to_seconds(CAST(least(300, 2 * pow(2, attempts)) AS INTEGER)) AS next_attempt_at FROM ({QUEUE_SQL})""")
def str9c(v):
    return leases.reschedule(delivery_queue(v), F.lit(DUE).cast("timestamp")).select("id", "attempts", "next_attempt_at")


@query("str11_drop_inactive_batches", """
    SELECT DISTINCT batch_id FROM fx_items WHERE batch_id NOT IN (SELECT i.batch_id FROM fx_items i JOIN fx_links l ON l.challenge_id = i.challenge_id
      JOIN fx_competitions c ON c.competition_id = l.competition_id WHERE NOT c.is_active)""")
def str11(v):
    return leases.drop_inactive_batches(v.items.select("batch_id").distinct(), v.items, v.links, v.competitions)
