"""Transcript queries over conversations, the tool traces and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.functions import text as T
from runledger.operators import lines as L
from runledger.operators import sessions as S
from runledger.operators import transcripts as X
from runledger.sources import pages as P

KEY = r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("win12_recent_window", """
    SELECT session_id, msg_idx, msg_idx > max(msg_idx) OVER (PARTITION BY session_id) - 3 AS recent FROM fx_messages""")
def win12(v):
    return S.recent_window(v.messages, 3).select("session_id", "msg_idx", "recent")


@query("win12_recent_results", """
    SELECT session_id, msg_idx, role = 'toolresult' AND row_number() OVER (PARTITION BY session_id, role ORDER BY msg_idx DESC) <= 4 AS recent
    FROM fx_trace""")
def win12b(v):
    return S.recent_results(v.trace, 4).select("session_id", "msg_idx", "recent")


@query("win13_duplicate_results", f"""
    SELECT session_id, msg_idx, row_number() OVER (PARTITION BY session_id, {KEY} ORDER BY msg_idx DESC) > 1 AS duplicate
    FROM fx_trace WHERE role = 'toolresult'""")
def win13(v):
    return S.duplicate_results(v.trace).select("session_id", "msg_idx", "duplicate")


@query("joi21_pair_calls", """
    SELECT session_id, msg_idx AS result_idx, msg_idx - 1 AS call_idx, call_id % 10 <> 3 AS matched_by_id
    FROM fx_trace WHERE role = 'toolresult'""")
def joi21(v):
    # every tenth result lost its id, so the nearest earlier call stands in
    broken = v.trace.withColumn("call_id", F.when(
        (F.col("role") == "toolresult") & (F.col("call_id") % 10 == 3), F.lit(None).cast("long")).otherwise(F.col("call_id")))
    return S.pair_calls(broken).select("session_id", "result_idx", "call_idx", "matched_by_id")


# Tagged transcripts whose assistant turns make two calls; ids come back every fourth turn.
STEPS_SQL = "SELECT session_id, (i - 1) // 2 AS j, (i - 1) % 2 AS slot, 'c' || (i - 1) // 2 % 4 || (i - 1) % 2 AS id, event_type, props, k FROM fx_pairs_trace"


def multi_call_messages(v):
    steps = v.trace_pairs.select("session_id", F.floor((F.col("i") - 1) / 2).alias("j"), F.struct(
        ((F.col("i") - 1) % 2).alias("slot"), "event_type", "props", "k").alias("c")).groupBy("session_id", "j").agg(F.array_sort(F.collect_list("c")).alias("calls"))
    ident = lambda c: F.concat(F.lit("c"), F.col("j") % 4, c["slot"])
    called = F.transform("calls", lambda c: F.concat(F.lit('<tool_call name="'), c["event_type"], F.lit('" id="'), ident(c), F.lit('">'), c["props"], F.lit("</tool_call>")))
    answered = F.transform("calls", lambda c: F.concat(
        F.lit('<tool_result tool="'), c["event_type"], F.lit('" tool_call_id="'), ident(c), F.lit('">result '), c["k"], F.lit("</tool_result>")))
    turn = F.concat(F.lit('<message role="assistant"><thinking>so</thinking><text>Step '), "j", F.lit("</text>"), F.array_join(called, "\n"),
                    F.lit("</message>\n"), F.array_join(answered, "\n"))
    docs = steps.groupBy(F.col("session_id").alias("doc_id")).agg(F.concat(
        F.lit('<message role="user"><text>Fix it</text></message>\n<message role="assistant"></message>\n'),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", turn.alias("t")))), lambda x: x["t"]), "\n")).alias("text"))
    return P.transcript_messages(P.parse_transcripts(docs))


@query("src10_transcript_messages", f"""
    WITH s AS ({STEPS_SQL})
    SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role, 'Fix it' AS text, CAST(NULL AS VARCHAR) AS call_id, '' AS calls FROM s
    UNION ALL SELECT session_id, 1 + 3 * j, 'assistant', 'Step ' || j, NULL, string_agg(id || ' ' || event_type || ' ' || props, ';' ORDER BY slot) FROM s GROUP BY session_id, j
    UNION ALL SELECT session_id, 2 + 3 * j + slot, 'toolresult', 'result ' || k, id, '' FROM s""")
def src10b(v):
    listed = F.array_join(F.transform("calls", lambda c: F.concat_ws(" ", c["id"], c["tool"], c["args"])), ";")
    return multi_call_messages(v).select("session_id", "msg_idx", "role", "text", "call_id", listed.alias("calls"))


@query("joi21_pair_reused_ids", f"""
    SELECT session_id, 2 + 3 * j + slot AS result_idx, 1 + 3 * j AS call_idx, k % 10 <> 3 AS matched_by_id FROM ({STEPS_SQL})""")
def joi21b(v):
    lost = (F.col("role") == "toolresult") & F.endswith("text", F.lit("3"))
    return S.pair_calls(multi_call_messages(v).withColumn("call_id", F.when(~lost, F.col("call_id")))).select(
        "session_id", "result_idx", "call_idx", "matched_by_id")


CUT_TRACE = "SELECT * FROM fx_trace WHERE NOT (role = 'toolresult' AND call_id % 11 = 0) AND NOT (role = 'assistant' AND call_id % 13 = 0)"


def cut_trace(v):
    return v.trace.where("NOT (role = 'toolresult' AND call_id % 11 = 0) AND NOT (role = 'assistant' AND call_id % 13 = 0)")


@query("joi22_orphans", f"""
    SELECT session_id, call_id, CASE WHEN bool_or(role = 'assistant') THEN 'call' ELSE 'result' END AS kind
    FROM ({CUT_TRACE}) WHERE call_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT role) = 1""")
def joi22(v):
    return S.orphans(cut_trace(v))


@query("set4_orphan_guard", f"""
    SELECT b.session_id, b.n AS n_in, coalesce(a.n, 0) AS n_out, coalesce(o.n, 0) AS new_orphans,
           coalesce(a.n, 0) > 0 AND coalesce(o.n, 0) = 0 AS ok
    FROM (SELECT session_id, count(*) AS n FROM fx_trace GROUP BY 1) b
    LEFT JOIN (SELECT session_id, count(*) AS n FROM ({CUT_TRACE}) GROUP BY 1) a USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS n FROM (SELECT session_id, call_id FROM ({CUT_TRACE})
               WHERE call_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT role) = 1) GROUP BY 1) o USING (session_id)""")
def set4(v):
    return S.orphan_guard(v.trace, cut_trace(v))


@query("txt12_with_guard", """
    SELECT session_id, count(*) AS n_messages FROM fx_trace
    WHERE session_id % 2 = 0 OR NOT (role = 'assistant' AND call_id % 13 = 0) OR session_id IN (
      SELECT session_id FROM fx_trace WHERE role = 'assistant' AND call_id % 13 = 0) GROUP BY session_id""")
def txt12(v):
    after = v.trace.where("session_id % 2 = 0 OR NOT (role = 'assistant' AND call_id % 13 = 0)")
    return S.with_guard(v.trace, after).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))


RATCHET_SQL = r"""
    SELECT session_id, msg_idx, role, tokens, max(tokens) FILTER (WHERE role = 'toolresult') OVER w AS largest,
           CAST(sum(CASE WHEN role = 'toolresult' THEN tokens ELSE 0 END) OVER w AS BIGINT) AS cumulative,
           CAST(sum(CAST(fail AS INTEGER)) OVER w AS BIGINT) AS fail_rounds,
           bool_or(clean) OVER w AS ever_passed, error, round_no
    FROM (SELECT session_id, msg_idx, role, role = 'toolresult' AND contains(text, 'FAILED') AS error,
                 CASE WHEN role = 'toolresult' THEN row_number() OVER (PARTITION BY session_id, role ORDER BY msg_idx) END AS round_no,
                 greatest(1, CAST(ceil(sum(length(text)) OVER (PARTITION BY session_id ORDER BY msg_idx) / 4.0) AS BIGINT)) AS tokens,
                 role = 'toolresult' AND regexp_matches(text, '\b[1-9]\d*\s+failed\b|\bFAILED\b|\bAssertionError\b') AS fail,
                 role = 'toolresult' AND regexp_matches(text, '\b[1-9]\d* passed\b')
                   AND NOT regexp_matches(text, '\b[1-9]\d*\s+failed\b|\bFAILED\b|\bAssertionError\b') AS clean
          FROM fx_trace)
    WINDOW w AS (PARTITION BY session_id ORDER BY msg_idx)"""


ROUND_SQL = f"""
    SELECT *, bool_or(recent_errors >= 4 AND msg_idx + 1 >= 40) OVER (PARTITION BY session_id ORDER BY msg_idx) AS still_failing FROM (
      SELECT *, CAST(sum(CAST(error AS INTEGER)) OVER (PARTITION BY session_id ORDER BY round_no ROWS 3 PRECEDING) AS BIGINT) AS recent_errors
      FROM ({RATCHET_SQL}) WHERE role = 'toolresult')"""


@query("win15_session_ratchets", f"""
    SELECT session_id, msg_idx, tokens, largest, cumulative, fail_rounds, ever_passed, recent_errors, still_failing FROM ({ROUND_SQL})""")
def win15(v):
    return S.session_ratchets(v.trace)


def mode_sql(rounds: str, flip: str) -> str:
    return f"""
    SELECT session_id, msg_idx, CASE
        WHEN NOT ever_passed AND ({flip} OR still_failing) THEN 'flip'
        WHEN msg_idx + 1 >= 120 OR largest >= 9000 OR cumulative >= 400000 THEN 'rich'
        WHEN largest >= 3000 THEN 'harvest' ELSE 'passthrough' END AS mode
    FROM ({rounds})"""


FLIP = "fail_rounds >= 3 OR (fail_rounds >= 2 AND (largest >= 60000 OR cumulative >= 300000 OR msg_idx + 1 >= 60))"


@query("win16_route_modes", mode_sql(ROUND_SQL, FLIP))
def win16(v):
    return S.route_modes(S.session_ratchets(v.trace), 9_000, 400_000, 120).select("session_id", "msg_idx", "mode")


# every result from position 33 on bears an error that is no failed test: rounds flip from 39 on, by the guard alone
@query("win16_guarded_modes", mode_sql(ROUND_SQL.replace("fx_trace", """(SELECT session_id, msg_idx, role,
      CASE WHEN role = 'toolresult' THEN CASE WHEN msg_idx >= 33 AND session_id % 3 <> 0 THEN 'fatal: no such file' ELSE 'done ' || msg_idx END ELSE text END AS text
      FROM fx_trace)""").replace("contains(text, 'FAILED')", "contains(text, 'fatal:')"), FLIP))
def win16b(v):
    failing = F.when((F.col("msg_idx") >= 33) & (F.col("session_id") % 3 != 0), "fatal: no such file").otherwise(F.concat(F.lit("done "), "msg_idx"))
    rows = v.trace.withColumn("text", F.when(F.col("role") == "toolresult", failing).otherwise(F.col("text")))
    return S.route_modes(S.session_ratchets(rows), 9_000, 400_000, 120).select("session_id", "msg_idx", "mode")


@query("win17_detect_loops", f"""
    SELECT session_id, tool, args, count(*) AS repeats, min(msg_idx) AS first_idx FROM (
      SELECT c.session_id, c.msg_idx, c.tool, c.args || '' AS args, r.k,
             row_number() OVER (PARTITION BY c.session_id ORDER BY c.msg_idx DESC) AS rn
      FROM (SELECT session_id, msg_idx, call_id, tool, '' AS args FROM fx_trace WHERE role = 'assistant') c
      JOIN (SELECT session_id, call_id, {KEY} AS k FROM fx_trace WHERE role = 'toolresult') r
        ON r.session_id = c.session_id AND r.call_id = c.call_id)
    WHERE rn <= 12 GROUP BY session_id, tool, args, k HAVING count(*) >= 3""")
def win17(v):
    # arguments differ on nearly every call of the trace; blank ones make repeats likely
    return S.detect_loops(v.trace.withColumn("args", F.when(F.col("role") == "assistant", F.lit(""))))


@query("win18_recent_errors", """
    SELECT session_id, count(*) AS n_results, count(*) FILTER (WHERE contains(text, 'FAILED')) AS n_errors FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS rn FROM fx_trace WHERE role = 'toolresult')
    WHERE rn <= 4 GROUP BY session_id""")
def win18(v):
    return S.recent_errors(v.trace, 4)


@query("win19_stale_snapshots", r"""
    SELECT t.session_id, t.path, max(t.msg_idx) AS msg_idx, count(*) AS reads FROM (
      SELECT r.session_id, r.msg_idx, 'app/mod' || (CAST(regexp_extract(c.args, '(\d+)', 1) AS BIGINT) % 9) || '.py' AS path
      FROM fx_trace r JOIN fx_trace c ON c.session_id = r.session_id AND c.call_id = r.call_id AND c.role = 'assistant'
      WHERE r.role = 'toolresult') t
    JOIN (SELECT session_id, max(msg_idx) AS last FROM fx_trace GROUP BY 1) s ON s.session_id = t.session_id
    GROUP BY t.session_id, t.path, s.last HAVING count(*) >= 2 AND max(t.msg_idx) <= s.last - 10""")
def win19(v):
    k = F.regexp_extract("args", r"(\d+)", 1).cast("long")
    reading = v.trace.withColumn("args", F.when(
        F.col("role") == "assistant", F.concat(F.lit('{"path": "app/mod'), (k % 9).cast("string"), F.lit('.py:12"}'))))
    return S.stale_snapshots(reading, 10)


@query("win20_prefix_stability", """
    WITH outs AS (SELECT session_id, c AS call_no, msg_idx, role, CASE WHEN msg_idx = session_id % 4 AND c = 2 THEN text || '!' ELSE text END AS text
                  FROM fx_messages, (SELECT unnest([1, 2, 3]) AS c) WHERE msg_idx <= c + 1),
    sizes AS (SELECT session_id, call_no, count(*) AS n FROM outs GROUP BY ALL),
    diff AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.call_no, b.call_no + 1) AS call_no,
                    min(coalesce(a.msg_idx, b.msg_idx)) AS first_diff
             FROM outs a FULL JOIN outs b ON b.session_id = a.session_id AND b.call_no + 1 = a.call_no AND b.msg_idx = a.msg_idx
             WHERE (a.role || a.text) IS DISTINCT FROM (b.role || b.text) GROUP BY ALL)
    SELECT s.session_id, CAST(s.call_no AS INTEGER) AS call_no, p.n AS n_previous, s.n, coalesce(d.first_diff, s.n) AS common_prefix
    FROM sizes s JOIN sizes p ON p.session_id = s.session_id AND p.call_no + 1 = s.call_no
    LEFT JOIN diff d ON d.session_id = s.session_id AND d.call_no = s.call_no""")
def win20(v):
    calls = v.messages.withColumn("call_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("msg_idx <= call_no + 1")
    changed = F.when((F.col("msg_idx") == F.col("session_id") % 4) & (F.col("call_no") == 2), F.concat("text", F.lit("!")))
    return S.prefix_stability(calls.withColumn("text", F.coalesce(changed, "text")))


@query("win21_first_user", """
    SELECT session_id, msg_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS rn
      FROM fx_messages WHERE role = 'user') WHERE rn = 1""")
def win21(v):
    return S.first_user(v.messages)


@query("win21_latest_test_result", """
    SELECT session_id, msg_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS rn
      FROM fx_trace WHERE role = 'toolresult' AND contains(text, 'FAILED')) WHERE rn = 1""")
def win21b(v):
    return S.latest_test_result(v.trace)


@query("txt1_sanitize", """
    SELECT session_id, msg_idx, role FROM fx_messages
    WHERE msg_idx % 5 <> 3 AND NOT (msg_idx % 5 = 2)""")
def txt1(v):
    # every fifth position is a thinking block, another fifth an empty turn
    decorated = v.messages.selectExpr(
        "session_id", "msg_idx", "role", "CASE WHEN msg_idx % 5 = 2 THEN '  ' ELSE text END AS text",
        "cast(NULL AS bigint) AS call_id", "CASE WHEN msg_idx % 5 = 3 THEN 'thinking' ELSE 'text' END AS block_type",
        "CASE WHEN msg_idx % 5 = 2 AND role = 'assistant' THEN 'aborted' END AS error_message")
    return X.sanitize(decorated).select("session_id", "msg_idx", "role")


@query("txt2_prune_recent", """
    SELECT session_id, msg_idx, role FROM (
      SELECT *, max(msg_idx) OVER (PARTITION BY session_id) AS last, count(*) OVER (PARTITION BY session_id) AS n FROM fx_trace)
    WHERE msg_idx = 0 OR n < 9 OR msg_idx > last - 8""")
def txt2(v):
    return X.prune_recent(v.trace).select("session_id", "msg_idx", "role")


@query("txt2_prune_several_calls", f"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY j DESC, slot DESC) AS rn FROM ({STEPS_SQL})),
    w AS (SELECT DISTINCT session_id, id FROM s WHERE rn <= 4), n AS (SELECT session_id FROM s GROUP BY 1 HAVING count(*) >= 4)
    SELECT session_id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role, 0 AS n_calls FROM n
    UNION ALL SELECT session_id, 2 + 3 * j + slot, 'toolresult', 0 FROM s WHERE rn <= 4
    UNION ALL SELECT s.session_id, 1 + 3 * j, 'assistant', CAST(count(*) AS INTEGER) FROM s JOIN w ON w.session_id = s.session_id AND w.id = s.id GROUP BY s.session_id, j""")
def txt2b(v):
    return X.prune_recent(multi_call_messages(v)).select("session_id", "msg_idx", "role", F.size("calls").alias("n_calls"))


@query("txt3_collapse_duplicates", f"""
    SELECT session_id, msg_idx, CASE WHEN role = 'toolresult' AND msg_idx <= last - 6 AND rn > 1
           THEN '[identical to a later tool result in this session]' ELSE text END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role, {KEY} ORDER BY msg_idx DESC) AS rn,
                 max(msg_idx) OVER (PARTITION BY session_id) AS last FROM fx_trace)""")
def txt3(v):
    return X.collapse_duplicates(v.trace, intact=6).select("session_id", "msg_idx", "text")


ACTIVE_SQL = r"""
    SELECT session_id, list_sort(list(DISTINCT name)) AS active FROM (
      SELECT session_id, unnest([p, regexp_extract(p, '/(.*)', 1)]) AS name FROM (
        SELECT session_id, regexp_extract(text, '(app/mod\d\.py)', 1) AS p FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS rn FROM fx_trace) WHERE rn <= 10)
      WHERE p <> '') GROUP BY session_id"""

ACTION_SQL = rf"""
    SELECT session_id, msg_idx, text, CASE WHEN role <> 'toolresult' OR msg_idx > last - 6 THEN 'keep'
             WHEN rn > 1 THEN 'duplicate' WHEN long AND near_rn > 1 AND NOT bearing THEN 'near-duplicate'
             WHEN bearing THEN 'protected' ELSE 'stale' END AS action
    FROM (SELECT t.*, contains(t.text, 'FAILED') OR coalesce(list_bool_or(list_transform(a.active, lambda x: contains(t.text, x))), FALSE)
                 AS bearing, length(form) >= 400 AS long,
                 row_number() OVER (PARTITION BY t.session_id, t.role, {KEY.replace("text", "t.text")} ORDER BY t.msg_idx DESC) AS rn,
                 row_number() OVER (PARTITION BY t.session_id, t.role, form ORDER BY t.msg_idx DESC) AS near_rn,
                 max(t.msg_idx) OVER (PARTITION BY t.session_id) AS last
          FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), '[^a-z]+', ' ', 'g')) AS form FROM fx_trace) t
          LEFT JOIN ({ACTIVE_SQL}) a ON a.session_id = t.session_id)"""


@query("txt4_collapse_near_duplicates", f"SELECT session_id, msg_idx, action FROM ({ACTION_SQL})")
def txt4(v):
    return X.collapse_near_duplicates(v.trace, intact=6).select("session_id", "msg_idx", "action")


@query("txt5_active_paths", f"SELECT session_id, array_to_string(active, ',') AS active FROM ({ACTIVE_SQL})")
def txt5(v):
    return X.active_paths(v.trace).select("session_id", F.array_join("active", ",").alias("active"))


@query("txt6_load_bearing", f"""
    SELECT t.session_id, t.msg_idx, contains(t.text, 'FAILED')
           OR coalesce(list_bool_or(list_transform(a.active, lambda x: contains(t.text, x))), FALSE) AS load_bearing
    FROM fx_trace t LEFT JOIN ({ACTIVE_SQL}) a ON a.session_id = t.session_id WHERE t.role = 'toolresult'""")
def txt6(v):
    return X.load_bearing(v.trace).select("session_id", "msg_idx", "load_bearing")


# Documents carry no error markers or paths, so the only pinned lines are those with a diff or signature shape.
@query("txt7_extractive_compress", r"""
    WITH docs AS (SELECT doc_id, text FROM documents WHERE length(text) > 600),
    ln AS (SELECT doc_id, line_no, line, regexp_matches(line, '^[ \t]*(?:[+\-]|@@|diff --git)') OR regexp_matches(line, '\b(?:def|class)\s+\w+|\bfunction\s+\w+|=>\s*\{')
                  OR regexp_matches(line, '\b\w+\s*\([^)]*\)\s*:') OR regexp_matches(line, '/?[\w.-]+(?:/[\w.-]+)+\.[A-Za-z]{1,4}')
                  OR regexp_matches(lower(line), 'error:|exception:|failed|failures=|errors=|fatal:|assertionerror|traceback \(most recent') AS hit,
                  len(list_distinct(regexp_extract_all(line, '([\p{L}\p{M}\p{N}_]+)', 1))) AS score
           FROM fx_lines WHERE doc_id IN (SELECT doc_id FROM docs)),
    ln2 AS (SELECT *, hit AND regexp_replace(line, '\s', '', 'g') <> '' AS pin FROM ln),
    rest AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) - length(line) - 1
                    + (SELECT coalesce(sum(length(line) + 1), 0) FROM ln2 p WHERE p.pin AND p.doc_id = x.doc_id) AS before
             FROM ln2 x WHERE NOT pin AND trim(regexp_replace(line, '\s', '', 'g')) <> '')
    SELECT d.doc_id, count(k.line_no) AS n_kept, CAST(coalesce(sum(k.line_no), 0) AS BIGINT) AS line_sum
    FROM docs d LEFT JOIN (SELECT doc_id, line_no FROM ln2 WHERE pin UNION ALL SELECT doc_id, line_no FROM rest WHERE before < 600) k
      ON k.doc_id = d.doc_id
    WHERE d.doc_id NOT IN (SELECT doc_id FROM (SELECT l.doc_id, count(*) AS n, count(k2.line_no) AS kept FROM ln2 l
      LEFT JOIN (SELECT doc_id, line_no FROM ln2 WHERE pin UNION ALL SELECT doc_id, line_no FROM rest WHERE before < 600) k2
        ON k2.doc_id = l.doc_id AND k2.line_no = l.line_no GROUP BY l.doc_id) WHERE kept >= n)
    GROUP BY d.doc_id""")
def txt7(v):
    docs = v.documents.where(F.length("text") > 600).select("doc_id", "text")
    n_lines = F.size(F.split("text", "\n", -1))
    # a generator over at most one struct evaluates the selection once
    row = lambda k: F.when(F.size(k) < n_lines, F.array(F.struct(
        F.size(k).cast("long").alias("n_kept"), F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x).alias("line_sum"))))
    return docs.select("doc_id", F.inline(T.let(L.kept_lines(F.col("text"), 600), row)))


@query("txt7_tfidf_compress", r"""
    WITH ln AS (SELECT doc_id, line_no, line, length(line) + 1 AS cost, regexp_replace(line, '\s', '', 'g') = '' AS blank,
                  regexp_matches(line, '^[ \t]*(?:[+\-]|@@|diff --git)') OR regexp_matches(line, '\b(?:def|class)\s+\w+|\bfunction\s+\w+|=>\s*\{')
                  OR regexp_matches(line, '\b\w+\s*\([^)]*\)\s*:') OR regexp_matches(line, '/?[\w.-]+(?:/[\w.-]+)+\.[A-Za-z]{1,4}')
                  OR regexp_matches(lower(line), 'error:|exception:|failed|failures=|errors=|fatal:|assertionerror|traceback \(most recent') AS hit
           FROM fx_lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 600)),
    pins AS (SELECT * FROM ln WHERE hit AND NOT blank), rest AS (SELECT * FROM ln WHERE NOT hit AND NOT blank),
    words AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '([\p{L}\p{M}\p{N}_]+)', 1)) AS term FROM rest),
    counts AS (SELECT doc_id, line_no, term, count(*) AS tf FROM words GROUP BY ALL), nl AS (SELECT doc_id, count(*) AS n FROM rest GROUP BY 1),
    vocab AS (SELECT doc_id, term, count(*) AS df FROM counts GROUP BY ALL),
    w AS (SELECT c.doc_id, c.line_no, c.tf * (ln((1 + nl.n) / (1 + v.df)) + 1) AS w
          FROM counts c JOIN vocab v ON v.doc_id = c.doc_id AND v.term = c.term JOIN nl ON nl.doc_id = c.doc_id),
    s AS (SELECT r.*, round(coalesce(x.score, 0.0), 9) AS score FROM rest r LEFT JOIN (
            SELECT doc_id, line_no, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY ALL) x ON x.doc_id = r.doc_id AND x.line_no = r.line_no),
    run AS (SELECT s.*, sum(cost) OVER (PARTITION BY doc_id ORDER BY score DESC, line_no ROWS UNBOUNDED PRECEDING) - cost
                   + coalesce((SELECT sum(cost) FROM pins p WHERE p.doc_id = s.doc_id), 0) AS before FROM s),
    kept AS (SELECT doc_id, line_no, line FROM pins UNION ALL SELECT doc_id, line_no, line FROM run WHERE before < 600),
    gaps AS (SELECT *, coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -1) AS prev FROM kept),
    out AS (SELECT doc_id, count(*) AS k, max(line_no) AS last, string_agg(CASE WHEN line_no > prev + 1 THEN '…' || chr(10) ELSE '' END || line, chr(10) ORDER BY line_no) AS body
            FROM gaps GROUP BY doc_id),
    fin AS (SELECT d.doc_id, d.text, o.k, len(string_split(d.text, chr(10))) AS n,
                   coalesce(o.body || CASE WHEN o.last < len(string_split(d.text, chr(10))) - 1 THEN chr(10) || '…' ELSE '' END, '…') AS body
            FROM documents d LEFT JOIN out o ON o.doc_id = d.doc_id)
    SELECT doc_id, sha256(CASE WHEN length(text) <= 600 OR k >= n THEN text WHEN length(body) < length(text) THEN body
             WHEN length(text) <= 680 THEN text ELSE substr(text, 1, 450) || chr(10) || '… [' || (length(text) - 600) || ' chars trimmed] …' || chr(10) || right(text, 150) END) AS h
    FROM fin""")
def txt7b(v):
    return L.tfidf_compress(v.table("documents"), 600).select("doc_id", F.sha2("text", 256).alias("h"))


@query("txt8_line_scores", r"""
    SELECT doc_id, line_no, CAST(len(list_distinct(regexp_extract_all(line, '([\p{L}\p{M}\p{N}_]+)', 1))) AS INTEGER) AS score FROM fx_lines""")
def txt8(v):
    return L.line_scores(v.lines)


@query("txt8_tfidf_scores", r"""
    WITH words AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '([\p{L}\p{M}\p{N}_]+)', 1)) AS term FROM fx_lines),
    counts AS (SELECT doc_id, line_no, term, count(*) AS tf FROM words GROUP BY ALL),
    nl AS (SELECT doc_id, count(*) AS n FROM fx_lines GROUP BY 1),
    vocab AS (SELECT doc_id, term, count(*) AS df FROM counts GROUP BY doc_id, term),
    w AS (SELECT c.doc_id, c.line_no, c.tf * (ln((1 + nl.n) / (1 + v.df)) + 1) AS w
          FROM counts c JOIN vocab v ON v.doc_id = c.doc_id AND v.term = c.term JOIN nl ON nl.doc_id = c.doc_id)
    SELECT l.doc_id, l.line_no, round(coalesce(s.score, 0.0), 6) AS score FROM fx_lines l
    LEFT JOIN (SELECT doc_id, line_no, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY doc_id, line_no) s
      ON s.doc_id = l.doc_id AND s.line_no = l.line_no""")
def txt8b(v):
    return rounded(L.tfidf_scores(v.lines), "score")


@query("txt9_compress_gentle", f"""
    SELECT session_id, action, count(*) AS n, CAST(sum(CASE action WHEN 'duplicate' THEN 50 WHEN 'near-duplicate' THEN 55 ELSE length(text) END) AS BIGINT) AS chars
    FROM ({ACTION_SQL}) GROUP BY ALL""")
def txt9(v):
    out = X.compress_gentle(v.trace, intact=6)
    return out.groupBy("session_id", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


PLAN_TEMPLATE = rf"""
    WITH base AS (SELECT *, length(text) AS cost, max(msg_idx) OVER (PARTITION BY session_id) AS last,
                         row_number() OVER (PARTITION BY session_id, role ORDER BY msg_idx DESC) AS newest, {KEY} AS k FROM fx_trace),
    tails AS (SELECT session_id, min(msg_idx) - 1 AS tail_from FROM base WHERE role = 'toolresult' AND newest <= 4 GROUP BY 1),
    rows0 AS (SELECT b.*, t.tail_from, role = 'toolresult' AND msg_idx < tail_from AS item FROM base b JOIN tails t USING (session_id)),
    rows1 AS (SELECT *, item AND contains(text, 'FAILED') AS protected,
                     item AND row_number() OVER (PARTITION BY session_id, item, k ORDER BY msg_idx DESC) > 1 AS dup,
                     CASE WHEN item AND contains(text, 'FAILED') THEN least(cost, 5080) WHEN item THEN least(cost, 1480) ELSE cost END AS plain
              FROM rows0),
    rows2 AS (SELECT *, count(*) FILTER (WHERE dup) OVER s AS pre,
                     sum(CASE WHEN dup THEN 0 ELSE plain END) OVER s + least(40, count(*) FILTER (WHERE dup) OVER s) * 320 AS planned
              FROM rows1 WINDOW s AS (PARTITION BY session_id)),
    cand AS (SELECT session_id, msg_idx, pre, planned, plain, row_number() OVER o AS pos, sum(plain) OVER o AS saved
             FROM rows2 WHERE item AND NOT dup WINDOW o AS (PARTITION BY session_id ORDER BY protected, msg_idx)),
    after AS (SELECT *, planned - saved + (least(40, pre + pos) - least(40, pre)) * 320 AS left_over FROM cand),
    cut AS (SELECT session_id, min(pos) FILTER (WHERE left_over <= $RELIEF) AS cut FROM after GROUP BY 1),
    gone AS (SELECT a.session_id, a.msg_idx FROM after a JOIN cut c USING (session_id)
             WHERE a.planned > $TARGET AND a.planned > $RELIEF AND a.pos <= coalesce(c.cut, a.pos)),
    rows3 AS (SELECT r.*, r.dup OR g.msg_idx IS NOT NULL AS dropped FROM rows2 r
              LEFT JOIN gone g ON g.session_id = r.session_id AND g.msg_idx = r.msg_idx),
    sums AS (SELECT session_id, count(*) FILTER (WHERE dropped) AS n_dropped, count(*) FILTER (WHERE dropped AND dup) AS n_duplicate,
                    sum(CASE WHEN dropped THEN 0 ELSE plain END) + least(40, count(*) FILTER (WHERE dropped)) * 320 AS p0,
                    coalesce(sum(CASE WHEN item AND NOT protected AND NOT dropped THEN plain - least(cost, 780) END), 0) AS g2
             FROM rows3 GROUP BY 1)
    SELECT session_id, n_dropped, n_duplicate, p0 > $TARGET AS trunc2, p0 - CASE WHEN p0 > $TARGET THEN g2 ELSE 0 END > $TARGET AS assist_cap,
           CAST(p0 - CASE WHEN p0 > $TARGET THEN g2 ELSE 0 END AS BIGINT) AS planned_chars
    FROM sums"""
PLAN_SQL = PLAN_TEMPLATE.replace("$TARGET", "32000").replace("$RELIEF", "24000")


# Assistant messages and tail results of the trace are short, so only the first lever changes sizes here.
@query("txt10_structural_plan", PLAN_SQL)
def txt10(v):
    plan = X.structural_plan(v.trace, 8_000)
    return plan.groupBy("session_id").agg(
        F.count_if(F.col("dropped")).alias("n_dropped"), F.count_if(F.col("dropped") & F.col("duplicate")).alias("n_duplicate"),
        F.bool_or("trunc2").alias("trunc2"), F.bool_or("assist_cap").alias("assist_cap"),
        F.max("planned_chars").alias("planned_chars"))


@query("win14_budget_drop", """
    WITH items AS (SELECT conv_id AS session_id, turn, length(text) AS saving, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
                          sum(length(text)) OVER (PARTITION BY conv_id) AS planned FROM conversations),
    after AS (SELECT *, planned - sum(saving) OVER (PARTITION BY session_id ORDER BY pos) + least(pos, 40) * 320 AS left_over FROM items),
    cut AS (SELECT session_id, min(pos) FILTER (WHERE left_over <= planned / 2) AS cut FROM after GROUP BY 1)
    SELECT a.session_id, a.turn, a.planned > 100 AND a.pos <= coalesce(c.cut, a.pos) AS dropped
    FROM after a JOIN cut c USING (session_id)""")
def win14(v):
    msgs = v.table("conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.length("text").alias("saving"),
        (F.col("turn") + 1).alias("pos"), F.lit(0).alias("pre_dropped"))
    totals = msgs.groupBy("session_id").agg(F.sum("saving").alias("planned"), F.min("pos").alias("_lo"))
    items = msgs.join(totals, "session_id").withColumns({"relief": F.col("planned") / 2, "target": F.lit(100)})
    return S.budget_drop(items, "relief", "target").select("session_id", "turn", "dropped")


DIGEST_SQL = r"""
    SELECT session_id, string_agg(entry, chr(10) ORDER BY msg_idx) AS digest FROM (
      SELECT r.session_id, r.msg_idx, row_number() OVER (PARTITION BY r.session_id ORDER BY r.msg_idx DESC) AS rn,
             rtrim('- ' || c.tool || '(' || c.args || ') -> ' || CASE WHEN length(flat) <= 150 THEN flat ELSE substr(flat, 1, 149) || '…' END) AS entry
      FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM fx_trace WHERE role = 'toolresult') r
      JOIN fx_trace c ON c.session_id = r.session_id AND c.call_id = r.call_id AND c.role = 'assistant')
    WHERE rn <= 40 GROUP BY session_id"""


@query("txt11_digest", DIGEST_SQL)
def txt11(v):
    dropped = v.trace.where("role = 'toolresult'").select("session_id", "msg_idx", "text", "call_id", F.lit(False).alias("duplicate"))
    calls = v.trace.where("role = 'assistant'").select("session_id", "call_id", "tool", "args")
    return X.session_digest(X.digest_entries(dropped, calls)).select("session_id", F.array_join("entries", "\n").alias("digest"))


@query("txt11_merge_digest", """
    SELECT session_id, rtrim(text) || chr(10) || chr(10)
      || '[COMPRESSED HISTORY: earlier steps were removed to save context; one line each, oldest first]' || chr(10)
      || '- old entry' || chr(10) || '- new ' || session_id || chr(10) || '[/COMPRESSED HISTORY]' AS text
    FROM fx_messages WHERE msg_idx = 0""")
def txt11b(v):
    old = F.concat("text", F.lit("\n\n" + X.DIGEST_HEADER + "\n- old entry\n" + X.DIGEST_END))
    fresh = F.array(F.concat(F.lit("- new "), F.col("session_id").cast("string")))
    return v.messages.where("msg_idx = 0").select("session_id", X.merge_digest(old, fresh).alias("text"))


@query("txt13_test_status", r"""
    SELECT session_id, string_split(text, chr(10))[1] || chr(10) || string_split(text, chr(10))[2] AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS rn
      FROM fx_trace WHERE role = 'toolresult' AND contains(text, 'FAILED')) WHERE rn = 1""")
def txt13(v):
    return X.test_status(v.trace)


@query("txt14_issue_text", """
    SELECT session_id, CASE WHEN length(t) > 1500 THEN substr(t, 1, 1200) || chr(10) || '…' || chr(10) || right(t, 300) ELSE t END AS issue
    FROM (SELECT session_id, trim(text) AS t, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS rn FROM fx_messages
          WHERE role = 'user') WHERE rn = 1""")
def txt14(v):
    return X.issue_text(v.messages)


@query("txt15_session_notes", r"""
    WITH last AS (SELECT session_id, max(msg_idx) AS m, arg_max(text, msg_idx) FILTER (WHERE role = 'toolresult') AS t FROM fx_trace GROUP BY 1)
    SELECT session_id, m + 1 AS msg_idx, 'user' AS role, '[CONTEXT NOTE]' || chr(10) || CASE WHEN regexp_matches(t, '\b[1-9]\d* passed\b')
             AND NOT contains(t, 'FAILED') THEN 'The tests pass. Stop and return the final answer.'
             ELSE 'Once the change is complete and the tests pass, stop and return the final answer.' END AS text
    FROM last""")
def txt15(v):
    # calls are numbered, so no call repeats and no loop line appears
    numbered = v.trace.withColumn("args", F.concat("args", F.col("msg_idx").cast("string")))
    return X.session_notes(numbered).where("text LIKE '[CONTEXT NOTE]%'").select("session_id", "msg_idx", "role", "text")


@query("txt16_trim_reasoning", """
    SELECT session_id, msg_idx, CASE WHEN role = 'assistant' AND msg_idx <= last - 2 AND length(text) > 240
           THEN substr(text, 1, 100) || chr(10) || '… [reasoning trimmed] …' || chr(10) || right(text, 100) ELSE text END AS text
    FROM (SELECT *, max(msg_idx) OVER (PARTITION BY session_id) AS last FROM fx_messages)""")
def txt16(v):
    return X.trim_reasoning(v.messages, 2, 100, 100).select("session_id", "msg_idx", "text")


@query("txt17_clean_pass", r"""
    SELECT session_id, regexp_matches(t, '\b[1-9]\d* passed\b') AND NOT contains(t, 'FAILED') AS clean_pass
    FROM (SELECT session_id, arg_max(text, msg_idx) AS t FROM fx_trace WHERE role = 'toolresult' GROUP BY 1)""")
def txt17(v):
    return X.clean_pass(v.trace)


@query("txt18_downsample_text", r"""
    WITH s AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens FROM documents),
    t AS (SELECT *, greatest(1, CAST(floor(tokens * 0.4) AS BIGINT)) AS target FROM s),
    p AS (SELECT doc_id, tokens, target, text, greatest(0.01, least(1.0, target::DOUBLE / nullif(tokens, 0))) AS share, regexp_extract_all(text, '[^\\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+[\\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]*') AS pieces FROM t),
    w AS (SELECT *, [regexp_replace(x, '[\\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+$', '') for x in pieces] AS words FROM p),
    c AS (SELECT *, array_to_string([words[i][1:greatest(1, least(length(words[i]), CAST(round_even(length(words[i]) * share, 0) AS INTEGER)))] || pieces[i][length(words[i]) + 1:] for i in range(1, len(pieces) + 1)], '') AS cut FROM w)
    SELECT doc_id, CASE WHEN tokens <= target THEN text WHEN tokens = 0 THEN ''
             ELSE regexp_replace(substr(regexp_replace(regexp_replace(cut, '^\\s+', ''), '\\s+$', ''), 1, target * 4), '\\s+$', '') END AS text FROM c""".replace("\\\\", "\\"))
def txt18(v):
    return v.documents.select("doc_id", L.downsample_text(F.col("text"), 0.4).alias("text"))


@query("txt10_compress_structural", rf"""
    SELECT session_id, count(*) AS n_messages FROM fx_trace GROUP BY session_id
    HAVING FALSE UNION ALL
    SELECT t.session_id, t.n - p.n_dropped AS n_messages FROM (SELECT session_id, count(*) AS n FROM fx_trace GROUP BY 1) t
    JOIN ({PLAN_SQL}) p ON p.session_id = t.session_id""")
def txt10b(v):
    return X.compress_structural(v.trace, 8_000).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query("txt19_audit", f"""
    SELECT a.session_id, greatest(1, CAST(ceil(n_in / 4.0) AS BIGINT)) AS tokens_in, greatest(1, CAST(ceil(n_out / 4.0) AS BIGINT)) AS tokens_out,
           TRUE AS users_kept, TRUE AS newest_kept, TRUE AS guard_ok
    FROM (SELECT session_id, sum(length(text)) AS n_in, sum(CASE action WHEN 'duplicate' THEN 50 WHEN 'near-duplicate' THEN 55 ELSE length(text) END) AS n_out
          FROM ({ACTION_SQL}) GROUP BY 1) a""")
def txt19(v):
    return X.audit(v.trace, X.compress_gentle(v.trace, intact=6), shown=(None, None)).select(
        "session_id", "tokens_in", "tokens_out", "users_kept", "newest_kept", "guard_ok")


# every session shows its task, some a failure of module 5; duplicates and near-duplicates take the older copies of it away
MARKERS = ("keep the public names", "app/mod5.py::test_case_", "never shown")


@query("txt19_audit_markers", f"""
    WITH o AS (SELECT session_id, text, CASE WHEN action IN ('duplicate', 'near-duplicate') OR msg_idx % 7 = 2 THEN '' ELSE text END AS left_over FROM ({ACTION_SQL}))
    SELECT session_id, (NOT bool_or(contains(text, '{MARKERS[0]}')) OR bool_or(contains(left_over, '{MARKERS[0]}')))
           AND (NOT bool_or(contains(text, '{MARKERS[1]}')) OR bool_or(contains(left_over, '{MARKERS[1]}'))) AS markers_kept
    FROM o GROUP BY session_id""")
def txt19b(v):
    gentle = X.compress_gentle(v.trace, intact=6)
    thinner = gentle.withColumn("text", F.when(F.col("msg_idx") % 7 == 2, "").otherwise(F.col("text")))
    return X.audit(v.trace, thinner, MARKERS).select("session_id", "markers_kept")


@query("txt20_profile_sweep")
def txt20(v):
    profiles = v.spark.createDataFrame(
        [("light", 1200, 5000, 10), ("medium", 600, 3000, 8), ("deep", 300, 2000, 6)],
        "profile string, stale_cap int, protected_cap int, intact int")
    out = X.sweep(v.trace, profiles)
    return out.groupBy("profile", "session_id").agg(
        F.sum(F.length("text_in")).alias("chars_in"), F.sum(F.length("text")).alias("chars_out"))


def profile_sql(name: str) -> str:
    """The plan with the knobs of a profile."""
    k = dict(zip(X.KNOBS, X.PROFILES[name]))
    size = lambda part: k[f"{part}_head"] + k[f"{part}_tail"] + 80
    plan = (PLAN_TEMPLATE.replace("$TARGET", str(k["target_tokens"] * 4)).replace("$RELIEF", str(k["target_tokens"] * 3))
            .replace("least(cost, 1480)", f"least(cost, {size('mid')})").replace("least(cost, 780)", f"least(cost, {size('small')})"))
    return f"SELECT '{name}' AS profile, session_id, n_dropped, n_duplicate, trunc2, assist_cap, planned_chars FROM ({plan})"


@query("txt20_structural_sweep", " UNION ALL ".join(profile_sql(name) for name in X.PROFILES))
def txt20b(v):
    plan = X.structural_plan(v.trace, profiles=X.profile_table(v.spark, X.PROFILES))
    return plan.groupBy("session_id").agg(
        F.count_if(F.col("dropped")).alias("n_dropped"), F.count_if(F.col("dropped") & F.col("duplicate")).alias("n_duplicate"),
        F.bool_or("trunc2").alias("trunc2"), F.bool_or("assist_cap").alias("assist_cap"), F.max("planned_chars").alias("planned_chars")).select(
        "session_id.profile", F.col("session_id.session_id").alias("session_id"), "n_dropped", "n_duplicate", "trunc2", "assist_cap", "planned_chars")


SAVINGS_SQL = f"""
    SELECT m.mode, a.tokens_in, 1 - a.tokens_out / a.tokens_in AS savings
    FROM (SELECT session_id, greatest(1, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT)) AS tokens_in,
                 greatest(1, CAST(ceil(sum(CASE action WHEN 'duplicate' THEN 50 WHEN 'near-duplicate' THEN 55 ELSE length(text) END) / 4.0) AS BIGINT)) AS tokens_out
          FROM ({ACTION_SQL}) GROUP BY 1) a
    JOIN (SELECT session_id, CASE WHEN sum(length(text)) >= 40000 THEN 'rich' ELSE 'harvest' END AS mode FROM fx_trace GROUP BY 1) m
      ON m.session_id = a.session_id"""


def audited_modes(v):
    audited = X.audit(v.trace, X.compress_gentle(v.trace, intact=6)).select("session_id", "tokens_in", "savings")
    return audited.withColumn("mode", F.when(F.col("tokens_in") * 4 >= 40000, "rich").otherwise("harvest"))


@query("agg38_savings_by_mode", f"""
    SELECT CASE WHEN tokens_in * 4 >= 40000 THEN 'rich' ELSE 'harvest' END AS mode, count(*) AS n, round(avg(savings), 6) AS mean_savings,
           round(min(savings), 6) AS min_savings, round(max(savings), 6) AS max_savings, round(quantile_cont(tokens_in, 0.95), 6) AS p95_tokens
    FROM ({SAVINGS_SQL}) GROUP BY 1""")
def agg38(v):
    return rounded(X.savings_by_mode(audited_modes(v)), "mean_savings", "min_savings", "max_savings", "p95_tokens")


@query("agg38_latency", """
    WITH t AS (SELECT user_id, sum(value) AS s FROM events GROUP BY user_id), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM t)
    SELECT count(*) AS n, round(avg(s), 6) AS mean_seconds, round(max(CASE WHEN i = floor(0.95 * n) THEN s END), 6) AS p95_seconds, round(max(s), 6) AS max_seconds FROM r""")
def agg38b(v):
    times = v.table("events").groupBy("user_id").agg(F.sum("value").alias("seconds"))
    return rounded(X.latency_summary(times), "mean_seconds", "p95_seconds", "max_seconds")


@query("txt21_savings_report", f"""
    SELECT session_id, round(1 - tokens_out / tokens_in, 6) AS savings, CASE WHEN tokens_in * 4 >= 40000 THEN 'rich' ELSE 'harvest' END AS mode
    FROM (SELECT session_id, greatest(1, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT)) AS tokens_in,
                 greatest(1, CAST(ceil(sum(CASE action WHEN 'duplicate' THEN 50 WHEN 'near-duplicate' THEN 55 ELSE length(text) END) / 4.0) AS BIGINT)) AS tokens_out
          FROM ({ACTION_SQL}) GROUP BY 1)""")
def txt21(v):
    return rounded(audited_modes(v).select("session_id", "savings", "mode"), "savings")
