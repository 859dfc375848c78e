"""Text question rounds and the text-level gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.functions import text as T
from runledger.operators import gates, qa

ITEM_SCORE_SQL = """
    SELECT i.*, s.score, s.last_scored_at FROM fx_items i LEFT JOIN (SELECT item_id, avg(score) AS score, max(scored_at) AS last_scored_at
      FROM fx_item_scores GROUP BY item_id) s ON s.item_id = i.item_id"""


@query("agg19_item_scores", f"""
    SELECT item_id, challenge_id, compression_ratio, round(score, 7) AS score, last_scored_at FROM ({ITEM_SCORE_SQL})""")
def agg19(v):
    return rounded(qa.item_scores(v.items, v.item_scores).select(
        "item_id", "challenge_id", "compression_ratio", "score", "last_scored_at"), "score", digits=7)


CHALLENGE_SQL = f"""
    SELECT i.item_id, i.batch_id, i.script_id, e.hotkey, i.challenge_id, l.competition_id, i.compression_ratio,
           round(i.score, 7) AS score
    FROM ({ITEM_SCORE_SQL}) i JOIN fx_links l ON l.challenge_id = i.challenge_id AND l.is_active
    JOIN fx_entrants e ON e.entrant_id = i.entrant_id"""
CHALLENGE_COLS = ["item_id", "batch_id", "script_id", "hotkey", "challenge_id", "competition_id", "compression_ratio", "score"]


@query("joi4_challenge_scores", CHALLENGE_SQL)
def joi4(v):
    return rounded(qa.challenge_scores(v.items, v.item_scores, v.links, v.entrants).select(*CHALLENGE_COLS), "score", digits=7)


@query("joi6_screener_challenge_scores",
       f"SELECT * FROM ({CHALLENGE_SQL}) WHERE challenge_id IN (SELECT challenge_id FROM fx_screeners)")
def joi6(v):
    return rounded(qa.screener_challenge_scores(v.items, v.item_scores, v.links, v.entrants, v.screeners).select(
        *CHALLENGE_COLS), "score", digits=7)


# A question per part and order line: produced answer, truth and scores come from the line items.
@query("joi23_question_detail", """
    SELECT q.question_id, q.question, p.answer, t.truth, round(s.avg_score, 6) AS avg_score, s.details
    FROM (SELECT p_partkey AS question_id, p_name AS question FROM part) q
    LEFT JOIN (SELECT p_partkey AS question_id, p_type AS answer FROM part WHERE p_size % 3 <> 0) p USING (question_id)
    LEFT JOIN (SELECT p_partkey AS question_id, p_brand AS truth FROM part WHERE p_size % 7 <> 0) t USING (question_id)
    LEFT JOIN (SELECT l_partkey AS question_id, avg(l_quantity / 50) AS avg_score,
                      min(CASE WHEN l_tax > 0.01 THEN lpad(CAST(l_orderkey * 1000 + l_linenumber AS VARCHAR), 12, '0') || l_returnflag END) AS details
               FROM fx_li GROUP BY 1) s USING (question_id)""")
def joi23(v):
    part = v.table("part")
    scores = v.lineitems.selectExpr(
        "l_partkey AS question_id", "l_orderkey * 1000 + l_linenumber AS validator_id", "l_quantity / 50 AS score",
        "CASE WHEN l_tax > 0.01 THEN concat(lpad(cast(l_orderkey * 1000 + l_linenumber AS string), 12, '0'), l_returnflag) END AS details")
    return rounded(qa.question_detail(
        part.selectExpr("p_partkey AS question_id", "p_name AS question"),
        part.where("p_size % 3 <> 0").selectExpr("p_partkey AS question_id", "p_type AS answer"),
        part.where("p_size % 7 <> 0").selectExpr("p_partkey AS question_id", "p_brand AS truth"), scores), "avg_score")


# the active competition by its latest end; the register lists each validator up to three times
@query("agg20_platform_summary", """
    WITH a AS (SELECT competition_id FROM fx_competitions WHERE is_active AND competition_id < 2 ORDER BY eval_ends_at DESC, competition_id DESC LIMIT 1)
    SELECT (SELECT count(*) FROM customer WHERE c_custkey % 2 IN (SELECT competition_id FROM a)) AS entrants,
           (SELECT count(*) FROM fx_links WHERE competition_id IN (SELECT competition_id FROM a)) AS challenges,
           (SELECT count(*) FROM fx_links WHERE is_active AND competition_id IN (SELECT competition_id FROM a)) AS active_challenges,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 0) AS validators,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey IN (SELECT ps FROM (
              SELECT l_suppkey AS ps FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45))) AS active_validators,
           b.is_active AS burn_active, b.burn_ratio
    FROM (SELECT is_active, greatest(0.0, least(1.0, burn_ratio)) AS burn_ratio FROM fx_burns
          ORDER BY created_at DESC, request_id DESC LIMIT 1) b""")
def agg20(v):
    active = v.competitions.where("is_active AND competition_id < 2").orderBy(F.col("eval_ends_at").desc(), F.col("competition_id").desc()).limit(1)
    validators = v.table("supplier").selectExpr("s_suppkey AS validator_id", "s_suppkey % 10 = 0 AS is_archive")
    register = v.table("lineitem").selectExpr("l_suppkey AS validator_id", "l_returnflag = 'R' AND l_quantity > 45 AS is_active")
    entrants = v.table("customer").selectExpr("c_custkey AS entrant_id", "c_custkey % 2 AS competition_id")
    return qa.platform_summary(active, entrants, v.links, validators, register, v.burns)


@query("agg35_multi_level_score", f"""
    SELECT batch_id, round(sum(score / sqrt(compression_ratio)) / sum(CASE WHEN score IS NOT NULL THEN 1 / sqrt(compression_ratio) END), 8) AS score
    FROM ({ITEM_SCORE_SQL}) GROUP BY batch_id""")
def agg35(v):
    return rounded(qa.multi_level_score(qa.item_scores(v.items, v.item_scores), ["batch_id"]), "score", digits=8)


@query("agg36_token_f1", r"""
    WITH n AS (SELECT count(*) AS n FROM benchmark),
    d AS (SELECT doc_id AS q, doc_id % n AS item, regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1) AS w FROM documents, n),
    b AS (SELECT item_id AS item, regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1) AS w FROM benchmark),
    bw AS (SELECT item, word, count(*) AS t FROM (SELECT item, unnest(w) AS word FROM b) GROUP BY ALL),
    dw AS (SELECT q, item, word, count(*) AS a FROM (SELECT q, item, unnest(w) AS word FROM d) GROUP BY ALL),
    o AS (SELECT q, CAST(sum(least(a, t)) AS BIGINT) AS overlap FROM dw JOIN bw USING (item, word) GROUP BY q)
    SELECT d.q AS question_id, coalesce(o.overlap, 0) AS overlap,
           round(CASE WHEN len(d.w) + len(b.w) > 0 THEN 2.0 * coalesce(o.overlap, 0) / (len(d.w) + len(b.w)) ELSE 0.0 END, 6) AS f1
    FROM d JOIN b ON b.item = d.item LEFT JOIN o ON o.q = d.q""")
def agg36(v):
    bench = v.table("benchmark")
    n = bench.agg(F.count(F.lit(1)).alias("n_items"))
    pairs = (v.documents.select("doc_id", "text").crossJoin(F.broadcast(n))
             .withColumn("item_id", F.col("doc_id") % F.col("n_items"))
             .join(bench.select("item_id", F.col("text").alias("truth")), "item_id")
             .select(F.col("doc_id").alias("question_id"), F.col("text").alias("answer"), "truth"))
    return rounded(qa.token_f1(pairs), "f1")


@query("agg37_rollup_items", """
    SELECT l_orderkey AS item_id, l_suppkey % 5 AS validator_id, round(avg(l_quantity / 50), 6) AS score, count(*) AS n_questions
    FROM fx_li GROUP BY ALL""")
def agg37(v):
    q = v.lineitems.selectExpr("l_orderkey AS item_id", "l_suppkey % 5 AS validator_id", "l_quantity / 50 AS score")
    return rounded(qa.rollup_items(q), "score")


@query("prj15_accept_compression", """
    SELECT doc_id, length(trim(regexp_replace(out, '\\s+', ' ', 'g'))) > 0
           AND NOT coalesce((CASE WHEN n_out > 0 THEN length(out) / n_out ELSE 0 END) / nullif(length(text) / nullif(n_in, 0), 0) > 1.8, FALSE)
           AND n_in > 0 AND n_out / nullif(n_in, 0) <= 0.5 AS accepted
    FROM (SELECT doc_id, text, out, len(string_split(text, ' ')) AS n_in, len(string_split(out, ' ')) AS n_out
          FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN replace(substr(text, 1, length(text) // 2), ' ', '')
                       WHEN 2 THEN substr(text, 1, length(text) // 3) ELSE text END AS out FROM documents))""")
def prj15(v):
    out = F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN replace(substr(text, 1, cast(floor(length(text) / 2) AS int)), ' ', '') "
                 "WHEN 2 THEN substr(text, 1, cast(floor(length(text) / 3) AS int)) ELSE text END")
    docs = v.documents.select("doc_id", "text", out.alias("out"))
    return docs.select("doc_id", gates.accept_compression(
        F.col("text"), F.col("out"), F.lit(0.5), F.size(F.split("text", " ", -1)).cast("long"),
        F.size(F.split("out", " ", -1)).cast("long")).alias("accepted"))


# Scores of one order as JSON text; entries with a missing or unreadable part are dropped.
PARTIAL_SQL = """
    SELECT l_orderkey, '[' || string_agg('{"compression_ratio": ' || CASE WHEN l_tax = 0 THEN 'null' ELSE CAST(l_tax AS VARCHAR) END
             || ', "score": ' || CASE WHEN l_discount = 0 THEN '"x"' ELSE CAST(l_discount AS VARCHAR) END || '}', ', '
             ORDER BY l_linenumber) || ']' AS raw
    FROM fx_li GROUP BY l_orderkey"""


@query("prj16_normalize_partials", """
    SELECT l_orderkey, string_agg(CAST(l_tax AS VARCHAR) || ':' || CAST(l_discount AS VARCHAR), ',' ORDER BY l_tax, l_discount)
           FILTER (WHERE l_tax <> 0 AND l_discount <> 0) AS partials
    FROM fx_li GROUP BY l_orderkey""")
def prj16(v):
    entry = F.concat(
        F.lit('{"compression_ratio": '), F.when(F.col("l_tax") == 0, "null").otherwise(F.col("l_tax").cast("string")),
        F.lit(', "score": '), F.when(F.col("l_discount") == 0, '"x"').otherwise(F.col("l_discount").cast("string")), F.lit("}"))
    raw = v.lineitems.groupBy("l_orderkey").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(entry), ", "), F.lit("]")).alias("raw"))
    parts = gates.normalize_partials(F.col("raw"))
    shown = F.array_join(F.transform(parts, lambda p: F.concat_ws(
        ":", p["compression_ratio"].cast("string"), p["score"].cast("string"))), ",")
    return raw.select("l_orderkey", shown.alias("partials"))


FAIL_TEXT_SQL = """
    SELECT event_id, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'cannot open /var/run/docker.sock' WHEN 2 THEN 'GatewayTransportError code 1006'
             WHEN 3 THEN 'GatewayTransportError: reset' WHEN 4 THEN 'request timed out' WHEN 5 THEN 'No tasks available' ELSE 'boom ' || k END AS error
    FROM fx_pairs_trace"""


def fail_texts(v):
    return v.trace_pairs.selectExpr(
        "event_id",
        "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'cannot open /var/run/docker.sock' WHEN 2 THEN 'GatewayTransportError code 1006' "
        "WHEN 3 THEN 'GatewayTransportError: reset' WHEN 4 THEN 'request timed out' WHEN 5 THEN 'No tasks available' ELSE concat('boom ', k) END AS error")


@query("prj17_classify_failure", f"""
    SELECT event_id, CASE WHEN error IS NULL THEN 'unknown_failure' WHEN contains(lower(error), 'docker.sock') THEN 'docker_sock_missing'
             WHEN contains(lower(error), 'gatewaytransporterror') AND contains(error, '1006') THEN 'gateway_ws_1006'
             WHEN contains(lower(error), 'gatewaytransporterror') THEN 'gateway_transport_error'
             WHEN contains(lower(error), 'timed out') THEN 'timeout' ELSE 'runtime_error' END AS failure,
           CASE WHEN contains(lower(coalesce(error, '')), 'no tasks available') THEN 'no_tasks' ELSE 'service_unavailable' END AS cause
    FROM ({FAIL_TEXT_SQL})""")
def prj17(v):
    return fail_texts(v).select("event_id", gates.classify_failure(F.col("error")).alias("failure"),
                                gates.classify_unavailable(F.col("error")).alias("cause"))


DIFF_SQL = """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'diff --git a/x b/x' || chr(10) || text
             WHEN 2 THEN '--- a/x' || chr(10) || '+++ b/x' || chr(10) || text WHEN 3 THEN '--- a/x' || chr(10) || text ELSE '' END AS patch
    FROM documents"""


@query("prj18_is_unified_diff", f"""
    SELECT doc_id, regexp_matches(patch, '(?m)^\\s*diff --git ') OR (regexp_matches(patch, '(?m)^\\s*--- ')
           AND regexp_matches(patch, '(?m)^\\s*\\+\\+\\+ ')) AS is_diff FROM ({DIFF_SQL})""")
def prj18(v):
    patch = F.expr(r"""CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat('diff --git a/x b/x\n', text)
        WHEN 2 THEN concat('--- a/x\n+++ b/x\n', text) WHEN 3 THEN concat('--- a/x\n', text) ELSE '' END""")
    return v.documents.select("doc_id", gates.is_unified_diff(patch).alias("is_diff"))


@query("prj19_extract_test_log", """
    SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN trim(text, ' ' || chr(10)) ELSE trim(CASE doc_id % 4 WHEN 0 THEN
             '============================= test session starts ==============================' || chr(10) || text
             ELSE text END, ' ' || chr(10)) END AS log
    FROM documents WHERE doc_id % 4 <> 2
    UNION ALL
    SELECT doc_id, '============================= test session starts ==============================' || chr(10) || trim(text, ' ' || chr(10))
    FROM documents WHERE doc_id % 4 = 2""")
def prj19(v):
    raw = F.expr(rf"""CASE doc_id % 4
        WHEN 0 THEN concat('boot\n{gates.TEST_OUTPUT_START}\nsetup\n{gates.TEST_SESSION_BANNER}\n', text, '\n{gates.TEST_OUTPUT_END}\nbye')
        WHEN 1 THEN concat('boot\n{gates.TEST_OUTPUT_START}\n', text, '\n')
        WHEN 2 THEN concat('no markers\n{gates.TEST_SESSION_BANNER}\n', text)
        ELSE concat('  ', text) END""")
    return v.documents.select("doc_id", gates.extract_test_log(raw).alias("log"))
