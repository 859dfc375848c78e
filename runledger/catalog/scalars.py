"""Scalar families: text shape, roles, sizes, hashes, flags, paths, time, thresholds, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.functions import text as T
from runledger.operators.nested import nested_text
from runledger.functions import values as V
from runledger.functions.scoring import close_to
from runledger.operators.screening import required_passes


@query("fns1_string_shape", r"""
    SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed,
           CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END AS clipped,
           CASE WHEN length(text) <= 380 THEN text ELSE substr(text, 1, 200) || chr(10) || '… [' || (length(text) - 300)
                || ' chars trimmed] …' || chr(10) || right(text, 100) END AS head_tail,
           replace(replace(source || '/' || lang, '/', '-'), ' ', '-') AS file_key
    FROM documents""")
def fns1(v):
    t = F.col("text")
    return v.documents.select(
        "doc_id", T.collapse_whitespace(t).alias("collapsed"), T.clip(t, 60).alias("clipped"),
        T.head_tail(t, 200, 100).alias("head_tail"), T.file_safe(F.concat_ws("/", "source", "lang")).alias("file_key"))


@query("fns2_roles_and_text", """
    SELECT conv_id, turn, lower(role) AS role, text || chr(10) || role AS flat FROM conversations WHERE text <> ''""")
def fns2(v):
    decorated = F.concat(F.lit("  "), F.upper(F.substring("role", 1, 2)), F.lit("_"), F.substring("role", 3, 20), F.lit("- "))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
                     F.struct(F.lit("tool").alias("type"), F.lit(None).cast("string").alias("text")),
                     F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))
    return v.table("conversations").where("text <> ''").select(
        "conv_id", "turn", T.normalize_role(decorated).alias("role"), T.flatten_blocks(blocks).alias("flat"))


@query("fns3_token_estimate", """
    SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens FROM documents""")
def fns3(v):
    return v.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("fns4_normal_form", """
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), '[^a-z]+', ' ', 'g'))) AS form FROM documents""")
def fns4(v):
    return v.documents.select("doc_id", F.md5(T.normal_form(F.col("text"))).alias("form"))


@query("fns5_fingerprints", """
    SELECT event_id, sha256(event_type || props) AS fp, '{"a":"' || event_type || '","k":' || regexp_extract(props, '(\\d+)', 1) || '}' AS canonical
    FROM events""")
def fns5(v):
    unordered = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "a": "'), F.col("event_type"), F.lit('"}'))
    return v.table("events").select(
        "event_id", T.fingerprint(F.concat("event_type", "props")).alias("fp"), T.canonical_json(unordered).alias("canonical"))


# three levels, keys in no order
NESTED = """concat('{"z": [', event_id, ', {"y": "', event_type, '", "b": {"d": null, "c": [true, {"text": "t', user_id, '", "x": 1}]}}], "m": ', props, ', "a": "s"}')"""


@query("fns5_nested_json", """
    SELECT event_id, '{"a":"s","m":{"k":' || regexp_extract(props, '(\\d+)', 1) || '},"z":[' || event_id || ',{"b":{"c":[true,{"text":"t' || user_id
           || '","x":1}],"d":null},"y":"' || event_type || '"}]}' AS canonical FROM events""")
def fns5b(v):
    return v.table("events").select("event_id", T.canonical_json(F.expr(NESTED)).alias("canonical"))


@query("fns2_nested_text", """
    SELECT event_id, concat_ws(chr(10), 's', regexp_extract(props, '(\\d+)', 1), event_id, 'True', 't' || user_id, '', event_type) AS text FROM events""")
def fns2b(v):
    return nested_text(v.table("events").select("event_id", F.expr(NESTED).alias("j")), ["event_id"], "j")


@query("fns6_flags", r"""
    SELECT session_id, msg_idx, contains(lower(text), 'failed') OR contains(lower(text), 'assertionerror') AS has_error,
           regexp_matches(text, '\b[1-9]\d*\s+failed\b|\bFAILED\b|\bAssertionError\b') AS failing,
           regexp_matches(text, '\b[1-9]\d* passed\b') AS passing
    FROM fx_trace""")
def fns6(v):
    t = F.col("text")
    return v.trace.select("session_id", "msg_idx", T.has_error(t).alias("has_error"), T.has_failing_test(t).alias("failing"),
                          T.has_passing_test(t).alias("passing"))


@query("fns7_paths", r"""
    SELECT session_id, msg_idx, regexp_extract(text, '(app/mod\d\.py)', 1) AS path, CASE WHEN contains(text, 'app/mod') THEN regexp_extract(text, '(app/mod\d\.py)', 1) || ',' || regexp_extract(text, 'app/(mod\d\.py)', 1) ELSE '' END AS base
    FROM fx_trace""")
def fns7(v):
    t = F.col("text")
    return v.trace.select("session_id", "msg_idx", F.array_join(T.paths(t), ",").alias("path"),
                          F.array_join(T.path_names(t), ",").alias("base"))


@query("fns8_time", """
    SELECT event_id, date_trunc('day', ts) AS day, date_trunc('minute', ts) AS minute,
           greatest(1, 86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400) AS to_next_day,
           greatest(1, 60 - CAST(floor(epoch(ts)) AS BIGINT) % 60) AS to_next_minute
    FROM events""")
def fns8(v):
    ts = V.to_utc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return v.table("events").select(
        "event_id", V.day_bucket(ts).alias("day"), V.minute_bucket(ts).alias("minute"),
        V.seconds_to_next_day(ts).alias("to_next_day"), V.seconds_to_next_minute(ts).alias("to_next_minute"))


@query("fns9_math", """
    SELECT event_id, round(ln(value + 1), 6) AS ln_value, round(greatest(-2.0, least(2.0, value - 10)), 6) + 0.0 AS clamped,
           CAST(ceil(value) AS BIGINT) AS up, abs(value - 10) <= 0.5 * greatest(1.0, greatest(abs(value), 10)) AS near_ten
    FROM events""")
def fns9(v):
    x = F.col("value")
    return rounded(v.table("events").select(
        "event_id", F.ln(x + 1).alias("ln_value"), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x - 10)).alias("clamped"),
        F.ceil(x).alias("up"), close_to(x, F.lit(10.0), 0.5).alias("near_ten")), "ln_value", "clamped")


@query("fns10_required_passes", """
    SELECT p_partkey, CAST(CASE WHEN n <= 0 THEN 0 ELSE least(n, greatest(1, ceil(n * 0.6), 3)) END AS INTEGER) AS needed
    FROM (SELECT p_partkey, p_size % 12 AS n FROM part)""")
def fns10(v):
    return v.table("part").select("p_partkey", required_passes(F.col("p_size") % 12, 0.6, 3).alias("needed"))


@query("fns11_backoff", """
    SELECT p_partkey, CAST(least(300.0, 2.0 * pow(2.0, greatest(0, n - 1))) AS DOUBLE) AS capped,
           CAST(CASE WHEN n = 0 THEN 5.0 ELSE least(100.0, CASE WHEN n <= 3 THEN 5.0 * pow(2.0, n) ELSE 40.0 + (n - 3) * 5.0 END) END AS DOUBLE) AS hybrid
    FROM (SELECT p_partkey, p_size % 20 AS n FROM part)""")
def fns11(v):
    n = F.col("p_size") % 20
    return v.table("part").select("p_partkey", V.capped_backoff(n, 2.0, 300.0).alias("capped"),
                                  V.hybrid_backoff(n, 5.0, 2.0, 100.0).alias("hybrid"))


@query("fns12_coercion", """
    SELECT event_id, k % 5 IN (1, 2) AS flag, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN NULL ELSE k END AS whole_number
    FROM fx_pairs_trace""")
def fns12(v):
    word = F.expr("CASE k % 5 WHEN 0 THEN 'no' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'Yes' WHEN 3 THEN '0' ELSE 'maybe' END")
    number = F.expr("CASE k % 3 WHEN 0 THEN cast(k AS string) WHEN 1 THEN concat(k, '.5') ELSE concat(k, '.0') END")
    return v.trace_pairs.select("event_id", V.truthy(word).alias("flag"), V.integral(number).alias("whole_number"))


@query("fns13_nested", """
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS ordered,
           count(*) AS n, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END), 0) AS urgent
    FROM orders GROUP BY o_custkey""")
def fns13(v):
    grouped = v.table("orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("list"),
        F.collect_set("o_orderpriority").alias("kinds"))
    as_map = F.map_from_arrays(F.col("kinds"), F.transform("kinds", lambda k: F.lit(1)))
    return grouped.select(
        "o_custkey", F.array_join(F.transform("list", lambda x: x["o_orderkey"].cast("string")), ",").alias("ordered"),
        F.json_array_length(F.to_json("list")).cast("long").alias("n"),
        F.coalesce(F.try_element_at(as_map, F.lit("1-URGENT")), F.lit(0)).alias("urgent"))
