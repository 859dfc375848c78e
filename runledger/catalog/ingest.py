"""Ingest queries. File scans first write the derived snapshots with Spark, then read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import query, rounded
from runledger.operators import dedup
from runledger.session import scratch_path
from runledger.sources import pages as P
from runledger.sources import sinks, snapshots

# One snapshot per ship day bucket; entrants are parts, their numbers come from the line items.
SNAP_SQL = """
    SELECT CAST(l_shipdate AS DATE)::VARCHAR AS observed_at, 'K' || l_partkey AS hotkey,
           CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 1000 END AS overall, l_quantity AS easy, l_discount AS medium, l_tax AS hard,
           l_returnflag AS review_status, l_orderkey * 1000 + l_linenumber AS ident
    FROM fx_li"""


def snap_rows(v):
    return v.lineitems.selectExpr(
        "date_format(l_shipdate, 'yyyy-MM-dd') AS observed_at", "concat('K', l_partkey) AS hotkey",
        "CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 1000 END AS overall", "l_quantity AS easy", "l_discount AS medium",
        "l_tax AS hard", "l_returnflag AS review_status", "l_orderkey * 1000 + l_linenumber AS ident")


def board_files(v):
    """One JSON document per snapshot part, written by Spark. Documents stay small: large days are split by id range."""
    path = scratch_path(v.spark, "boards")
    docs = snap_rows(v).groupBy("observed_at", F.floor(F.col("ident") / 50_000).alias("part")).agg(F.array_sort(F.collect_list(F.struct(
        "ident", "hotkey", F.col("overall").alias("total"), "easy", "medium", "hard", "review_status"))).alias("miners"))
    docs.select("observed_at", "miners").write.json(path)
    return path


@query("src1_scan_leaderboards", f"""
    SELECT observed_at, hotkey, overall, easy, medium, hard, review_status FROM ({SNAP_SQL})""")
def src1(v):
    return snapshots.scan_leaderboards(v.spark, board_files(v), lines=True).select(
        "observed_at", "hotkey", "overall", "easy", "medium", "hard", "review_status")


@query("win3_snapshot_rank", f"""
    SELECT observed_at, ident, CASE WHEN overall IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY observed_at ORDER BY overall DESC NULLS LAST, ident)
           AS INTEGER) END AS rank FROM ({SNAP_SQL})""")
def win3(v):
    return dedup.snapshot_rank(snap_rows(v).withColumn("pos", F.col("ident"))).select("observed_at", "ident", "rank")


@query("ded3_latest_snapshot", f"""
    SELECT hotkey, ident FROM ({SNAP_SQL}) WHERE observed_at = (SELECT max(observed_at) FROM ({SNAP_SQL}))""")
def ded3(v):
    return dedup.latest_snapshot(snap_rows(v)).select("hotkey", "ident")


DETAIL_SQL = """
    SELECT CAST(o_orderdate AS DATE)::VARCHAR AS observed_at, 'C' || o_custkey AS hotkey, l_partkey % 100 AS task_id, l_linenumber AS attempt_no,
           l_orderkey * 1000 + l_linenumber AS run_id, l_returnflag = 'A' AS baseline_pass, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus = 'F' END AS miner_pass,
           l_extendedprice AS baseline_tokens, l_quantity * 1000 AS miner_tokens, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount - 0.05 END AS score,
           l_orderkey
    FROM fx_li JOIN orders ON o_orderkey = l_orderkey"""


# Range of order keys whose documents of one month go into one file (some 100,000 of them).
FILE_KEYS = 8_000_000


def detail_files(v, keep: str = "true", single: bool = False):
    """Detail documents, one per order: entrant, tasks, runs. ``single`` writes the one-entrant shape.

    Lines move once, by order: numbering, join and documents share that layout. The JSON names every field of every
    line, so it is written compressed.
    """
    path = scratch_path(v.spark, "details")
    rows = v.lineitems_by_order.join(v.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).where(keep)
    run = F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("run_id"), F.col("l_linenumber").alias("attempt_no"),
                   F.when(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F").alias("pass_with_compression"),
                   (F.col("l_quantity") * 1000).alias("tokens_with_compression"),
                   F.when(F.col("l_tax") != 0, F.col("l_discount") - 0.05).alias("platform_score"))
    task = F.struct(
        "l_linenumber", (F.col("l_partkey") % 100).alias("task_id"), F.lit(None).cast("string").alias("task_name"),
        F.lit(False).alias("is_screener"), (F.col("l_returnflag") == "A").alias("pass_without_compression"),
        run["pass_with_compression"].alias("pass_with_compression"), F.col("l_extendedprice").alias("tokens_without_compression"),
        run["tokens_with_compression"].alias("tokens_with_compression"), run["platform_score"].alias("platform_score"),
        F.array(run).alias("runs"))
    docs = rows.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"),
                        F.concat(F.lit("C"), "o_custkey").alias("hotkey"), "l_orderkey").agg(
        F.array_sort(F.collect_list(task)).alias("tasks"))
    if single:
        # a month is cut by ranges of orders, so that neither a task nor a file grows with the table
        part = F.floor(F.col("l_orderkey") / FILE_KEYS)
        docs.select("hotkey", "tasks", F.substring("observed_at", 1, 7).alias("day"), part.alias("part")).repartition("day", "part").drop(
            "part").write.partitionBy("day").option("compression", "gzip").json(path)
    else:
        docs.select("observed_at", F.array(F.struct("hotkey", "tasks")).alias("miners")).write.option("compression", "gzip").json(path)
    return path


TASK_OUT = """observed_at, hotkey, task_id, baseline_pass, miner_pass, baseline_tokens, miner_tokens, round(score, 6) AS score,
    CASE WHEN baseline_tokens <> 0 AND miner_tokens <> 0 THEN floor(baseline_tokens * 10000 / miner_tokens + 0.5) / 10000 END AS compression_ratio,
    baseline_pass AND NOT coalesce(miner_pass, FALSE) AS broke_baseline, coalesce(score < 0, FALSE) AS negative_score"""
TASK_COLS = ["observed_at", "hotkey", "task_id", "baseline_pass", "miner_pass", "baseline_tokens", "miner_tokens", "score",
             "compression_ratio", "broke_baseline", "negative_score"]


@query("src2_scan_task_details", f"SELECT {TASK_OUT} FROM ({DETAIL_SQL})")
def src2(v):
    paths = [detail_files(v, "l_orderkey % 2 = 0"), detail_files(v, "l_orderkey % 2 = 1")]
    return rounded(snapshots.scan_task_details(v.spark, paths, lines=True).select(*TASK_COLS), "score")


@query("snk4_export_task_scores", f"SELECT {TASK_OUT} FROM ({DETAIL_SQL})")
def snk4(v):
    details = snapshots.scan_task_details(v.spark, [detail_files(v, "true")], lines=True)
    path = scratch_path(v.spark, "export")
    flat = sinks.export_task_scores(details, path, "gzip")
    back = v.spark.read.schema(flat.schema).option("header", True).csv(path)
    return rounded(back.select(*TASK_COLS), "score")


@query("src3_scan_run_snapshots", f"""
    SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'day=' || substr(observed_at, 1, 7) ELSE observed_at END AS observed_at, hotkey, task_id, attempt_no, run_id,
           miner_pass AS run_pass, miner_tokens AS run_tokens, round(score, 6) AS run_score FROM ({DETAIL_SQL})""")
def src3(v):
    both = [detail_files(v, "l_orderkey % 3 = 0", single=True), detail_files(v, "l_orderkey % 3 <> 0")]
    return rounded(snapshots.scan_run_snapshots(v.spark, both, lines=True).select(
        "observed_at", "hotkey", "task_id", "attempt_no", "run_id", "run_pass", "run_tokens", "run_score"), "run_score")


@query("ded1_newest", f"""
    SELECT hotkey, task_id, observed_at, run_id FROM (SELECT *, row_number() OVER (PARTITION BY hotkey, task_id
      ORDER BY observed_at DESC, run_id) AS rn FROM ({DETAIL_SQL})) WHERE rn = 1""")
def ded1(v):
    rows = v.lineitems.join(v.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "concat('C', o_custkey) AS hotkey", "l_partkey % 100 AS task_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS observed_at",
        "l_orderkey * 1000 + l_linenumber AS run_id")
    return dedup.newest(rows, ["hotkey", "task_id"], "observed_at", ["run_id"])


@query("ded2_prefer_scored", f"""
    SELECT hotkey, ident, overall FROM (SELECT *, row_number() OVER (PARTITION BY hotkey ORDER BY overall IS NOT NULL DESC, ident) AS rn
      FROM ({SNAP_SQL})) WHERE rn = 1""")
def ded2(v):
    return dedup.prefer_scored(snap_rows(v), "hotkey", "overall", "ident").select("hotkey", "ident", "overall")


@query("src4_scan_results", """
    SELECT 'bench-' || p_partkey AS task, p_size % 3 = 0 AS pass, CASE WHEN p_size % 4 = 0 THEN 5 ELSE p_size END AS n_runs,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10.0::DOUBLE END AS ratio, p_retailprice AS score, p_size % 7 = 0 AS broke,
           nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, '') AS category, 'manual' AS source FROM part""")
def src4(v):
    path = scratch_path(v.spark, "results")
    v.table("part").selectExpr(
        "concat('bench-', p_partkey) AS task_name", "CASE WHEN p_size % 3 = 0 THEN ' Yes ' ELSE 'no' END AS pass",
        "CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(p_size, '.0') END AS n_runs",
        "CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE cast(p_size / 10.0D AS string) END AS compression_ratio",
        "cast(p_retailprice AS string) AS score", "CASE WHEN p_size % 7 = 0 THEN 'TRUE' ELSE '0' END AS broke",
        "CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END AS category").write.option("header", True).csv(path)
    return snapshots.scan_results(v.spark, path).select("task", "pass", "n_runs", "ratio", "score", "broke", "category", "source")


CATEGORY_SQL = """SELECT p_partkey AS task_id, p_name AS task_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS category FROM part"""


def category_file(v):
    path = scratch_path(v.spark, "categories")
    v.table("part").selectExpr("p_partkey AS task_id", "p_name AS task_name",
                               "CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_type END AS category").write.option("header", True).csv(path)
    return path


@query("src5_scan_categories", CATEGORY_SQL)
def src5(v):
    return snapshots.scan_categories(v.spark, category_file(v))


REGISTRY_SQL = """SELECT 'm' || s_suppkey AS label, 'hk' || s_suppkey AS hotkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS version,
    CAST(s_suppkey % 3 = 0 AS BOOLEAN) AS active, s_acctbal AS total FROM supplier"""


@query("src6_scan_registry", REGISTRY_SQL)
def src6(v):
    line = F.expr("""concat('  m', s_suppkey, ': {hotkey: "hk', s_suppkey, '", version: ', CASE WHEN s_suppkey % 5 = 0 THEN 'null' ELSE concat('"', s_name, '"') END,
        ', active: ', s_suppkey % 3 = 0, ', total: ', s_acctbal, '}')""")
    reg = snapshots.parse_registry(v.table("supplier").select(line.alias("value")), ["hotkey", "version", "active", "total"])
    return reg.select("label", "hotkey", "version", F.col("active").try_cast("boolean").alias("active"),
                      F.col("total").try_cast("double").alias("total"))


@query("src7_extract_page_records", """
    SELECT key, min(first_pos) AS first_pos FROM (
      SELECT p.page_id, pos, regexp_extract(pieces[pos + 1], '^(/[^"]+)', 1) AS key, p.page_id * 100000 + pos - 1 AS first_pos
      FROM (SELECT page_id, string_split(replace(html, '\\"', '"'), 'href="') AS pieces FROM pages) p,
           LATERAL (SELECT unnest(generate_series(1, len(p.pieces) - 1)) AS pos)) WHERE key <> '' GROUP BY key""")
def src7(v):
    records = P.extract_page_records(v.table("pages"), 'href="', r"/[^\"]+", {"label": r'^[^"]*">([^<]*)<'})
    seen = records.withColumn("first_pos", F.col("page_id") * 100000 + F.col("pos"))
    return dedup.prefer_scored(seen.withColumn("score", F.lit(None).cast("double")), "key", "score", "first_pos").select("key", "first_pos")


@query("src8_extract_json_blocks", """
    SELECT page_id, n, url FROM (SELECT page_id, CAST(unnest([0, 1]) AS INTEGER) AS n, url FROM pages)""")
def src8(v):
    # pages carry the record twice, once with a brace inside a string
    body = F.concat("html", F.lit('"record":'), F.to_json(F.struct("url", F.lit("a } { b").alias("note"), F.array(F.lit(1)).alias("xs"))),
                    F.lit(' tail "record":'), F.to_json(F.struct("url")), F.lit('} "record": 5'))
    blocks = P.extract_json_blocks(v.table("pages").select("page_id", body.alias("html")), ["record"])
    return blocks.select("page_id", F.col("block_no").alias("n"), F.from_json("block", "url string")["url"].alias("url"))


@query("src8_join_stream_chunks", "SELECT page_id, md5(html) AS h FROM pages")
def src8b(v):
    parts = v.table("pages").select("page_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("chunk_no"), F.substring("html", i * 500 + 1, 500 if i < 3 else 100_000_000).alias("chunk"))
        for i in range(4)])).alias("c")).select("page_id", "c.*")
    return P.join_stream_chunks(parts).select("page_id", F.md5("html").alias("h"))


@query("src9_scan_paste", """
    SELECT 'Kx' || translate(CAST(c_custkey AS VARCHAR), '0', '9') || 'abcdef' AS hotkey, c_acctbal AS total, 1.5::DOUBLE AS easy,
           CAST(c_custkey % 9 AS DOUBLE) AS medium, 2.0::DOUBLE AS hard, CASE WHEN c_custkey % 2 = 0 THEN 'ok' ELSE 'scored' END AS review_status
    FROM customer WHERE c_custkey % 10 <> 7""")
def src9(v):
    path = scratch_path(v.spark, "paste")
    v.table("customer").select(F.expr(
        "concat_ws(CASE WHEN c_custkey % 3 = 0 THEN '\\t' ELSE ', ' END, concat('Kx', translate(c_custkey, '0', '9'), 'abcdef'), "
        "c_acctbal, '1.5', CASE WHEN c_custkey % 10 = 7 THEN 'oops' ELSE '2.0' END, c_custkey % 9, "
        "CASE WHEN c_custkey % 2 = 0 THEN 'ok' END)").alias("value")).write.text(path)
    return snapshots.scan_paste(v.spark, path)


@query("src10_parse_transcripts", r"""
    SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS msg_idx, CAST(b AS INTEGER) AS block_idx,
           CASE role WHEN 'system' THEN 'toolresult' ELSE role END AS role,
           CASE WHEN role = 'assistant' AND b = 0 THEN 'thinking' WHEN role = 'assistant' AND b = 1 THEN 'toolcall' ELSE 'text' END AS block_type,
           CASE WHEN role = 'assistant' AND b = 0 THEN 'hm' WHEN role = 'assistant' AND b = 1 THEN 'x=' || turn ELSE trim(text, ' ' || chr(10)) END AS text,
           CASE WHEN role = 'system' OR (role = 'assistant' AND b = 1) THEN 'c' || turn END AS call_id
    FROM (SELECT c.*, b FROM conversations c, (SELECT unnest([0, 1, 2]) AS b) WHERE role = 'assistant' OR b = 0)""")
def src10(v):
    tagged = F.expr(r"""CASE role
        WHEN 'assistant' THEN concat('<message role="assistant"><thinking>hm</thinking>\n<tool_call name="run" id="c', turn, '">x=', turn,
                                     '</tool_call><text> ', text, '</text></message>')
        WHEN 'user' THEN concat('<message role="user"><text>', text, '\n</text></message>')
        ELSE concat('<tool_result tool="run" tool_call_id="c', turn, '">', text, '</tool_result>') END""")
    docs = v.table("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", tagged.alias("t")))), lambda m: m["t"]), "\n").alias("text"))
    return P.parse_transcripts(docs).drop("tool")


@query("src11_scan_trajectories", """
    SELECT CAST(conv_id AS VARCHAR) AS session, turn AS msg_idx, role, text FROM conversations WHERE conv_id % 9 <> 4""")
def src11(v):
    path = scratch_path(v.spark, "trajectories")
    v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(
        F.col("conv_id").cast("string").alias("session"), F.lit("2024-01-01").alias("ts"),
        F.when(F.col("conv_id") % 9 == 4, F.array().cast("array<struct<role:string,content:string>>")).otherwise(
            F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))).alias("trajectory")).write.json(path)
    return snapshots.scan_trajectories(v.spark, path).drop("ts")


REPORT_SQL = """
    SELECT l_orderkey * 1000 + l_linenumber AS run_id, CAST(l_quantity AS BIGINT) AS q, l_tax, l_discount, l_returnflag, l_orderkey FROM fx_li"""


def reports(v, keep: str = "true"):
    body = F.expr("""concat('{"ok_status": ', l_returnflag <> 'R', ', "patch_capture_status": true, "execution_time_seconds": ', l_tax,
        CASE WHEN l_discount < 0.03 THEN concat(', "total_tokens": ', cast(l_quantity AS bigint)) ELSE ', "total_tokens": -1' END,
        ', "metadata": {"token_usage": {"total_tokens": ', cast(l_quantity AS bigint) + 100, '}, "agent": {"steps": "', l_linenumber, '"}',
        CASE WHEN l_tax = 0 THEN ', "reason": "  out of budget "' ELSE '' END, '}}')""")
    return v.lineitems.where(keep).select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("run_id"), body.alias("report"))


@query("src12_extract_run_metrics", """
    SELECT l_orderkey * 1000 + l_linenumber AS run_id, CASE WHEN l_discount < 0.03 THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) + 100 END AS total_tokens,
           CAST(l_linenumber AS BIGINT) AS agent_steps FROM fx_li""")
def src12(v):
    return snapshots.extract_run_metrics(reports(v)).select("run_id", "total_tokens", "agent_steps")


@query("src13_ingest_reports", """
    SELECT r.run_id, CASE WHEN l.l_orderkey % 4 = 0 THEN r.tokens_used WHEN l_discount < 0.03 THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) + 100 END AS tokens_used,
           CASE WHEN l.l_orderkey % 4 = 0 THEN r.status WHEN l_returnflag <> 'R' THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN l.l_orderkey % 4 = 0 THEN NULL WHEN l_tax = 0 THEN 'out of budget' WHEN l_returnflag = 'R' THEN 'sandbox reported run as failed' END AS last_error
    FROM fx_runs r JOIN fx_li l ON l.l_orderkey * 1000 + l.l_linenumber = r.run_id""")
def src13(v):
    return snapshots.ingest_reports(v.runs, reports(v, "l_orderkey % 4 <> 0")).select("run_id", "tokens_used", "status", "last_error")


@query("snk1_write_snapshot", "SELECT CAST(year(o_orderdate) AS INTEGER) AS day, count(*) AS n FROM orders GROUP BY 1")
def snk1(v):
    path = scratch_path(v.spark, "snapshot")
    sinks.write_snapshot(v.table("orders").withColumn("day", F.year("o_orderdate")), path)
    return v.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("snk2_append_new", """
    SELECT o_custkey % 50 AS hotkey, CAST(o_orderdate AS DATE)::VARCHAR AS observed_at FROM orders GROUP BY ALL""")
def snk2(v):
    path = scratch_path(v.spark, "append")
    rows = v.table("orders").selectExpr("o_custkey % 50 AS hotkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS observed_at", "o_orderkey")
    keys = ["observed_at", "hotkey"]
    sinks.append_new(rows.where("o_orderkey % 2 = 0"), path, keys)
    sinks.append_new(rows, path, keys)
    sinks.append_new(rows, path, keys)
    return v.spark.read.parquet(path).select("hotkey", "observed_at")


@query("snk3_upsert", """
    SELECT coalesce(a.k, b.k) AS k, coalesce(b.score, a.score) AS score, coalesce(a.note, b.note) AS note
    FROM (SELECT o_orderkey AS k, o_totalprice AS score, o_orderstatus AS note FROM orders WHERE o_orderkey % 3 <> 0) a
    FULL JOIN (SELECT o_orderkey AS k, -o_totalprice AS score, 'new' AS note FROM orders WHERE o_orderkey % 2 = 0) b ON b.k = a.k""")
def snk3(v):
    o = v.table("orders")
    target = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_totalprice AS score", "o_orderstatus AS note")
    updates = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "-o_totalprice AS score", "'new' AS note")
    return sinks.upsert(target, updates, ["k"], ["score"])


@query("prj9_repair_names", """
    SELECT r.run_id, CASE WHEN r.run_id % 3 = 0 THEN p.p_name WHEN r.run_id % 3 = 1 THEN coalesce(p.p_name, 'Available after uploads close') ELSE 'kept' END AS task_name
    FROM fx_runs r LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0 AND p_partkey < 100) p ON p.p_partkey = r.task_id""")
def prj9(v):
    runs = v.runs.select("run_id", "task_id", F.expr(
        "CASE run_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Available after uploads close' ELSE 'kept' END").alias("task_name"))
    dim = v.table("part").where("p_partkey % 7 <> 0 AND p_partkey < 100").selectExpr("p_partkey AS task_id", "p_name AS task_name")
    return dedup.repair_names(runs, dim).select("run_id", "task_name")


@query("joi16_resolve_entrant", """
    SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'rich' || o_custkey WHEN o_custkey % 3 = 0 THEN 'plain' || o_custkey WHEN o_custkey % 2 = 0 THEN 'top' || o_custkey
           ELSE substr('hotkey-' || o_custkey, 1, 8) END AS entrant FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def joi16(v):
    known = v.table("customer").select("c_custkey")
    orders = v.table("orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", F.concat(F.lit("hotkey-"), "o_custkey").alias("hotkey"))
    reg = lambda n, word: known.where(f"c_custkey % {n} = 0").select(
        F.concat(F.lit("hotkey-"), "c_custkey").alias("hotkey"), F.concat(F.lit(word), "c_custkey").alias("label"))
    return dedup.resolve_entrant(orders, [reg(5, "rich"), reg(3, "plain"), reg(2, "top")]).select("o_orderkey", "entrant")
