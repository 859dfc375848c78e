"""Scans of snapshot, export, registry and report files.

All readers take an explicit schema (no inference pass over the data) and
keep unreadable records out through permissive parsing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.scoring import broke_baseline, compression_ratio, negative_score
from runledger.functions.values import TRUE_WORDS, integral, truthy, whole

BOARD = """observed_at string, miners array<struct<hotkey:string, total:double, easy:double, medium:double, hard:double,
    review_status:string, eval_status:string>>, _corrupt_record string"""
RUN = "struct<run_id:bigint, attempt_no:int, pass_with_compression:boolean, tokens_with_compression:double, platform_score:double, time_taken_seconds:double, agent_steps:int>"
TASK = f"""struct<task_id:bigint, task_name:string, is_screener:boolean, pass_without_compression:boolean, pass_with_compression:boolean,
    tokens_without_compression:double, tokens_with_compression:double, platform_score:double, runs:array<{RUN}>>"""
DETAIL = f"""observed_at string, miners array<struct<hotkey:string, tasks:array<{TASK}>>>, hotkey string, tasks array<{TASK}>, _corrupt_record string"""


def _json(spark: SparkSession, paths: str | Sequence[str], schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option(
        "recursiveFileLookup", True).json(paths).where("_corrupt_record IS NULL")


def scan_leaderboards(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per snapshot and entrant, with its position in the file."""
    snaps = _json(spark, path, BOARD, lines)
    return snaps.select("observed_at", F.posexplode("miners").alias("pos", "m")).select(
        "observed_at", "pos", "m.hotkey", F.col("m.total").alias("overall"), "m.easy", "m.medium", "m.hard",
        F.coalesce("m.review_status", F.lit("")).alias("review_status"), F.coalesce("m.eval_status", F.lit("")).alias("eval_status"))


def _entrants(snaps: DataFrame) -> DataFrame:
    """Both document shapes as rows (observed_at, file, entrant position, entrant)."""
    day = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    listed = F.coalesce(F.col("miners"), F.when(
        F.col("hotkey").isNotNull(), F.array(F.struct("hotkey", "tasks"))))
    return snaps.select(F.coalesce("observed_at", day).alias("observed_at"), F.col("_metadata.file_path").alias("file"),
                        F.posexplode(listed).alias("m_pos", "m")).where("m.hotkey IS NOT NULL AND m.hotkey <> ''")


def scan_task_details(spark: SparkSession, paths: Sequence[str], lines: bool = False) -> DataFrame:
    """Task rows of the detail snapshots of several path families."""
    families = [_json(spark, p, DETAIL, lines).select("*", "_metadata") for p in paths]
    snaps = families[0]
    for f in families[1:]:
        snaps = snaps.unionByName(f, allowMissingColumns=True)
    rows = _entrants(snaps).select("observed_at", "file", "m_pos", "m.hotkey", F.posexplode("m.tasks").alias("t_pos", "t"))
    t = lambda c: F.col(f"t.{c}")
    return rows.select(
        "observed_at", "file", "m_pos", "t_pos", "hotkey", t("task_id").alias("task_id"), t("task_name").alias("task_name"),
        t("is_screener").alias("is_screener"), t("pass_without_compression").alias("baseline_pass"),
        t("pass_with_compression").alias("miner_pass"), t("tokens_without_compression").alias("baseline_tokens"),
        t("tokens_with_compression").alias("miner_tokens"),
        compression_ratio(t("tokens_without_compression"), t("tokens_with_compression")).alias("compression_ratio"),
        t("platform_score").alias("score"),
        broke_baseline(t("pass_without_compression"), t("pass_with_compression")).alias("broke_baseline"),
        negative_score(t("platform_score")).alias("negative_score"), F.lit("platform").alias("source"))


def scan_run_snapshots(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run rows of both document shapes; the day folder stands in for a missing timestamp."""
    rows = _entrants(_json(spark, path, DETAIL, lines).select("*", "_metadata"))
    tasks = rows.select("observed_at", "file", "m_pos", "m.hotkey", F.posexplode("m.tasks").alias("t_pos", "t"))
    runs = tasks.select("observed_at", "file", "m_pos", "t_pos", "hotkey", F.col("t.task_id").alias("task_id"),
                        F.col("t.task_name").alias("task_name"), F.col("t.tokens_without_compression").alias("baseline_tokens"),
                        F.posexplode("t.runs").alias("r_pos", "r"))
    return runs.select(
        "observed_at", "file", "m_pos", "t_pos", "r_pos", "hotkey", "task_id", "task_name", "baseline_tokens", "r.attempt_no",
        "r.run_id", F.col("r.pass_with_compression").alias("run_pass"), F.col("r.tokens_with_compression").alias("run_tokens"),
        F.col("r.platform_score").alias("run_score"), "r.time_taken_seconds", "r.agent_steps", F.lit("platform").alias("source"))


RESULT_COLS = ("task", "task_name", "task_id", "pass", "miner_pass", "n_runs", "neg_runs", "ratio", "compression_ratio", "score",
               "platform_score", "broke_baseline", "broke", "pairing_error", "missing_patch", "category", "source")


def scan_results(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Result export as CSV with header, JSON array, or JSON document with ``rows``; alias columns merged, text coerced."""
    cols = ", ".join(f"{c} string" for c in RESULT_COLS)
    if fmt == "csv":
        # columns are matched by header name; absent ones come back as null
        raw = spark.read.option("header", True).csv(path)
        raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLS])
    else:
        docs = spark.read.schema(f"{cols}, rows array<struct<{', '.join(f'{c}:string' for c in RESULT_COLS)}>>").option(
            "multiLine", True).json(path)
        flat = F.coalesce("rows", F.array(F.struct(*[F.col(c) for c in RESULT_COLS])))
        raw = docs.select(F.inline(flat))
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])
    flag = lambda *names: F.coalesce(truthy(first(*names)), F.lit(False))
    return raw.select(
        first("task", "task_name", "task_id").alias("task"), flag("pass", "miner_pass").alias("pass"),
        F.coalesce(whole(first("n_runs")), F.lit(5).cast("long")).alias("n_runs"),
        F.coalesce(whole(first("neg_runs")), F.lit(0).cast("long")).alias("neg_runs"),
        first("ratio", "compression_ratio").try_cast("double").alias("ratio"),
        first("score", "platform_score").try_cast("double").alias("score"), flag("broke_baseline", "broke").alias("broke"),
        flag("pairing_error").alias("pairing_error"), flag("missing_patch").alias("missing_patch"),
        first("category").alias("category"), F.coalesce(first("source"), F.lit("manual")).alias("source"))


def scan_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category dimension; a blank class is unknown."""
    raw = spark.read.schema("task_id string, task_name string, category string").option("header", True).csv(path)
    return raw.where("task_id IS NOT NULL").select(
        F.col("task_id").try_cast("bigint").alias("task_id"), F.nullif(F.trim("task_name"), F.lit("")).alias("task_name"),
        F.nullif(F.trim("category"), F.lit("")).alias("category"))


def parse_registry(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Indented one-line records ``key: {name: value, ...}``; quotes removed, null words become null."""
    key = F.regexp_extract("value", r"^\s+([A-Za-z0-9_]+):\s*\{(.*)\}\s*$", 1)
    body = F.regexp_extract("value", r"^\s+([A-Za-z0-9_]+):\s*\{(.*)\}\s*$", 2)

    def field(name: str) -> Column:
        quoted = F.regexp_extract("_body", rf'(?:^|[,\s]){name}:\s*"([^"]*)"', 1)
        bare = F.trim(F.regexp_extract("_body", rf"(?:^|[,\s]){name}:\s*([^,\}}\"]+)", 1))
        value = F.when(quoted != "", quoted).otherwise(F.nullif(bare, F.lit("")))
        return F.when(F.lower(value).isin("null", "none", "~"), None).otherwise(value)

    rows = lines.withColumns({"_key": key, "_body": body}).where("_key <> ''")
    return rows.select(F.col("_key").alias("label"), *[field(f).alias(f) for f in fields])


def scan_registry(spark: SparkSession, path: str, section: str, fields: Sequence[str]) -> DataFrame:
    """Records of one section of a registry file (a file is one small document, read whole)."""
    text = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", rf"(?ms)^{section}:[ \t]*\n((?:[ \t]+[^\n]*\n?|[ \t]*\n)*)", 1)
    return parse_registry(text.select(F.explode(F.split(block, "\n")).alias("value")), fields)


def scan_paste(spark: SparkSession, path: str) -> DataFrame:
    """Delimited paste: hotkey, total, easy, hard, medium[, review]; other lines are skipped."""
    return parse_paste(spark.read.text(path))


def parse_paste(lines: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("value", r"[,\t]"), lambda p: F.trim(p)), lambda p: p != "")
    rows = lines.withColumn("p", parts)
    at = lambda i: F.try_element_at("p", F.lit(i))
    out = rows.select(
        at(1).alias("hotkey"), at(2).try_cast("double").alias("total"), at(3).try_cast("double").alias("easy"),
        at(5).try_cast("double").alias("medium"), at(4).try_cast("double").alias("hard"),
        F.coalesce(at(6), F.lit("scored")).alias("review_status"))
    return out.where(F.col("hotkey").rlike("^[1-9A-HJ-NP-Za-km-z]{6,48}")).dropna(subset=["total", "easy", "medium", "hard"])


def scan_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Captured sessions as message rows; empty or unreadable captures are skipped."""
    docs = spark.read.schema("session string, ts string, trajectory array<struct<role:string, content:string>>, _corrupt_record string").option(
        "recursiveFileLookup", True).json(path)
    return docs.where("_corrupt_record IS NULL AND size(trajectory) > 0").select(
        "session", "ts", F.posexplode("trajectory").alias("msg_idx", "m")).select(
        "session", "ts", F.col("msg_idx").cast("long").alias("msg_idx"), "m.role", F.col("m.content").alias("text"))


def scan_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Metric files of all experiment runs."""
    return spark.read.schema("experiment_id string, subsets array<string>, n_tasks bigint, avg_ratio double, score double").option(
        "recursiveFileLookup", True).json(path)


TOKEN_PATHS = ("$.total_tokens", "$.metadata.total_tokens", "$.metadata.total.total_tokens",
               "$.metadata.token_usage.total_tokens", "$.metadata.token_usage.total.total_tokens")
STEP_PATHS = ("$.agent_steps", "$.metadata.agent_steps", "$.steps", "$.metadata.steps", "$.metadata.agent.steps",
              "$.metadata.token_usage.model_calls_count", "$.metadata.token_usage.assistant_usage_count",
              "$.metadata.session_index.message_count")
ERROR_KEYS = ("error", "task_error", "runtime_error", "failure_reason", "reason", "exception", "stderr")


ERROR_PATHS = ("$.error", *[f"$.metadata.{k}" for k in ERROR_KEYS], *[f"$.metadata.result.{k}" for k in ERROR_KEYS])


def _report_type() -> T.StructType:
    """Every path that is read of a report, as one type; a value is text as it stands in the report."""
    tree: dict = {}
    for path in (*TOKEN_PATHS, *STEP_PATHS, *ERROR_PATHS, "$.ok_status", "$.patch_capture_status", "$.execution_time_seconds"):
        *folders, leaf = path[2:].split(".")
        at = tree
        for name in folders:
            at = at.setdefault(name, {})
        at.setdefault(leaf, None)

    def as_type(node: dict | None) -> T.DataType:
        return T.StringType() if node is None else T.StructType([T.StructField(name, as_type(child)) for name, child in node.items()])

    return as_type(tree)


def read_reports(reports: DataFrame, raw: str = "report") -> DataFrame:
    """Reports with all paths in ``_report``: each text is parsed once, not once per path. Anything but a JSON object reads as null."""
    return reports.withColumn("_report", F.when(F.col(raw).rlike(r"^\s*\{"), F.from_json(raw, _report_type())))


def at_path(path: str) -> Column:
    return F.col(f"_report.{path[2:]}")


def _metrics() -> dict[str, Column]:
    pick = lambda paths: F.coalesce(*[integral(at_path(p)) for p in paths])
    return {"total_tokens": pick(TOKEN_PATHS), "agent_steps": pick(STEP_PATHS)}


def extract_run_metrics(reports: DataFrame, raw: str = "report") -> DataFrame:
    """First usable token and step count over fixed fallback paths."""
    return read_reports(reports, raw).withColumns(_metrics()).drop("_report")


def report_error() -> Column:
    """First non-blank error over the candidate keys of a read report, top level first."""
    return F.coalesce(*[F.nullif(F.trim(at_path(p)), F.lit("")) for p in ERROR_PATHS])


def ingest_reports(runs: DataFrame, reports: DataFrame, raw: str = "report") -> DataFrame:
    """Runs with tokens, steps, time, status and last error of their report; runs without one are unchanged."""
    ok = (at_path("$.ok_status") == "true") & (at_path("$.patch_capture_status") == "true")
    status = F.when(F.coalesce(ok, F.lit(False)), "completed").otherwise("failed")
    error = report_error()
    metrics = _metrics()
    parsed = read_reports(reports, raw).select(
        "run_id", F.lit(True).alias("_has"), metrics["total_tokens"].alias("_tokens"), metrics["agent_steps"].alias("_steps"),
        at_path("$.execution_time_seconds").try_cast("double").alias("_time"), status.alias("_status"),
        F.when(status == "failed", F.coalesce(error, F.lit("sandbox reported run as failed"))).otherwise(error).alias("_error"))
    joined = runs.join(parsed, "run_id", "left")
    new = lambda old, fresh: F.coalesce(F.col(fresh), F.col(old))
    return joined.withColumns({
        "tokens_used": new("tokens_used", "_tokens"), "agent_steps": new("agent_steps", "_steps"),
        "time_taken_seconds": new("time_taken_seconds", "_time"), "status": new("status", "_status"),
        "last_error": F.col("_error")}).drop("_has", "_tokens", "_steps", "_time", "_status", "_error")
