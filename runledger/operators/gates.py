"""Predicates and status labels: masks, cascades, acceptance checks, window and stake gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import token_estimate
from runledger.scale import positions

# Fixed values of the acceptance and log rules.
HIDDEN = "[hidden]"
MAX_CHARS_PER_TOKEN_GROWTH = 1.8
TEST_OUTPUT_START = ">>>>> Start Test Output"
TEST_OUTPUT_END = ">>>>> End Test Output"
TEST_SESSION_BANNER = "============================= test session starts =============================="


def mask_until(df: DataFrame, cols: list[str], gate: Column, now: Column, placeholder: str = HIDDEN) -> DataFrame:
    """Columns show a placeholder until ``now`` reaches the gate; an unknown gate stays closed."""
    is_open = F.coalesce(now >= gate, F.lit(False))
    return df.withColumns({c: F.when(is_open, F.col(c)).otherwise(F.lit(placeholder)) for c in cols})


def entrant_status() -> Column:
    """Eight-state cascade over counter columns; the order of the rules is part of the meaning."""
    total, done = F.col("n_competition"), F.col("scored_competition")
    screen_total, screen_done = F.col("n_screener"), F.col("scored_screener")
    known = total.isNotNull() & done.isNotNull()
    screened = (screen_total > 0) & screen_done.isNotNull()
    no_work = (F.coalesce("pending_competition", F.lit(0)) == 0) & (F.coalesce(done, F.lit(0)) == 0)
    return (
        F.when(F.col("banned"), "banned")
        .when(~F.col("has_script"), "idle")
        .when(known & (done >= total), "scored")
        .when(known & (done > 0), "evaluating")
        .when(F.col("pending_screener") > 0, "screening")
        .when(screened & (screen_done < screen_total), "screening")
        .when(screened & F.col("in_top") & no_work, "qualified")
        .when(screened & ~F.col("in_top"), "not qualified")
        .when(F.col("pending_competition") > 0, "evaluating")
        .otherwise("in queue"))


def status_overrides(entrants: DataFrame, latest: DataFrame, api_keys: DataFrame, progress: DataFrame,
                     verdicts: DataFrame) -> DataFrame:
    """Label that replaces the base status of an entrant, or null where the base status stands.

    ``latest``: entrant_id, competition_id, script_id. ``progress`` from
    `run_progress`, ``verdicts`` from `screening_verdict`.
    """
    keys = api_keys.where("revoked_at IS NULL").select("entrant_id").distinct().withColumn("_key", F.lit(True))
    on = ["competition_id", "entrant_id", "script_id"]
    joined = (
        latest.select(*on).join(entrants.select("entrant_id", "hotkey", "banned"), "entrant_id")
        .join(keys, "entrant_id", "left")
        .join(progress.select(*on, "fully_scored", "has_dispatched_other", "has_dispatched_screener"), on, "left")
        .join(verdicts.select(*on, "complete", "passed"), on, "left"))
    no = F.lit(False)
    label = (
        F.when(F.col("banned"), "failed review")
        .when(F.col("_key").isNull(), "no api key")
        .when(F.coalesce("fully_scored", no), "scored")
        .when(F.coalesce("has_dispatched_other", no), "evaluating")
        .when(F.coalesce("has_dispatched_screener", no), "screening")
        .when(F.coalesce("complete", no) & ~F.coalesce("passed", no), "not qualified"))
    return joined.select("competition_id", "entrant_id", "hotkey", label.alias("status"))


def competition_type(comps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Label by existence of tasks."""
    with_tasks = tasks.select("competition_id").distinct().withColumn("_t", F.lit(True))
    return comps.join(with_tasks, "competition_id", "left").withColumn(
        "competition_type", F.when(F.col("_t"), "agent tasks").otherwise("text compression")).drop("_t")


def accept_compression(original: Column, compressed: Column, ratio: Column,
                       original_tokens: Column | None = None, compressed_tokens: Column | None = None) -> Column:
    """Output not blank, not packed into long tokens, and within the target share of tokens.

    Token counts are columns so that any tokenizer can supply them; without
    one the character estimate is used.
    """
    n_in = original_tokens if original_tokens is not None else token_estimate(original)
    n_out = compressed_tokens if compressed_tokens is not None else token_estimate(compressed)
    per_in = F.length(original) / F.nullif(n_in, F.lit(0))
    per_out = F.when(n_out > 0, F.length(compressed) / F.nullif(n_out, F.lit(0))).otherwise(0.0)
    packed = F.coalesce((per_in > 0) & (per_out / per_in > MAX_CHARS_PER_TOKEN_GROWTH), F.lit(False))
    share_ok = F.when(ratio.isNull(), True).when((ratio <= 0) | (n_in == 0), False).otherwise(
        n_out / F.nullif(n_in, F.lit(0)) <= ratio)
    return ~F.trim(F.regexp_replace(compressed, r"(?U)^\s+|\s+$", "")).eqNullSafe("") & ~packed & share_ok


def normalize_partials(raw: Column) -> Column:
    """JSON text to an ordered array of (compression_ratio, score); nothing usable gives null."""
    items = F.from_json(raw, "array<struct<compression_ratio:string,score:string>>")
    typed = F.transform(items, lambda i: F.struct(
        i["compression_ratio"].try_cast("double").alias("compression_ratio"), i["score"].try_cast("double").alias("score")))
    good = F.filter(typed, lambda i: i["compression_ratio"].isNotNull() & i["score"].isNotNull())
    return F.when(F.size(good) > 0, F.array_sort(good))


def classify_failure(error: Column) -> Column:
    """Fixed failure classes of an error text."""
    low = F.lower(error)
    has = low.contains
    return (
        F.when(error.isNull() | (error == ""), "unknown_failure")
        .when(has("docker.sock"), "docker_sock_missing")
        .when(has("gatewaytransporterror") & has("1006"), "gateway_ws_1006")
        .when(has("gatewaytransporterror"), "gateway_transport_error")
        .when(has("timeout") | has("timed out"), "timeout")
        .otherwise("runtime_error"))


def classify_unavailable(detail: Column) -> Column:
    """Cause of a service-unavailable reply."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    return (F.when(low.contains("compression ratio check"), "compression_ratio_all_failed")
            .when(low.contains("no tasks available"), "no_tasks").otherwise("service_unavailable"))


def is_unified_diff(text: Column) -> Column:
    """A git header line, or an old-file and a new-file marker line."""
    return F.coalesce(
        text.rlike(r"(?m)^\s*diff --git ") | (text.rlike(r"(?m)^\s*--- ") & text.rlike(r"(?m)^\s*\+\+\+ ")),
        F.lit(False))


def extract_test_log(raw: Column) -> Column:
    """Text between the output markers (to the end if unclosed), then from the session banner on."""
    start = F.instr(raw, TEST_OUTPUT_START)
    after = F.substring(raw, start + len(TEST_OUTPUT_START), F.length(raw))
    inner = F.when(start > 0, F.substring_index(after, TEST_OUTPUT_END, 1)).otherwise(raw)
    banner = F.instr(inner, TEST_SESSION_BANNER)
    cut = F.when(banner > 0, F.substring(inner, banner, F.length(inner))).otherwise(inner)
    return F.regexp_replace(cut, r"(?U)^\s+|\s+\z", "")


def stake_gate(validators: DataFrame, stakes: DataFrame | None, min_total: float, min_alpha: float) -> DataFrame:
    """Registered, enough total stake, enough alpha stake; unknown alpha fails a positive minimum."""
    if stakes is None:
        return validators.select("*", F.lit(False).alias("is_valid"), F.lit(None).cast("double").alias("stake"),
                                 F.lit("snapshot unavailable").alias("reason"))
    joined = validators.join(stakes.withColumn("_reg", F.lit(True)), "hotkey", "left")
    total, alpha = F.col("stake"), F.col("alpha_stake")
    reason = (
        F.when(F.col("_reg").isNull(), "not registered")
        .when(~F.coalesce(total >= min_total, F.lit(False)), "insufficient total stake")
        .when(alpha.isNull() & F.lit(min_alpha > 0), "alpha stake unavailable")
        .when(F.coalesce(alpha < min_alpha, F.lit(False)), "insufficient alpha stake")
        .otherwise("sufficient"))
    return joined.select(*validators.columns, "stake", reason.alias("reason"),
                         (reason == "sufficient").alias("is_valid"))


def upload_gate(requests: DataFrame, entrants: DataFrame, windows: DataFrame, min_gap_seconds: int) -> DataFrame:
    """Judge every upload request in the light of the requests before it.

    ``requests``: request_id, entrant_id, competition_id, requested_at.
    ``windows``: competition_id, upload_starts_at, upload_ends_at. Every
    earlier request counts as an upload.
    """
    # numbered per entrant by day; the predecessor is an equality on the number
    numbered = positions(requests.select("entrant_id", "request_id", "requested_at"), ["entrant_id"],
                         F.date_trunc("day", "requested_at"), ["requested_at", "request_id"], "_pos")
    earlier = numbered.select("entrant_id", (F.col("_pos") + 1).alias("_pos"), F.col("requested_at").alias("_prev"))
    previous = numbered.join(earlier, ["entrant_id", "_pos"]).select("entrant_id", "request_id", "_prev")
    first_in_round = requests.groupBy("entrant_id", "competition_id").agg(
        F.min(F.struct("requested_at", "request_id")).alias("_first"))
    timed = requests.join(previous, ["entrant_id", "request_id"], "left")
    joined = (timed.join(first_in_round, ["entrant_id", "competition_id"])
              .join(entrants.select("entrant_id", "banned"), "entrant_id", "left")
              .join(windows.select("competition_id", "upload_starts_at", "upload_ends_at"), "competition_id", "left"))
    at = F.col("requested_at")
    reason = (
        F.when(~F.coalesce((at >= F.col("upload_starts_at")) & (at <= F.col("upload_ends_at")), F.lit(False)),
               "uploads closed")
        .when(F.coalesce("banned", F.lit(False)), "banned")
        .when(F.unix_timestamp(at) - F.unix_timestamp("_prev") < min_gap_seconds, "too frequent")
        .when(F.col("_first.request_id") != F.col("request_id"), "already uploaded")
        .otherwise("ok"))
    return joined.select("request_id", "entrant_id", "competition_id", reason.alias("reason"))


def validate_windows(requests: DataFrame, comps: DataFrame, now: Column) -> DataFrame:
    """Reason why a reward window is refused, or ok. ``requests``: request_id, competition_id, starts_at, ends_at."""
    joined = requests.join(comps.select("competition_id", "eval_ends_at").withColumn("_known", F.lit(True)),
                           "competition_id", "left")
    start, end = F.col("starts_at"), F.col("ends_at")
    reason = (
        F.when(start.isNull() != end.isNull(), "both ends needed together")
        .when(start.isNull(), "window required")
        .when(F.col("_known").isNull(), "competition not found")
        .when(now < F.col("eval_ends_at"), "evaluation not ended")
        .when(start >= end, "start not before end")
        .otherwise("ok"))
    return joined.select("request_id", "competition_id", reason.alias("reason"))
