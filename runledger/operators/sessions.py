"""Session-shaped operators over message rows.

Messages: session_id, msg_idx (dense from 0), role, text, call_id, tool,
args. An assistant row makes the call ``call_id``; a toolresult row answers
it. Where messages make several calls, a column ``calls`` (array of id, tool,
args) lists those of an assistant row instead, and ids may be used again
later on. Sessions may be arbitrarily long: per-session facts are combined
map-side and joined back per block of positions, running values go through
`running_totals`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import text as T
from runledger.scale import attach_by_block, keep_first, running_totals
from runledger.session import through_parquet

RESULT = "toolresult"
LOOP_WINDOW = 12
LOOP_THRESHOLD = 3
LOOP_ARGS_CHARS = 120
PASSTHROUGH_TOKENS = 3_000
# still failing: this many of the newest results bear errors, from this depth on
GUARD_WINDOW, GUARD_HITS, GUARD_MSGS = 4, 4, 40
MODES = ("passthrough", "harvest", "rich")


def is_result() -> Column:
    return F.col("role") == RESULT


def makes_calls(messages: DataFrame) -> Column:
    """Condition on rows of these messages: an assistant row with at least one call."""
    if "calls" in messages.columns:
        called = F.exists(F.coalesce("calls", F.array().cast(messages.schema["calls"].dataType)), lambda c: c["id"].isNotNull())
    else:
        called = F.col("call_id").isNotNull()
    return (F.col("role") == "assistant") & called


def calls_of(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, call_no, call_id, tool, args): every call of every assistant message."""
    made = messages.where(makes_calls(messages))
    if "calls" in messages.columns:
        each = made.select("session_id", "msg_idx", F.posexplode("calls").alias("call_no", "c"))
        return each.select("session_id", "msg_idx", "call_no", F.col("c.id").alias("call_id"), F.col("c.tool").alias("tool"),
                           F.col("c.args").alias("args")).where("call_id IS NOT NULL")
    described = [F.col(c) if c in messages.columns else F.lit(None).cast("string").alias(c) for c in ("tool", "args")]
    return made.select("session_id", "msg_idx", F.lit(0).alias("call_no"), "call_id", *described)


def keep_calls(messages: DataFrame, kept: DataFrame, where: Column) -> DataFrame:
    """The messages, those at ``where`` with no other calls than ``kept`` (session_id, msg_idx, call_id, unique)."""
    marked = kept.select("session_id", "msg_idx", "call_id").groupBy("session_id", "msg_idx").agg(F.collect_set("call_id").alias("_kept"))
    joined = messages.join(marked, ["session_id", "msg_idx"], "left")
    ids = F.coalesce("_kept", F.array().cast(marked.schema["_kept"].dataType))
    if "calls" in messages.columns:
        new = {"calls": F.filter("calls", lambda c: F.array_contains(ids, c["id"]))}
    else:
        new = {c: F.when(F.coalesce(F.array_contains(ids, F.col("call_id")), F.lit(False)), F.col(c)) for c in ("call_id", "tool", "args") if c in messages.columns}
    change = where & (F.col("role") == "assistant")
    return joined.select(*[F.when(change, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in messages.columns])


def newest_floor(messages: DataFrame, n: int, condition: Column | None = None, name: str = "floor") -> DataFrame:
    """Per session the position of its ``n``-th newest (matching) message, or of the oldest if fewer."""
    rows = messages if condition is None else messages.where(condition)
    top = keep_first(rows.select("session_id", "msg_idx"), ["session_id"], [F.col("msg_idx").desc()], n)
    return top.groupBy("session_id").agg(F.min("msg_idx").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))


def attach_session(messages: DataFrame, *facts: DataFrame) -> DataFrame:
    """Left join of one-row-per-session facts; long sessions are spread over tasks."""
    joined = messages.groupBy("session_id").agg(F.max("msg_idx").alias("_last_idx"))
    for f in facts:
        joined = joined.join(f, "session_id", "left")
    return attach_by_block(messages, joined, ["session_id"], "msg_idx", "_last_idx")


def recent_window(messages: DataFrame, n: int) -> DataFrame:
    """Flag on the newest ``n`` messages of a session."""
    last = messages.groupBy("session_id").agg(F.max("msg_idx").alias("_last"), F.max("msg_idx").alias("_upto"))
    flagged = attach_by_block(messages, last, ["session_id"], "msg_idx", "_upto")
    return flagged.withColumn("recent", F.col("msg_idx") > F.col("_last") - n).drop("_last")


def recent_results(messages: DataFrame, n: int) -> DataFrame:
    """Flag on the newest ``n`` tool results of a session."""
    floor = newest_floor(messages, n, is_result(), "_floor")
    flagged = attach_session(messages, floor)
    return flagged.withColumn("recent", is_result() & F.coalesce(F.col("msg_idx") >= F.col("_floor"), F.lit(False))
                              ).drop("_floor", "_floor_n")


def content_key(text: Column) -> Column:
    """Hash that ignores differences in whitespace."""
    return F.sha2(T.collapse_whitespace(F.coalesce(text, F.lit(""))), 256)


def newest_of_key(keyed: DataFrame, key: str, flag: str) -> DataFrame:
    """(session_id, msg_idx) of the newest row of every (session, key).

    Joined back on the position itself, so that a key with very many copies
    never meets in one task.
    """
    return keyed.where(F.col(key).isNotNull()).groupBy("session_id", key).agg(F.max("msg_idx").alias("msg_idx")).select(
        "session_id", "msg_idx", F.lit(True).alias(flag))


def duplicate_results(messages: DataFrame) -> DataFrame:
    """Tool results with a flag: is a later result of the session identical?"""
    results = messages.where(is_result()).withColumn("content_key", content_key(F.col("text")))
    newest = newest_of_key(results.select("session_id", "msg_idx", "content_key"), "content_key", "_newest")
    return results.join(newest, ["session_id", "msg_idx"], "left").withColumn(
        "duplicate", F.col("_newest").isNull()).drop("_newest")


def pair_calls(messages: DataFrame) -> DataFrame:
    """Every tool result with the position of its call: the nearest earlier one of its id, else the nearest earlier calling message.

    Both are last known values along the session: of calls of one id, and of
    calling messages; block totals carry them, so neither a long session nor
    an id used over and over is one task.
    """
    calls = calls_of(messages).select("session_id", "call_id", "msg_idx").distinct().withColumn("_call", F.lit(True))
    answers = messages.where(is_result() & F.col("call_id").isNotNull()).select("session_id", "call_id", "msg_idx", F.lit(False).alias("_call"))
    by_id = running_totals(calls.unionByName(answers), ["session_id", "call_id"], "msg_idx", {}, {"by_id": F.when(F.col("_call"), F.col("msg_idx"))})
    slim = messages.select("session_id", "msg_idx", "role", "call_id", makes_calls(messages).alias("_calls"))
    results = running_totals(slim, ["session_id"], "msg_idx", {}, {"nearest": F.when(F.col("_calls"), F.col("msg_idx"))}).where(is_result())
    paired = results.join(by_id.where("NOT _call").select("session_id", "msg_idx", "by_id"), ["session_id", "msg_idx"], "left")
    return paired.select("session_id", F.col("msg_idx").alias("result_idx"), "call_id",
                         F.coalesce("by_id", "nearest").alias("call_idx"), F.col("by_id").isNotNull().alias("matched_by_id"))


def orphans(messages: DataFrame) -> DataFrame:
    """Results without a call and calls without a result, per session."""
    calls = calls_of(messages).select("session_id", "call_id", F.lit(True).alias("call"))
    answers = messages.where(is_result() & F.col("call_id").isNotNull()).select("session_id", "call_id", F.lit(False).alias("call"))
    ids = calls.unionByName(answers).groupBy("session_id", "call_id").agg(
        F.bool_or("call").alias("called"), F.bool_or(~F.col("call")).alias("answered"))
    return ids.where(~(F.col("called") & F.col("answered"))).select(
        "session_id", "call_id", F.when(F.col("called"), "call").otherwise("result").alias("kind"))


def orphan_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per session of the input: did the output add an orphan or come out empty?"""
    added = orphans(after).join(orphans(before), ["session_id", "call_id", "kind"], "left_anti")
    broken = added.groupBy("session_id").agg(F.count(F.lit(1)).alias("new_orphans"))
    left = after.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_out"))
    sessions = before.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_in"))
    n_out, n_new = F.coalesce("n_out", F.lit(0)), F.coalesce("new_orphans", F.lit(0))
    return sessions.join(left, "session_id", "left").join(broken, "session_id", "left").select(
        "session_id", "n_in", n_out.alias("n_out"), n_new.alias("new_orphans"),
        ((n_out > 0) & (n_new == 0)).alias("ok"))


def with_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Output where the guard holds, the untouched input otherwise."""
    verdict = orphan_guard(before, after).select("session_id", "ok")
    good = after.join(verdict.where("ok"), "session_id", "left_semi")
    bad = before.join(verdict.where("NOT ok"), "session_id", "left_semi")
    return good.unionByName(bad.select(*after.columns))


def session_ratchets(messages: DataFrame, window: int = GUARD_WINDOW, min_hits: int = GUARD_HITS, min_msgs: int = GUARD_MSGS) -> DataFrame:
    """State after every tool result (one round each): largest size, cumulated size, failing rounds, ever passed, ever still failing.

    The context of a round is everything up to its position. A round is still
    failing if at least ``min_hits`` of its newest ``window`` results bear
    errors and the session is ``min_msgs`` messages deep. The errors of a
    window are the difference of two running counts, that of the round and
    that of the round ``window`` results before, met by an equi join.
    """
    failing = is_result() & T.has_failing_test(F.col("text"))
    passing = is_result() & T.has_passing_test(F.col("text")) & ~failing
    # texts are read once: the running counts below go over the marks, several times
    marks = through_parquet(messages.select(
        "session_id", "msg_idx", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), failing.cast("long").alias("fail"),
        passing.cast("long").alias("clean"), (is_result() & T.has_error(F.col("text"))).cast("long").alias("error")), "marks")
    grown = running_totals(marks, ["session_id"], "msg_idx", {
        "chars": F.col("size"), "fail_rounds": F.col("fail"), "passes": F.col("clean"), "round_no": F.coalesce(is_result().cast("long"), F.lit(0).cast("long")),
        "errors": F.coalesce("error", F.lit(0)).cast("long")})
    tokens = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("chars") / T.CHARS_PER_TOKEN))
    rounds = through_parquet(grown.where(is_result()).select(
        "session_id", "msg_idx", "role", tokens.alias("tokens"), "fail_rounds", "passes", "round_no", "errors"), "rounds")
    state = running_totals(rounds, ["session_id"], "round_no", {"cumulative": F.col("tokens")}, {"largest": F.col("tokens")})
    before = state.select("session_id", (F.col("round_no") + window).alias("round_no"), F.col("errors").alias("_before"))
    recent = F.col("errors") - F.coalesce("_before", F.lit(0))
    rounds = state.join(before, ["session_id", "round_no"], "left").select(
        "session_id", "msg_idx", "round_no", "tokens", "largest", "cumulative", "fail_rounds", (F.col("passes") > 0).alias("ever_passed"),
        recent.alias("recent_errors"), (F.col("msg_idx") + 1 >= min_msgs).alias("_deep"))
    failing_still = (F.col("_deep") & (F.col("recent_errors") >= min_hits)).cast("long")
    latched = running_totals(rounds, ["session_id"], "round_no", {"_still": failing_still})
    return latched.select("session_id", "msg_idx", "tokens", "largest", "cumulative", "fail_rounds", "ever_passed", "recent_errors",
                          (F.col("_still") > 0).alias("still_failing"))


def route_modes(state: DataFrame, large_tokens: int, large_cumulative: int, large_msgs: int, fail_rounds: int = 3,
                deep_tokens: int = 60_000, deep_cumulative: int = 300_000, deep_msgs: int = 60, deep_fail_rounds: int = 2
                ) -> DataFrame:
    """Sticky mode of every round from the ratchets.

    All inputs only grow, so sticky switches are thresholds on them. Flip
    holds from the first trigger until tests pass; it needs fewer failing
    rounds once the session is deep. A round counts as triggered when
    failures reached the lower threshold while deep or the higher one at all,
    or when the session was still failing at any round so far.
    """
    depth = F.col("msg_idx") + 1
    deep = (F.col("largest") >= deep_tokens) | (F.col("cumulative") >= deep_cumulative) | (depth >= deep_msgs)
    flip = (F.col("fail_rounds") >= fail_rounds) | (deep & (F.col("fail_rounds") >= deep_fail_rounds)) | F.col("still_failing")
    rich = (depth >= large_msgs) | (F.col("largest") >= large_tokens) | (F.col("cumulative") >= large_cumulative)
    mode = (F.when(flip & ~F.col("ever_passed"), "flip").when(rich, "rich")
            .when(F.col("largest") >= PASSTHROUGH_TOKENS, "harvest").otherwise("passthrough"))
    return state.withColumn("mode", mode)


def detect_loops(messages: DataFrame) -> DataFrame:
    """Same call with the identical result three or more times among the newest twelve answered calls."""
    answers = messages.where(is_result() & F.col("call_id").isNotNull()).groupBy("session_id", "call_id").agg(
        F.max_by(content_key(F.col("text")), "msg_idx").alias("result_key"))
    calls = calls_of(messages).select(
        "session_id", "call_id", "msg_idx", F.coalesce("tool", F.lit("tool")).alias("tool"),
        T.clip(T.collapse_whitespace(F.coalesce("args", F.lit(""))), LOOP_ARGS_CHARS).alias("args"))
    answered = calls.join(answers, ["session_id", "call_id"])
    newest = keep_first(answered, ["session_id"], [F.col("msg_idx").desc()], LOOP_WINDOW)
    return newest.groupBy("session_id", "tool", "args", "result_key").agg(
        F.count(F.lit(1)).alias("repeats"), F.min("msg_idx").alias("first_idx")).where(
        F.col("repeats") >= LOOP_THRESHOLD).select("session_id", "tool", "args", "repeats", "first_idx")


def recent_errors(messages: DataFrame, window: int = 4) -> DataFrame:
    """Error-bearing results among the newest ``window`` results."""
    newest = keep_first(messages.where(is_result()), ["session_id"], [F.col("msg_idx").desc()], window)
    return newest.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.count_if(T.has_error(F.col("text"))).alias("n_errors"))


def stale_snapshots(messages: DataFrame, intact: int, min_reads: int = 2) -> DataFrame:
    """Latest result of every file read at least ``min_reads`` times, if it lies outside the intact window.

    A call reads a file when its arguments name exactly one path.
    """
    bare = F.array_distinct(F.transform(T.paths(F.coalesce("args", F.lit(""))), lambda p: F.substring_index(p, ":", 1)))
    reads = calls_of(messages).select("session_id", "call_id", bare.alias("p")).where(F.size("p") == 1).select(
        "session_id", "call_id", F.col("p")[0].alias("path"))
    results = messages.where(is_result()).select("session_id", "call_id", "msg_idx").join(reads, ["session_id", "call_id"])
    last = messages.groupBy("session_id").agg(F.max("msg_idx").alias("_last"))
    return (results.groupBy("session_id", "path").agg(F.max("msg_idx").alias("msg_idx"), F.count(F.lit(1)).alias("reads"))
            .where(F.col("reads") >= min_reads).join(last, "session_id")
            .where(F.col("msg_idx") <= F.col("_last") - intact).drop("_last"))


def prefix_stability(outputs: DataFrame) -> DataFrame:
    """Length of the common prefix of consecutive outputs of a session.

    ``outputs``: session_id, call_no, msg_idx, text. The prefix ends at the
    first position where either side differs or has no message.
    """
    keyed = outputs.select("session_id", "call_no", "msg_idx", F.sha2(F.concat_ws("\u0001", "role", "text"), 256).alias("k"))
    older = keyed.select("session_id", (F.col("call_no") + 1).alias("call_no"), "msg_idx", F.col("k").alias("k_old"))
    sizes = keyed.groupBy("session_id", "call_no").agg(F.count(F.lit(1)).alias("n"))
    differing = keyed.join(older, ["session_id", "call_no", "msg_idx"], "full").where(~F.col("k").eqNullSafe(F.col("k_old")))
    first = differing.groupBy("session_id", "call_no").agg(F.min("msg_idx").alias("first_diff"))
    previous = sizes.select("session_id", (F.col("call_no") + 1).alias("call_no"), F.col("n").alias("n_previous"))
    return sizes.join(previous, ["session_id", "call_no"]).join(first, ["session_id", "call_no"], "left").select(
        "session_id", "call_no", "n_previous", "n", F.coalesce("first_diff", "n").alias("common_prefix"))


def first_user(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("session_id").agg(
        F.min("msg_idx").alias("msg_idx"), F.min_by("text", "msg_idx").alias("text"))


def latest_test_result(messages: DataFrame) -> DataFrame:
    """Newest error-bearing tool result per session."""
    return messages.where(is_result() & T.has_error(F.col("text"))).groupBy("session_id").agg(
        F.max("msg_idx").alias("msg_idx"), F.max_by("text", "msg_idx").alias("text"))


def budget_drop(items: DataFrame, relief: str, target: str, max_entries: int = 40, entry_chars: int = 320) -> DataFrame:
    """Which items go, oldest unprotected first, until the planned size meets the relief bound.

    ``items``: session_id, pos (1-based order of sacrifice), saving, planned
    (session total before any drop), pre_dropped (already dropped). A
    drop replaces its cost by a fixed digest estimate while fewer than
    ``max_entries`` are listed, so the planned size may even grow; the
    exact rule is the first position at which the bound holds.
    """
    summed = running_totals(items, ["session_id"], "pos", {"saved": F.col("saving").cast("long")})
    listed = F.least(F.col("pre_dropped") + F.col("pos"), F.lit(max_entries)) - F.least(
        F.col("pre_dropped"), F.lit(max_entries))
    sized = summed.withColumn("planned_after", F.col("planned") - F.col("saved") + listed * entry_chars)
    cut = sized.groupBy("session_id").agg(
        F.max("pos").alias("_last_pos"),
        F.min(F.when(F.col("planned_after") <= F.col(relief), F.col("pos"))).alias("_cut"))
    tagged = attach_by_block(sized, cut, ["session_id"], "pos", "_last_pos")
    over = (F.col("planned") > F.col(target)) & (F.col("planned") > F.col(relief))
    return tagged.withColumn("dropped", over & (F.col("pos") <= F.coalesce("_cut", "pos"))).drop("_cut", "saved")
