"""Transcript compression: sanitising, pruning, gentle and structural modes, notes, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions import text as T
from runledger.operators import sessions as S
from runledger.operators.lines import extractive_compress, ranked_lines
from runledger.scale import keep_first, positions, quantiles, shuffled, values_at
from runledger.session import through_parquet

# Fixed values of the compression rules.
NEAR_DUPLICATE_MIN_CHARS = 400
ACTIVE_WINDOW = 10
KEEP_RECENT = 4
UNTOUCHABLE = 2
PRESSURE_RELIEF = 0.75
PROTECTED_CAP = 5_000
MID = (1_000, 400)
MID_SMALL = (500, 200)
ASSISTANT_CAP = (1_200, 300)
ABSOLUTE_CAP = 40_000
TAIL_CAP = 16_000
DIGEST_ENTRIES = 40
DIGEST_ENTRY_CHARS = 320
DIGEST_ARGS_CHARS = 110
DIGEST_RESULT_CHARS = 150
DIGEST_PATHS = 6
ISSUE_CHARS = 1_500
STATUS_LINES = 5
STATUS_LINE_CHARS = 130

# beginnings that the audit looks for: of a user message, of the newest result
AUDIT_CHARS = (60, 120)

DIGEST_BEGIN = "[COMPRESSED HISTORY"
DIGEST_HEADER = "[COMPRESSED HISTORY: earlier steps were removed to save context; one line each, oldest first]"
DIGEST_END = "[/COMPRESSED HISTORY]"
NOTE_MARK = "[CONTEXT NOTE]"
DUPLICATE_MARK = "[identical to a later tool result in this session]"
NEAR_DUPLICATE_MARK = "[near-identical to a later tool result in this session]"


def sanitize(messages: DataFrame, block_type: str = "block_type", error: str = "error_message") -> DataFrame:
    """Drop thinking blocks, failed empty assistant turns and empty messages that are no tool result."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    no_call = ~S.makes_calls(messages) & F.col("call_id").isNull()
    kept = messages.where(~F.coalesce(F.col(block_type) == "thinking", F.lit(False)))
    failed = (F.col("role") == "assistant") & F.col(error).isNotNull() & blank & no_call
    return kept.where(~failed & ((F.col("role") == S.RESULT) | ~blank | ~no_call))


def prune_recent(messages: DataFrame, n: int = KEEP_RECENT) -> DataFrame:
    """First user message, the newest ``n`` results and the messages that call them, without their other calls.

    If no call has an id of these results, the nearest calling message before
    them stands in. Sessions without a user message, with fewer than ``n``
    results, without any such call, or from which nothing would go stay whole.
    """
    # roles and ids decide; they are read many times and written once, the messages themselves are fetched at the end. None of
    # these tables is bounded, and written they are far smaller than their rows: no join here may broadcast one
    ids_only = {"calls": F.transform("calls", lambda c: F.struct(
        c["id"].alias("id"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("args")))} if "calls" in messages.columns else {}
    slim = shuffled(through_parquet(messages.select(
        "session_id", "msg_idx", "role", "call_id", *[e.alias(c) for c, e in ids_only.items()]), "prune-messages"))
    floor = S.newest_floor(slim, n, S.is_result(), "_floor")
    opening = slim.where("role = 'user'").groupBy("session_id").agg(F.min("msg_idx").alias("_first"))
    wanted = shuffled(slim.where(S.is_result() & F.col("call_id").isNotNull()).join(floor, "session_id").where("msg_idx >= _floor").select(
        "session_id", "call_id").distinct())
    calls = S.calls_of(slim)
    matched = shuffled(through_parquet(calls.join(wanted, ["session_id", "call_id"], "left_semi").select(
        "session_id", "msg_idx", "call_id").distinct(), "prune-calls"))
    callers = matched.select("session_id", "msg_idx").distinct().withColumn("_caller", F.lit(True))
    nearest = shuffled(calls.select("session_id", "msg_idx").join(floor, "session_id").where("msg_idx < _floor").groupBy("session_id").agg(
        F.max("msg_idx").alias("_nearest")))
    has_match = matched.select("session_id").distinct().withColumn("_matched", F.lit(True))
    has_ids = wanted.select("session_id").distinct().withColumn("_ids", F.lit(True))
    facts = floor.join(opening, "session_id", "left").join(has_match, "session_id", "left").join(nearest, "session_id", "left").join(
        has_ids, "session_id", "left")
    marked = S.attach_session(slim, facts).join(callers, ["session_id", "msg_idx"], "left")
    by_id, found = F.coalesce("_caller", F.lit(False)), F.coalesce("_matched", F.lit(False))
    stays = F.coalesce((F.col("msg_idx") == F.col("_first")) | (S.is_result() & (F.col("msg_idx") >= F.col("_floor"))) | by_id
                       | (~found & (F.col("msg_idx") == F.col("_nearest"))), F.lit(False))
    whole = F.col("_first").isNull() | (F.coalesce("_floor_n", F.lit(0)) < n) | (~found & F.col("_nearest").isNull())
    # in sessions from which something goes: what goes, and the calling messages that stay
    marks = shuffled(through_parquet(marked.where(~whole & (~stays | (F.col("role") == "assistant"))).select(
        "session_id", "msg_idx", (~stays).alias("_gone"), F.coalesce("_ids", F.lit(False)).alias("_strip")), "prune-marks"))
    shrinks = marks.where("_gone").select("session_id").distinct()
    marks = shuffled(marks.join(shrinks, "session_id", "left_semi"))
    kept = messages.join(marks, ["session_id", "msg_idx"], "left").where(~F.coalesce("_gone", F.lit(False))).select(
        *[F.col(c) for c in messages.columns], F.coalesce("_strip", F.lit(False)).alias("_strip"))
    return S.keep_calls(kept, matched, F.col("_strip")).drop("_strip")


def active_paths(messages: DataFrame, n: int = ACTIVE_WINDOW) -> DataFrame:
    """Names of the files mentioned in the newest ``n`` messages or their call arguments."""
    newest = keep_first(messages, ["session_id"], [F.col("msg_idx").desc()], n)
    names = newest.select("session_id", F.explode(T.path_names(F.concat_ws("\n", "text", "args"))).alias("name"))
    return names.groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("active"))


def load_bearing_flag(text: Column, active: Column) -> Column:
    """Errors, files in use, diff or test lines: what a trim must leave alone."""
    mentions = F.exists(F.coalesce(active, F.array().cast("array<string>")), lambda p: F.contains(text, p))
    return T.has_error(text) | mentions | T.has_diff(text) | T.has_test_line(text)


def load_bearing(messages: DataFrame) -> DataFrame:
    """Tool results with the flag."""
    results = S.attach_session(messages, active_paths(messages)).where(S.is_result())
    return results.withColumn("load_bearing", load_bearing_flag(F.col("text"), F.col("active")))


def collapse_duplicates(messages: DataFrame, intact: int = 0) -> DataFrame:
    """Exact copies of a later result become a marker; the newest copy and the intact window stay."""
    return _collapse(messages, intact, near=False)


def collapse_near_duplicates(messages: DataFrame, intact: int = 0) -> DataFrame:
    """Also collapses results that equal a later one up to digits and punctuation, if nothing depends on them."""
    return _collapse(messages, intact, near=True)


def classify_results(messages: DataFrame, intact: int, near: bool = True) -> DataFrame:
    """Action per message: keep, duplicate, near-duplicate, protected, stale.

    Only keys and flags travel through the grouping shuffles, texts stay put
    until the final join back.
    """
    last = messages.groupBy("session_id").agg(F.max("msg_idx").alias("_last"))
    # hashes are the costly part and are read three times: written once, without the texts
    near_key = T.let(T.normal_form(F.coalesce("text", F.lit(""))), lambda form: F.when(
        F.length(form) >= NEAR_DUPLICATE_MIN_CHARS, F.sha2(form, 256)))
    keys = through_parquet(messages.where(S.is_result()).select(
        "session_id", "msg_idx", S.content_key(F.col("text")).alias("_exact"), near_key.alias("_near")), "result-keys")
    newest_exact = S.newest_of_key(keys, "_exact", "_newest_exact")
    newest_near = S.newest_of_key(keys, "_near", "_newest_near")
    flags = keys.select("session_id", "msg_idx", F.col("_near").isNotNull().alias("_long"))
    flags = flags.join(newest_exact, ["session_id", "msg_idx"], "left").join(newest_near, ["session_id", "msg_idx"], "left")
    tagged = S.attach_session(messages, last, active_paths(messages)).join(flags, ["session_id", "msg_idx"], "left")
    bearing = load_bearing_flag(F.col("text"), F.col("active"))
    action = (
        F.when(~S.is_result() | (F.col("msg_idx") > F.col("_last") - intact), "keep")
        .when(F.col("_newest_exact").isNull(), "duplicate")
        .when(F.lit(near) & F.col("_long") & F.col("_newest_near").isNull() & ~bearing, "near-duplicate")
        .when(bearing, "protected")
        .otherwise("stale"))
    return tagged.select(*messages.columns, action.alias("action"))


def _collapse(messages: DataFrame, intact: int, near: bool) -> DataFrame:
    marked = classify_results(messages, intact, near)
    text = F.when(F.col("action") == "duplicate", DUPLICATE_MARK).when(
        F.col("action") == "near-duplicate", NEAR_DUPLICATE_MARK).otherwise(F.col("text"))
    return marked.withColumn("text", text).select(*messages.columns, "action")


def compress_gentle(messages: DataFrame, stale_cap: int = 6_000, protected_cap: int = 30_000, intact: int = 10) -> DataFrame:
    """No message is dropped: copies collapse, old results are trimmed line-wise to a cap by class."""
    marked = _collapse(messages, intact, near=True)
    trimmed = F.col("action").isin("protected", "stale")
    cap = F.when(F.col("action") == "protected", F.lit(protected_cap)).otherwise(F.lit(stale_cap))
    return marked.withColumn("text", F.when(trimmed, extractive_compress(F.col("text"), cap)).otherwise(F.col("text")))


def issue_text(messages: DataFrame) -> DataFrame:
    """Task statement: first user text that is no note, without digest, clipped to head 80 % and tail 20 %."""
    opening = S.first_user(messages.where(~F.coalesce(F.startswith("text", F.lit(NOTE_MARK)), F.lit(False))))
    bare = F.trim(F.substring_index("text", DIGEST_BEGIN, 1))
    head = int(ISSUE_CHARS * 0.8)
    clipped = F.concat(F.substring(bare, 1, head), F.lit("\n…\n"), F.right(bare, F.lit(ISSUE_CHARS - head)))
    return opening.select("session_id", F.when(F.length(bare) > ISSUE_CHARS, clipped).otherwise(bare).alias("issue"))


def test_status(messages: DataFrame) -> DataFrame:
    """Up to five distinct test lines of the newest error-bearing result."""
    latest = S.latest_test_result(messages)
    found = F.transform(F.regexp_extract_all("text", F.lit(T.TEST_LINE), 0), T.collapse_whitespace)
    lines = F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, STATUS_LINES)
    return latest.select("session_id", F.array_join(F.transform(lines, lambda x: T.clip(x, STATUS_LINE_CHARS)), "\n")
                         .alias("status"))


def clean_pass(messages: DataFrame) -> DataFrame:
    """Does the newest result pass without showing a failure?"""
    newest = messages.where(S.is_result()).groupBy("session_id").agg(F.max_by("text", "msg_idx").alias("text"))
    t = F.col("text")
    return newest.select("session_id", (T.has_passing_test(t) & ~T.has_failing_test(t)).alias("clean_pass"))


def session_notes(messages: DataFrame) -> DataFrame:
    """Previous notes removed, one new note appended: loop warning and stop condition."""
    bare = messages.where(~((F.col("role") == "user") & F.coalesce(F.startswith("text", F.lit(NOTE_MARK)), F.lit(False))))
    loops = S.detect_loops(bare).groupBy("session_id").agg(
        F.min_by(F.concat("tool", F.lit("("), "args", F.lit(")")), "first_idx").alias("loop"))
    last = bare.groupBy("session_id").agg(F.max("msg_idx").alias("_last"))
    facts = last.join(loops, "session_id", "left").join(clean_pass(bare), "session_id", "left")
    loop_line = F.when(F.col("loop").isNotNull(), F.concat(
        F.lit("Loop detected: the same action gave the same result several times ("), F.col("loop"),
        F.lit("). Change the approach.")))
    stop_line = F.when(F.coalesce("clean_pass", F.lit(False)), "The tests pass. Stop and return the final answer.").otherwise(
        "Once the change is complete and the tests pass, stop and return the final answer.")
    notes = facts.select(
        "session_id", (F.col("_last") + 1).alias("msg_idx"), F.lit("user").alias("role"),
        F.concat_ws("\n", F.lit(NOTE_MARK), loop_line, stop_line).alias("text"))
    return bare.unionByName(notes, allowMissingColumns=True)


def trim_reasoning(messages: DataFrame, intact: int = 12, head: int = 300, tail: int = 300) -> DataFrame:
    """Old assistant text cut to head and tail; everything else untouched."""
    marked = S.recent_window(messages, intact)
    old = (F.col("role") == "assistant") & ~F.col("recent")
    cut = T.head_tail(F.col("text"), head, tail, "\n… [reasoning trimmed] …\n", slack=40)
    return marked.withColumn("text", F.when(old, cut).otherwise(F.col("text"))).drop("recent")


LEVERS = ("trunc2", "assist_cap", "tail_cap")
# what a profile sets, and the values without one
KNOBS = {"target_tokens": 8_000, "mid_head": MID[0], "mid_tail": MID[1], "small_head": MID_SMALL[0], "small_tail": MID_SMALL[1],
         "assist_head": ASSISTANT_CAP[0], "assist_tail": ASSISTANT_CAP[1], "tail_cap_chars": TAIL_CAP}
# fixed values of the profiles, in the order of KNOBS
PROFILES = {
    "light": (7_000, 850, 350, 450, 180, 1_000, 280, 13_000),
    "medium": (6_000, 650, 280, 380, 160, 850, 250, 11_000),
    "deep": (5_200, 520, 220, 320, 140, 700, 220, 9_000),
}


def profile_table(spark: SparkSession, profiles: Mapping[str, Sequence[int]]) -> DataFrame:
    return spark.createDataFrame([(name, *knobs) for name, knobs in profiles.items()], "profile string, " + ", ".join(f"{k} int" for k in KNOBS))


def structural_plan(messages: DataFrame, target_tokens: int = 8_000, levers: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """What structural compression does to every message, without its text.

    With ``profiles`` (see `profile_table`, a small table) there is one plan
    per profile and session, and ``session_id`` is the pair of both; what
    does not hang on the profile (pairs, hashes, sizes, zones) is found once.

    ``levers`` (session_id, trunc2, assist_cap, tail_cap) are those of the
    session's last round: a lever once pulled stays so. Sessions without a
    user message have nowhere to put a digest and stay whole.

    Columns: session_id, msg_idx, role, call_id, call_idx, item (an older
    interaction), duplicate, protected, dropped, the session levers trunc2 /
    assist_cap / tail_cap, the zones, planned_chars. The steps depend on each
    other, so the slim table is written to the scratch folder between them;
    texts are read once here and never shuffled.
    """
    knobs = {k: F.lit(target_tokens if k == "target_tokens" else value) if profiles is None else F.col(k) for k, value in KNOBS.items()}
    knob_columns = list(KNOBS) if profiles is not None else []
    target = knobs["target_tokens"] * T.CHARS_PER_TOKEN
    relief = F.floor(target * PRESSURE_RELIEF)
    slim = through_parquet(messages.select(
        "session_id", "msg_idx", "role", "call_id", *[c for c in ("calls",) if c in messages.columns],
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("cost"),
        F.when(S.is_result(), S.content_key(F.col("text"))).alias("_key"),
        (S.is_result() & T.has_error(F.col("text"))).alias("_error")), "structural-messages")

    paired = S.pair_calls(slim).select("session_id", F.col("result_idx").alias("msg_idx"), "call_idx")
    rows = slim.drop("calls").join(paired, ["session_id", "msg_idx"], "left")
    newest = keep_first(rows.where(S.is_result()).select("session_id", "msg_idx", "call_idx"),
                        ["session_id"], [F.col("msg_idx").desc()], KEEP_RECENT, rank_col="_r")
    tail = newest.groupBy("session_id").agg(
        F.min(F.least("msg_idx", "call_idx")).alias("tail_from"),
        F.min("msg_idx").alias("tail_results_from"),
        F.min(F.when(F.col("_r") <= UNTOUCHABLE, F.col("msg_idx"))).alias("untouchable_from"))
    facts = slim.groupBy("session_id").agg(
        F.max("msg_idx").alias("last_idx"), F.min(F.when(F.col("role") == "user", F.col("msg_idx"))).alias("first_user"))
    facts = facts.join(tail, "session_id", "left").withColumn(
        "tail_from", F.coalesce("tail_from", F.greatest(F.col("first_user") + 1, F.col("last_idx") - 7)))
    if levers is not None:
        facts = facts.join(levers.select("session_id", *[F.col(x).alias(f"_was_{x}") for x in LEVERS]), "session_id", "left")
    facts = facts.withColumns({f"_was_{x}": F.coalesce(f"_was_{x}", F.lit(False)) if levers is not None else F.lit(False) for x in LEVERS})
    rows = S.attach_session(rows, facts)
    item = S.is_result() & F.coalesce(F.col("msg_idx") < F.col("tail_from"), F.lit(False))
    rows = rows.withColumns({"item": item, "protected": item & F.col("_error")})
    rows = through_parquet(rows, "structural-items")

    # copies hang on the session alone: found and written as flags once, before the profiles fan out
    keys = rows.where("item").select("session_id", "msg_idx", "_key")
    droppable = F.col("item") & F.col("call_id").isNotNull() & F.col("call_idx").isNotNull()
    duplicate = F.col("item") & F.col("_newest").isNull()
    rows = rows.join(S.newest_of_key(keys, "_key", "_newest"), ["session_id", "msg_idx"], "left").withColumns(
        {"duplicate": duplicate, "droppable": droppable, "_pre": duplicate & droppable}).drop("_newest", "_key", "_error")
    rows = through_parquet(rows, "structural-flags")
    if profiles is not None:
        rows = rows.crossJoin(F.broadcast(profiles)).withColumn("session_id", F.struct("profile", "session_id")).drop("profile")
    early = (F.col("role") == "assistant") & (F.col("msg_idx") < F.col("tail_from"))
    late = (F.col("role") == "assistant") & ~early & (F.col("msg_idx") <= F.col("last_idx") - UNTOUCHABLE)
    tail_result = S.is_result() & ~F.col("item") & (F.col("msg_idx") >= F.col("tail_results_from")) & (
        F.col("msg_idx") < F.col("untouchable_from"))
    mid_small = F.least(F.col("cost"), knobs["small_head"] + knobs["small_tail"] + 80)
    assistant_size = F.least(F.col("cost"), knobs["assist_head"] + knobs["assist_tail"] + 80)
    was = {x: F.col(f"_was_{x}") for x in LEVERS}
    capped = (F.when(F.col("protected"), F.least(F.col("cost"), F.lit(PROTECTED_CAP + 80))).when(was["trunc2"], mid_small)
              .otherwise(F.least(F.col("cost"), knobs["mid_head"] + knobs["mid_tail"] + 80)))
    plain = (F.when(F.col("item"), capped).when(tail_result & was["tail_cap"], F.least(F.col("cost"), knobs["tail_cap_chars"]))
             .when(S.is_result(), F.least(F.col("cost"), F.lit(ABSOLUTE_CAP)))
             .when((early & (was["assist_cap"] | was["tail_cap"])) | (late & was["tail_cap"]), assistant_size).otherwise(F.col("cost")))
    rows = rows.withColumn("_plain", plain)

    # planned size before any budget drop, and what is already gone
    pre = F.count_if(F.col("_pre"))
    base = rows.groupBy("session_id").agg(
        pre.alias("pre_dropped"),
        (F.sum(F.when(F.col("_pre"), 0).otherwise(F.col("_plain"))) + F.least(pre, F.lit(DIGEST_ENTRIES)) * DIGEST_ENTRY_CHARS)
        .alias("planned"), target.alias("target") if profiles is None else F.first(target).alias("target"),
        relief.alias("relief") if profiles is None else F.first(relief).alias("relief"))
    # only sessions over the target give up more than their duplicates
    candidates = S.attach_session(rows.where("droppable AND NOT _pre").select("session_id", "msg_idx", "protected", "_plain"),
                                  base.where(F.col("planned") > F.col("target"))).where("planned IS NOT NULL").select(
        "session_id", "msg_idx", F.col("protected").cast("long").alias("_p"), F.col("_plain").alias("saving"), "planned",
        "pre_dropped", "relief", "target")
    ordered = positions(candidates, ["session_id"], F.struct("_p", F.floor(F.col("msg_idx") / 65_536)), ["_p", "msg_idx"], "pos")
    dropped = S.budget_drop(ordered, "relief", "target", DIGEST_ENTRIES, DIGEST_ENTRY_CHARS).where("dropped").select(
        "session_id", "msg_idx", F.lit(True).alias("_drop"))
    rows = rows.join(dropped, ["session_id", "msg_idx"], "left").withColumn(
        "dropped", F.col("_pre") | F.coalesce("_drop", F.lit(False))).drop("_drop")
    rows = through_parquet(rows, "structural-drops")

    # three further levers, each tried only while the plan is still over the target
    free = F.col("item") & ~F.col("protected") & ~F.col("dropped")
    gains = {
        "trunc2": F.when(free, F.col("_plain") - mid_small), "assist_cap": F.when(early, F.col("_plain") - assistant_size),
        "tail_cap": F.when(late, F.col("_plain") - assistant_size).when(tail_result, F.col("_plain") - F.least(F.col("cost"), knobs["tail_cap_chars"]))}
    n_dropped = F.count_if(F.col("dropped"))
    sums = rows.groupBy("session_id").agg(
        (F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("_plain")))
         + F.least(n_dropped, F.lit(DIGEST_ENTRIES)) * DIGEST_ENTRY_CHARS).alias("planned_chars"),
        *[F.coalesce(F.sum(e), F.lit(0)).alias(f"_g_{n}") for n, e in gains.items()], *[F.bool_or(was[x]).alias(f"_was_{x}") for x in LEVERS],
        *[F.first(k).alias(k) for k in knob_columns])
    # what a lever saves is nothing where it was pulled before
    for lever in LEVERS:
        sums = sums.withColumn(lever, was[lever] | (F.col("planned_chars") > target)).withColumn(
            "planned_chars", F.col("planned_chars") - F.when(F.col(lever), F.col(f"_g_{lever}")).otherwise(0))
    sums = sums.select("session_id", *LEVERS, "planned_chars")
    return S.attach_session(rows.drop(*[f"_was_{x}" for x in LEVERS]), sums).withColumns({"early": early, "late": late, "tail_result": tail_result})


def digest_entries(dropped: DataFrame, calls: DataFrame) -> DataFrame:
    """One line per dropped interaction: tool(args) -> snippet | files not shown in the snippet.

    ``dropped``: session_id, msg_idx, text, call_id, duplicate, and call_idx
    where ids are used again. ``calls``: session_id, call_id, tool, args, and
    then call_idx.
    """
    keys = ["session_id", "call_id"] + (["call_idx"] if "call_idx" in dropped.columns else [])
    joined = dropped.join(calls, keys, "left")
    flat = T.collapse_whitespace(F.coalesce("text", F.lit("")))
    snippet = T.clip(flat, DIGEST_RESULT_CHARS)
    unseen = F.slice(F.filter(T.paths(flat), lambda p: ~F.contains(snippet, p)), 1, DIGEST_PATHS)
    listed = F.when(F.size(unseen) > 0, F.concat(F.lit(" | files: "), F.array_join(
        F.transform(unseen, lambda p: T.clip(p, 80)), ", "))).otherwise(F.lit(""))
    shown = F.when(F.col("duplicate"), "[duplicate of a later identical result]").otherwise(F.concat(snippet, listed))
    args = T.clip(T.collapse_whitespace(F.coalesce("args", F.lit(""))), DIGEST_ARGS_CHARS)
    call = F.concat(F.coalesce("tool", F.lit("tool")), F.lit("("), args, F.lit(")"))
    return joined.select("session_id", "msg_idx", F.rtrim(F.concat(F.lit("- "), call, F.lit(" -> "), shown)).alias("entry"))


def session_digest(entries: DataFrame) -> DataFrame:
    """Newest forty entries of a session, oldest first."""
    newest = keep_first(entries, ["session_id"], [F.col("msg_idx").desc()], DIGEST_ENTRIES)
    return newest.groupBy("session_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("msg_idx", "entry"))), lambda e: e["entry"]).alias("entries"))


def merge_digest(text: Column, entries: Column) -> Column:
    """Text of the first user message with its digest block renewed: old entries, then new ones, newest forty."""
    start = F.instr(text, DIGEST_BEGIN)
    block = F.substring(text, start, F.length(text))
    segment = F.substring_index(block, DIGEST_END, 1)
    old = F.filter(F.transform(F.split(segment, "\n", -1), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("- ")))
    # the block ends at the first end mark behind its begin
    end = F.locate(DIGEST_END, block)
    after = F.when(end > 0, F.substring(block, end + len(DIGEST_END), F.length(block))).otherwise(F.lit(""))
    bare = F.when(start > 0, F.concat(F.substring(text, F.lit(1), start - 1), after)).otherwise(text)
    listed = F.concat(F.when(start > 0, old).otherwise(F.array().cast("array<string>")),
                      F.coalesce(entries, F.array().cast("array<string>")))
    newest = F.slice(listed, F.greatest(F.lit(1), F.size(listed) - DIGEST_ENTRIES + 1), F.lit(DIGEST_ENTRIES))
    renewed = F.concat_ws("\n", F.lit(DIGEST_HEADER), F.array_join(newest, "\n"), F.lit(DIGEST_END))
    body = F.regexp_replace(bare, r"(?U)\s+$", "")
    return F.when(F.size(listed) > 0, F.concat(body, F.lit("\n\n"), renewed)).otherwise(F.when(start > 0, body).otherwise(text))


def compress_structural(messages: DataFrame, target_tokens: int = 8_000, levers: DataFrame | None = None) -> DataFrame:
    """Recent tail kept, older interactions dropped or truncated to the target, digest in the first user message.

    Sessions without a user message come back whole.
    """
    plan = through_parquet(structural_plan(messages, target_tokens, levers).select(
        "session_id", "msg_idx", "call_id", "call_idx", "item", "duplicate", "protected", "dropped", *LEVERS, "early", "late",
        "tail_result", "untouchable_from", "first_user"), "structural-plan")
    return _shape(messages, plan)


def sweep_structural(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Structural compression of every session under every profile: (profile, and the columns of the messages).

    One plan over all profiles; a text is fetched per profile only where its message is kept.
    """
    plan = through_parquet(structural_plan(messages, profiles=profiles).select(
        "session_id", "msg_idx", "call_id", "call_idx", "item", "duplicate", "protected", "dropped", *LEVERS, "early", "late",
        "tail_result", "untouchable_from", "first_user", *KNOBS), "structural-sweep")
    each = profiles.select("profile")
    widened = messages.crossJoin(F.broadcast(each)).withColumn("session_id", F.struct("profile", "session_id")).drop("profile")
    out = _shape(widened, plan, {k: F.col(k) for k in KNOBS})
    return out.select("session_id.profile", F.col("session_id.session_id").alias("session_id"), *[c for c in messages.columns if c != "session_id"])


def _shape(messages: DataFrame, plan: DataFrame, knobs: Mapping[str, Column] | None = None) -> DataFrame:
    """Carry out a plan: texts are fetched and cut, stripped calls leave their messages, the digest is renewed."""
    knobs = knobs or {k: F.lit(value) for k, value in KNOBS.items()}
    homed = F.col("first_user").isNotNull()
    calls = S.calls_of(messages).select("session_id", F.col("msg_idx").alias("call_idx"), "call_id", "tool", "args").dropDuplicates(
        ["session_id", "call_idx", "call_id"])
    gone = plan.where(homed & F.col("dropped"))
    # the digest shows the newest forty, so only their texts are fetched
    shown = keep_first(gone.select("session_id", "msg_idx", "call_id", "call_idx", "duplicate"), ["session_id"], [F.col("msg_idx").desc()], DIGEST_ENTRIES)
    texts = shown.join(messages.select("session_id", "msg_idx", "text"), ["session_id", "msg_idx"])
    digest = session_digest(digest_entries(texts, calls))
    # calls whose results went; every other call of their messages stays
    answered = gone.select("session_id", "call_idx", "call_id").distinct()
    touched = answered.join(calls, ["session_id", "call_idx", "call_id"], "left_semi").select(
        "session_id", F.col("call_idx").alias("msg_idx")).distinct().withColumn("_strip", F.lit(True))
    left = calls.join(answered, ["session_id", "call_idx", "call_id"], "left_anti").select("session_id", F.col("call_idx").alias("msg_idx"), "call_id")
    kept = (plan.drop("call_id").where(~homed | ~F.col("dropped")).join(touched, ["session_id", "msg_idx"], "left")
            .join(messages, ["session_id", "msg_idx"])).withColumn("_strip", F.coalesce("_strip", F.lit(False)) & (F.col("role") == "assistant"))
    kept = S.keep_calls(kept, left, F.col("_strip"))
    # an assistant message whose only content was the stripped calls disappears
    kept = kept.where(~(F.col("_strip") & ~S.makes_calls(kept) & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    t = F.col("text")
    share = lambda cap: T.head_tail(t, F.floor(F.lit(cap) * 0.75).cast("int"), F.floor(F.lit(cap) * 0.25).cast("int"))
    assistant = T.head_tail(t, knobs["assist_head"], knobs["assist_tail"])
    text = (
        F.when(~homed, t).when(F.col("item") & F.col("protected"), share(PROTECTED_CAP))
        .when(F.col("item") & F.col("trunc2"), T.head_tail(t, knobs["small_head"], knobs["small_tail"]))
        .when(F.col("item"), T.head_tail(t, knobs["mid_head"], knobs["mid_tail"]))
        .when(F.col("tail_result") & F.col("tail_cap"), share(knobs["tail_cap_chars"]))
        .when(S.is_result() & (F.col("msg_idx") < F.col("untouchable_from")), share(ABSOLUTE_CAP))
        .when(F.col("early") & (F.col("assist_cap") | F.col("tail_cap")), assistant)
        .when(F.col("late") & F.col("tail_cap"), assistant)
        .otherwise(t))
    shaped = kept.select(*[text.alias(c) if c == "text" else F.col(c) for c in messages.columns], "first_user")
    # the digest is keyed by the position of the first user message, one row per session
    homes = plan.where("msg_idx = first_user").select("session_id", "msg_idx").join(digest, "session_id", "left").withColumn(
        "_home", F.lit(True))
    out = shaped.join(homes, ["session_id", "msg_idx"], "left")
    merged = F.when(F.col("_home"), merge_digest(F.col("text"), F.col("entries"))).otherwise(F.col("text"))
    return out.withColumn("text", merged).select(*messages.columns)


def compress(messages: DataFrame, modes: DataFrame, target_tokens: int = 8_000) -> DataFrame:
    """Sessions by mode: structural for harvest, gentle caps for rich and flip, guard for all."""
    tagged = messages.join(modes.select("session_id", "mode"), "session_id", "left")
    cols = messages.columns
    pick = lambda m: tagged.where(F.col("mode") == m).select(*cols)
    whole = tagged.where("mode IS NULL OR mode = 'passthrough'").select(*cols)
    out = whole.unionByName(compress_structural(pick("harvest"), target_tokens).select(*cols))
    out = out.unionByName(compress_gentle(pick("rich")).select(*cols))
    out = out.unionByName(compress_gentle(pick("flip"), 12_000, 40_000, 14).select(*cols))
    return S.with_guard(messages, out)


def audit(before: DataFrame, after: DataFrame, markers: Sequence[str] = (), shown: tuple[int | None, int | None] = AUDIT_CHARS) -> DataFrame:
    """Per session: tokens in and out, ratio, user messages kept, newest result kept, orphan guard, markers kept.

    A message is kept if the output at its position shows its beginning:
    ``shown`` characters of a user message and of the newest result, None for
    the whole text.

    ``markers_kept`` tells whether every marker that the session's input
    shows is shown by its output too; null where it shows none.
    """
    # the compressed side is read by every check, so it is computed once
    after = through_parquet(after.select("session_id", "msg_idx", "role", "text", "call_id", *[c for c in ("calls",) if c in after.columns]), "audited")
    # of the input only what user messages and results have to show is written; sizes and markers, of whole texts, are taken along
    user_text, result_text = [F.col("text") if n is None else F.substring("text", 1, n) for n in shown]
    shows = [F.contains(F.coalesce("text", F.lit("")), F.lit(m)).alias(f"_m{i}") for i, m in enumerate(markers)]
    length = F.coalesce(F.length("text"), F.lit(0)).alias("_size")
    text = F.when(F.col("role") == "user", user_text).when(S.is_result(), result_text)
    before = through_parquet(before.select("session_id", "msg_idx", "role", text.alias("text"), "call_id",
                                           *[c for c in ("calls",) if c in before.columns], length, *shows), "audited-input")
    size = lambda df, name: df.groupBy("session_id").agg(
        F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("_size") / T.CHARS_PER_TOKEN)).alias(name))
    users = before.where("role = 'user'").select("session_id", "msg_idx", F.col("text").alias("_snip"))
    kept = users.join(after.where("role = 'user'").select("session_id", "msg_idx", F.col("text").alias("_out")),
                      ["session_id", "msg_idx"], "left").groupBy("session_id").agg(
        F.bool_and(F.coalesce(F.contains("_out", F.col("_snip")), F.lit(False))).alias("users_kept"))
    results = before.where(S.is_result())
    if shown[1] is None:
        # whole texts are fetched for the newest position only
        newest = results.groupBy("session_id").agg(F.max("msg_idx").alias("msg_idx"))
        texts = results.join(newest, ["session_id", "msg_idx"], "left_semi").groupBy("session_id", "msg_idx").agg(F.first("text").alias("_snip"))
        newest = newest.join(texts, ["session_id", "msg_idx"], "left")
    else:
        newest = results.groupBy("session_id").agg(F.max("msg_idx").alias("msg_idx"), F.max_by("text", "msg_idx").alias("_snip"))
    newest = newest.join(after.select("session_id", "msg_idx", F.col("text").alias("_out")), ["session_id", "msg_idx"], "left").select(
        "session_id", F.coalesce(F.contains("_out", F.col("_snip")), F.lit(False)).alias("newest_kept"))
    guard = S.orphan_guard(before, after).select("session_id", F.col("ok").alias("guard_ok"), "new_orphans")
    out = size(before, "tokens_in").join(size(after.select("session_id", length), "tokens_out"), "session_id", "left")
    if markers:
        shown = lambda df, side: df.groupBy("session_id").agg(*[
            F.bool_or(f"_m{i}").alias(f"_{side}{i}") for i in range(len(markers))])
        both = shown(before, "in").join(shown(after.select("session_id", *shows), "out"), "session_id", "left")
        some = reduce(lambda a, b: a | b, [F.col(f"_in{i}") for i in range(len(markers))])
        all_kept = reduce(lambda a, b: a & b, [~F.col(f"_in{i}") | F.coalesce(f"_out{i}", F.lit(False)) for i in range(len(markers))])
        out = out.join(both.select("session_id", F.when(some, all_kept).alias("markers_kept")), "session_id", "left")
    else:
        out = out.withColumn("markers_kept", F.lit(None).cast("boolean"))
    return (out.join(kept, "session_id", "left").join(newest, "session_id", "left").join(guard, "session_id", "left")
            .withColumn("ratio", F.col("tokens_in") / F.nullif("tokens_out", F.lit(0)))
            .withColumn("savings", 1 - F.coalesce("tokens_out", F.lit(0)) / F.col("tokens_in")))


def sweep(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Gentle compression of every session under every profile.

    ``profiles``: profile, stale_cap, protected_cap, intact (a small knob
    table). Copies and session ends are found once and shared by all profiles,
    and so are the error mark and the ranked lines of every text that some
    profile may cut: a profile adds only its own budget.
    """
    results = messages.where(S.is_result()).select("session_id", "msg_idx", S.content_key(F.col("text")).alias("_exact"))
    newest = S.newest_of_key(results, "_exact", "_newest")
    last = messages.groupBy("session_id").agg(F.max("msg_idx").alias("_last"))
    tagged = S.attach_session(messages, last).join(newest, ["session_id", "msg_idx"], "left")
    least = profiles.agg(F.min(F.least("stale_cap", "protected_cap")).alias("_cap"), F.min("intact").alias("_intact"))
    cuttable = (S.is_result() & (F.col("msg_idx") <= F.col("_last") - F.col("_intact")) & F.col("_newest").isNotNull()
                & (F.length("text") > F.col("_cap")))
    tagged = tagged.crossJoin(F.broadcast(least)).withColumns({
        "_error": F.when(cuttable, T.has_error(F.col("text"))), "_ranked": F.when(cuttable, ranked_lines(F.split("text", "\n", -1)))})
    widened = tagged.crossJoin(F.broadcast(profiles.select("profile", "stale_cap", "protected_cap", "intact")))
    old = S.is_result() & (F.col("msg_idx") <= F.col("_last") - F.col("intact"))
    cap = F.when(F.col("_error"), F.col("protected_cap")).otherwise(F.col("stale_cap"))
    text = (F.when(~old, F.col("text")).when(F.col("_newest").isNull(), DUPLICATE_MARK)
            .when(F.length("text") <= cap, F.col("text")).otherwise(extractive_compress(F.col("text"), cap, F.col("_ranked"))))
    return widened.select("profile", "session_id", "msg_idx", "role", text.alias("text"), F.col("text").alias("text_in"))


def savings_by_mode(audited: DataFrame) -> DataFrame:
    """Mean, least and largest savings per mode, p95 of the input size."""
    sums = audited.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), F.avg("savings").alias("mean_savings"), F.min("savings").alias("min_savings"),
        F.max("savings").alias("max_savings"))
    return sums.join(quantiles(audited, ["mode"], "tokens_in", {"p95_tokens": 0.95}), "mode", "left")


def latency_summary(times: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Mean, p95 and largest latency; p95 is the value at rank floor(0.95 n), the last one if that is zero."""
    sums = times.agg(F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds"))
    rank = lambda n: F.when(F.floor(n * F.lit(0.95)) > 0, F.floor(n * F.lit(0.95))).otherwise(n)
    at = values_at(times, [], seconds, {"p95_seconds": rank}).select("n", "p95_seconds")
    return sums.join(F.broadcast(at), how="left").select(F.coalesce("n", F.lit(0)).alias("n"), "mean_seconds", "p95_seconds", "max_seconds")
