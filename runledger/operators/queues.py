"""Work selection: latest scripts, pending work, dispatch order, competition lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.scale import keep_first, positions
from runledger.session import through_parquet

# Look-ups (instants times levels, three short values each) that an interval join sends to every task.
SENT_LOOKUPS = 250_000


def latest_scripts(uploads: DataFrame, keys: tuple[str, ...] = ("entrant_id",)) -> DataFrame:
    """Newest upload per entrant by (created_at, upload_id)."""
    return keep_first(uploads, list(keys), [F.col("created_at").desc(), F.col("upload_id").desc()])


def eligible_scripts(uploads: DataFrame, api_keys: DataFrame, entrants: DataFrame) -> DataFrame:
    """Uploads of entrants that hold an unrevoked key and are not banned (semi joins only)."""
    active = api_keys.where("revoked_at IS NULL").select("entrant_id")
    return (uploads.join(active, "entrant_id", "left_semi")
            .join(entrants.where("banned = false").select("entrant_id"), "entrant_id", "left_semi"))


def latest_eligible_script(uploads: DataFrame, api_keys: DataFrame, entrants: DataFrame) -> DataFrame:
    """First eligible script per (competition, entrant), newest upload first."""
    return latest_scripts(eligible_scripts(uploads, api_keys, entrants), ("competition_id", "entrant_id"))


def dispatch_queue(runs: DataFrame, tasks: DataFrame, uploads: DataFrame, api_keys: DataFrame,
                   entrants: DataFrame, n: int) -> DataFrame:
    """Pending runs in dispatch order: baselines, then by first upload of the script, age, id."""
    first_upload = uploads.groupBy("script_id", "competition_id").agg(F.min("created_at").alias("first_upload_at"))
    allowed = (eligible_scripts(uploads, api_keys, entrants)
               .select("entrant_id", "script_id", "competition_id").distinct()
               .withColumn("_ok", F.lit(True)))
    pending = runs.where("status = 'pending'").join(
        tasks.select("task_id", "competition_id", "is_screener"), "task_id")
    named = (pending.join(first_upload, ["script_id", "competition_id"], "left")
             .join(allowed, ["entrant_id", "script_id", "competition_id"], "left")
             .where("baseline_run OR _ok"))
    queued = named.select(
        "run_id", "task_id", "competition_id", "attempt_no", "baseline_run",
        F.when(~F.col("baseline_run"), F.col("first_upload_at")).alias("first_upload_at"), "created_at")
    return queued.orderBy(F.col("baseline_run").desc(), F.col("first_upload_at").asc_nulls_last(),
                          F.col("created_at").asc(), F.col("run_id").asc()).limit(n)


def missing_runs(tasks: DataFrame, runs: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Planned (task, attempt) pairs that do not exist yet.

    With ``scripts`` (entrant_id, script_id, competition_id) the plan is per
    script; without, it is the baseline plan.
    """
    plan = tasks.select("task_id", "competition_id", F.explode(F.sequence(
        F.lit(1), F.greatest(F.lit(1), F.coalesce("planned_repeats", F.lit(1))))).alias("attempt_no"))
    if scripts is None:
        have = runs.where("baseline_run").select("task_id", "attempt_no")
        return plan.join(have, ["task_id", "attempt_no"], "left_anti")
    plan = plan.join(scripts, "competition_id")
    have = runs.where("NOT baseline_run").select("task_id", "attempt_no", "entrant_id", "script_id")
    return plan.join(have, ["task_id", "attempt_no", "entrant_id", "script_id"], "left_anti")


def filter_pairs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs whose (entrant, script) is in the list."""
    return runs.join(pairs.select("entrant_id", "script_id"), ["entrant_id", "script_id"], "left_semi")


def unassigned_challenges(challenges: DataFrame, items: DataFrame, scripts: DataFrame, limit: int) -> DataFrame:
    """Per script the first ``limit`` challenges it has neither been assigned nor scored on.

    ``challenges``: competition_id, challenge_id. ``items``: script_id,
    challenge_id (assigned or scored). ``scripts``: script_id, competition_id.
    """
    open_items = scripts.join(challenges, "competition_id").join(
        items.select("script_id", "challenge_id"), ["script_id", "challenge_id"], "left_anti")
    return keep_first(open_items, ["script_id"], [F.col("challenge_id")], limit)


def open_work(items: DataFrame, scores: DataFrame, assignments: DataFrame) -> DataFrame:
    """Items that carry neither a score nor an assignment of their batch."""
    return items.join(scores.select("item_id"), "item_id", "left_anti").join(
        assignments.select("batch_id"), "batch_id", "left_anti")


def has_screener_work(status: DataFrame, items: DataFrame, scores: DataFrame, assignments: DataFrame,
                      screeners: DataFrame) -> DataFrame:
    """Entrants with unfinished screener counters or unclaimed screener items."""
    unclaimed = open_work(items, scores, assignments).join(
        screeners.select("challenge_id"), "challenge_id", "left_semi").select("entrant_id").distinct()
    counters = (F.coalesce("scored_screener", F.lit(0)) + F.coalesce("pending_screener", F.lit(0))
                < F.coalesce("n_screener", F.lit(0)))
    return _either(status, unclaimed, counters)


def has_competition_work(status: DataFrame, items: DataFrame, scores: DataFrame, assignments: DataFrame,
                         active_links: DataFrame, screeners: DataFrame) -> DataFrame:
    """Same for the competition phase: actively linked challenges that are not screeners."""
    unclaimed = (open_work(items, scores, assignments)
                 .join(active_links.select("challenge_id"), "challenge_id", "left_semi")
                 .join(screeners.select("challenge_id"), "challenge_id", "left_anti")
                 .select("entrant_id").distinct())
    counters = (F.coalesce("scored_competition", F.lit(0)) + F.coalesce("pending_competition", F.lit(0))
                < F.coalesce("n_competition", F.lit(0)))
    return _either(status, unclaimed, counters)


def _either(status: DataFrame, unclaimed: DataFrame, counters: Column) -> DataFrame:
    flagged = status.join(unclaimed.withColumn("_open", F.lit(True)), "entrant_id", "left")
    return flagged.withColumn("has_work", counters | F.coalesce("_open", F.lit(False))).drop("_open")


def next_entrant(candidates: DataFrame) -> DataFrame:
    """Earliest last submission that still has work."""
    return candidates.where("has_work").orderBy(F.col("last_submit").asc_nulls_last(), F.col("entrant_id")).limit(1)


def activate_latest(links: DataFrame, n: int) -> DataFrame:
    """Latest ``n`` links active, all others inactive, with a flag on every change."""
    newest = links.orderBy(F.col("generated_at").desc(), F.col("challenge_id").desc(), F.col("link_id")).limit(n)
    marked = links.join(newest.select("link_id", F.lit(True).alias("_new")), "link_id", "left")
    target = F.coalesce("_new", F.lit(False))
    return marked.withColumn("new_active", target).withColumn("flipped", target != F.col("is_active")).drop("_new")


def active_at(df: DataFrame, instant: Column, start: str = "starts_at", end: str = "ends_at") -> DataFrame:
    """Rows whose closed interval contains the instant."""
    return df.where((F.col(start) <= instant) & (F.col(end) >= instant))


def dyadic_cells(low: Column, high: Column, levels: int) -> Column:
    """Cells (level, number) of doubling width that together make up the whole numbers from ``low`` to ``high``.

    At most two cells of each level; the last level takes what is left.
    """
    past = high + 1

    def cell(level: int, n: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), n.cast("long").alias("cell"))

    def from_to(level: int) -> tuple[Column, Column]:
        # first whole cell of the level and the one after the last
        return F.shiftright((low + (2**level - 1)).cast("long"), level), F.shiftright(past.cast("long"), level)

    some = []
    for level in range(levels):
        a, b = from_to(level)
        left = (a < b) & (a % 2 != 0)
        some += [F.when(left, cell(level, a)), F.when((F.when(left, a + 1).otherwise(a) < b) & (b % 2 != 0), cell(level, b - 1))]
    a, b = from_to(levels)
    rest = F.transform(F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>")), lambda n: cell(levels, n))
    return F.concat(F.array_compact(F.array(*some)), rest) if some else rest


def valid_at(instants: DataFrame, intervals: DataFrame, ts: str, start: str = "starts_at", end: str = "ends_at") -> DataFrame:
    """Interval join for many instants: pairs of an instant and a closed interval that contains it.

    An interval is cut into dyadic cells of seconds, O(log length) of them;
    an instant looks up the one cell of each level that holds it, up to the
    level of the longest interval. Cells of a pair are equal exactly where
    the interval covers the instant's second, so the equi join produces
    results only (times within the first and last second are tested).
    Up to ``SENT_LOOKUPS`` look-ups are sent to every task and no interval
    moves; more of them meet the cells in a shuffle.
    """
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    proper = intervals.where(F.col(start) <= F.col(end))
    longest = proper.agg(F.max(second(end) - second(start) + 1)).first()[0] or 1
    levels = max(0, int(longest).bit_length() - 1)
    # the cells read both seconds many times over
    seconds = proper.withColumns({"_low": second(start), "_high": second(end)})
    cut = seconds.withColumn("_c", F.explode(dyadic_cells(F.col("_low"), F.col("_high"), levels))).select(
        *intervals.columns, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    looked_up = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(
        k.alias("level"), F.floor(second(ts) / F.pow(F.lit(2.0), k)).alias("cell")))
    asked = through_parquet(instants, "instants")
    probed = asked.withColumn("_c", F.explode(looked_up)).select(*instants.columns, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    # Spark's size checks count a row once, not its cells: it would send all cells of a small-looking interval table through the driver
    few = asked.count() * (levels + 1) <= SENT_LOOKUPS
    return (F.broadcast(probed) if few else probed.hint("merge")).join(cut, ["_level", "_cell"]).where(
        (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_level", "_cell")


def previous_competition(comps: DataFrame) -> DataFrame:
    """For each competition the latest other one that starts strictly earlier.

    Starts are grouped first, so equal starts share their predecessor; the
    predecessor of a start is the one numbered just before it.
    """
    starts = comps.groupBy("upload_starts_at").agg(F.max("competition_id").alias("previous_id"))
    numbered = positions(starts, [], F.date_trunc("day", "upload_starts_at"), ["upload_starts_at"], "_pos")
    earlier = numbered.select((F.col("_pos") + 1).alias("_pos"), "previous_id", F.col("upload_starts_at").alias("previous_start"))
    prev = numbered.select("upload_starts_at", "_pos").join(earlier, "_pos", "left").drop("_pos")
    return comps.select("competition_id", "upload_starts_at").join(prev, "upload_starts_at")


def active_competition(comps: DataFrame, now: Column) -> DataFrame:
    """In its window now, else active with any window, else any active; newest start first."""
    inside = (F.col("upload_starts_at") <= now) & (F.col("eval_ends_at") >= now)
    priority = F.when(inside, 0).when(F.col("upload_starts_at").isNotNull(), 1).otherwise(2)
    return (comps.where("is_active").withColumn("priority", priority)
            .orderBy("priority", F.col("upload_starts_at").desc_nulls_last(), F.col("competition_id").desc())
            .limit(1))
