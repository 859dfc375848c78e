"""Structured Streaming jobs: latest state, rate windows, leaderboards, idempotent ingest.

Every job has a batch twin that gives the same result on the whole table. A
micro-batch is reduced to its own partial state, which a `FoldedTable` keeps;
rows that are results as they stand go to an `AppendTable`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.values import seconds_to_next_day, seconds_to_next_minute
from runledger.streaming.tables import AppendTable, FoldedTable, drain


# what an entity last reported, each with the beat that carried it
KEPT = ("version", "model")
STATE = ("entity bigint, status string, seen_at timestamp, seen_beat bigint, "
         + "".join(f"{c} string, {c}_at timestamp, {c}_beat bigint, " for c in KEPT) + "n_beats bigint")
HISTORY = "entity bigint, status string, ts timestamp, beat_id bigint"


def heartbeat_parts(beats: DataFrame) -> DataFrame:
    """State of a batch: status, version and model, each with the beat that carried it.

    Beats: entity, status, version, model, ts, beat_id.
    """
    at = F.struct("ts", "beat_id")
    given = {c: F.when(F.col(c).isNotNull(), at) for c in KEPT}
    return beats.groupBy("entity").agg(
        F.max_by("status", at).alias("status"), F.max(at).alias("seen"), F.count(F.lit(1)).alias("n_beats"),
        *[F.max_by(c, given[c]).alias(c) for c in KEPT], *[F.max(given[c]).alias(f"_{c}") for c in KEPT]).select(
        "entity", "status", F.col("seen.ts").alias("seen_at"), F.col("seen.beat_id").alias("seen_beat"),
        *[x for c in KEPT for x in (F.col(c), F.col(f"_{c}.ts").alias(f"{c}_at"), F.col(f"_{c}.beat_id").alias(f"{c}_beat"))], "n_beats")


def heartbeat_view(state: DataFrame) -> DataFrame:
    return state.select("entity", "status", F.col("seen_at").alias("last_seen"), *KEPT, "n_beats")


def heartbeat_state(beats: DataFrame) -> DataFrame:
    """Latest status per entity; version and model keep their last known value."""
    return heartbeat_view(heartbeat_parts(beats))


def fold_heartbeats(states: DataFrame) -> DataFrame:
    """States of several batches as one, late beats included: the newest status and known values win, counts add up."""
    seen = F.struct("seen_at", "seen_beat")
    given = {c: F.when(F.col(c).isNotNull(), F.struct(f"{c}_at", f"{c}_beat")) for c in KEPT}
    return states.groupBy("entity").agg(
        F.max_by("status", seen).alias("status"), F.max(seen).alias("seen"), F.sum("n_beats").alias("n_beats"),
        *[F.max_by(c, given[c]).alias(c) for c in KEPT], *[F.max(given[c]).alias(f"_{c}") for c in KEPT]).select(
        "entity", "status", "seen.*", *[x for c in KEPT for x in (c, f"_{c}.*")], "n_beats")


def follow_heartbeats(beats: DataFrame, state: FoldedTable, history: AppendTable, checkpoint: str) -> None:
    """Drain a stream of beats: latest state per entity, and every beat into the history."""

    def commit(batch: DataFrame, n: int) -> None:
        state.commit(n, heartbeat_parts(batch))
        history.commit(n, batch.select("entity", "status", F.col("ts").cast("timestamp").alias("ts"), "beat_id"))

    drain(beats, commit, checkpoint)


WINDOWS = "key_id bigint, unit string, bucket timestamp, n bigint, last_ts timestamp"
LATE = "key_id bigint, ts timestamp"


def window_counts(requests: DataFrame) -> DataFrame:
    """Requests (key_id, ts) counted per key by minute and by day, in one pass (two window rows per request, combined map-side)."""
    sized = requests.select("key_id", "ts", F.explode(F.array(*[
        F.struct(F.lit(unit).alias("unit"), F.date_trunc(unit, "ts").alias("bucket")) for unit in ("minute", "day")])).alias("w"))
    return sized.groupBy("key_id", "w.unit", "w.bucket").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def rate_windows(requests: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Windows over the limit: count and retry-after per key, by minute and by day."""
    return over_limit(window_counts(requests), per_minute, per_day)


def over_limit(counted: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    wait = F.when(F.col("unit") == "minute", seconds_to_next_minute(F.col("last_ts"))).otherwise(seconds_to_next_day(F.col("last_ts")))
    cap = F.when(F.col("unit") == "minute", per_minute).otherwise(per_day)
    return counted.where(F.col("n") > cap).select("key_id", "unit", "bucket", "n", wait.alias("retry_after"))


def fold_windows(states: DataFrame) -> DataFrame:
    return states.groupBy("key_id", "unit", "bucket").agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


def follow_requests(requests: DataFrame, windows: FoldedTable, late: AppendTable, checkpoint: str, lateness_seconds: int) -> None:
    """Drain a stream of requests into window counts.

    A request that is older than the newest one of earlier batches by more
    than the lateness is kept aside, as it stands, and counts nowhere.
    """

    def commit(batch: DataFrame, n: int) -> None:
        newest = windows.current(before=n).agg(F.max("last_ts")).first()[0]
        old = F.lit(False) if newest is None else F.unix_micros("ts") < F.unix_micros(F.lit(newest)) - lateness_seconds * 1_000_000
        late.commit(n, batch.where(old).select("key_id", "ts"))
        windows.commit(n, window_counts(batch.where(~old)))

    drain(requests, commit, checkpoint)


BOARD = "entity bigint, n bigint, total double, best double"


def board_partials(events: DataFrame) -> DataFrame:
    """Additive leaderboard parts per entity. Events: entity, value."""
    return events.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("best"))


def fold_board(states: DataFrame) -> DataFrame:
    return states.groupBy("entity").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def follow_board(events: DataFrame, board: FoldedTable, checkpoint: str) -> None:
    """Refresh with every batch: only the batch is touched, never the history."""
    drain(events, lambda batch, n: board.commit(n, board_partials(batch)), checkpoint)


def board_view(parts: DataFrame) -> DataFrame:
    return parts.select("entity", "n", (F.col("total") / F.col("n")).alias("mean"), "best")


def ingest_stream(rows: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Duplicates inside the lateness bound disappear before anything is written."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep_newest(keys: list[str], ts: str, tie: str) -> Callable[[DataFrame], DataFrame]:
    """Newest row per key, earlier scan on equal timestamps; of a batch and of several batches alike."""
    from runledger.operators.dedup import newest

    return lambda rows: newest(rows, keys, ts, [tie])


def follow_newest(rows: DataFrame, table: FoldedTable, checkpoint: str) -> None:
    """Drain a stream of keyed rows; a batch keeps its own newest ones."""
    names = [f.name for f in table.spark.createDataFrame([], table.schema).schema]
    drain(rows, lambda batch, n: table.commit(n, table.fold(batch.select(*names))), checkpoint)


def follow_sessions(outputs: DataFrame) -> DataFrame:
    """Batch twin over message rows (session_id, call_no, msg_idx, role, text)."""
    from runledger.operators.sessions import prefix_stability

    sizes = outputs.groupBy("session_id", "call_no").agg(F.count(F.lit(1)).alias("n_messages"))
    stable = prefix_stability(outputs).select("session_id", "call_no", (F.col("common_prefix") >= F.col("n_previous")).alias("ok"),
                                              "n_previous")
    continued = F.coalesce("ok", F.lit(False))
    return sizes.join(stable, ["session_id", "call_no"], "left").select(
        "session_id", "call_no", continued.alias("continued"), "n_messages",
        (F.col("n_messages") - F.when(continued, F.col("n_previous")).otherwise(0)).alias("new_messages"))
