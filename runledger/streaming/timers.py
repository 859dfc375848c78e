"""Streams with event-time timers and keyed state: stale dispatches, leases, sessions.

Dispatches and leases come in two forms with the same rules. The set form
(`follow_dispatches`, `follow_leases`) keeps what a micro-batch brought in a
`FoldedTable` and decides by joins and aggregates what has run out at the
watermark; its cost is that of the rows. The processors emit every change as
its timer fires, at a few Python calls per key and batch: for small key sets
that want changes as they happen. Their state lies in Spark's state store, and
`transformWithState` needs the RocksDB provider (`use_rocksdb`). In all forms
the watermark decides, so results do not depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runledger.streaming.tables import AppendTable, FoldedTable, drain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MIN_TTL = 60


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and several state variables per key need this store; existing checkpoints keep the one they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def millis(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def keyed(rows: DataFrame, key: str, late: str, processor: StatefulProcessor, out: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, out, "Update", "EventTime")


MARKS = "newest timestamp"


def fold_marks(marks: DataFrame) -> DataFrame:
    return marks.agg(F.max("newest").alias("newest"))


def watermark_millis(marks: FoldedTable, late_seconds: int, before: int | None = None) -> int | None:
    """Newest event time less the lateness, over all batches or those numbered below ``before``; null before any row."""
    row = marks.current(before).select(F.unix_millis("newest")).first()
    return None if row is None or row[0] is None else row[0] - late_seconds * 1000


def follow_marked(rows: DataFrame, take: Callable[[DataFrame, int], None], late: AppendTable, marks: FoldedTable, checkpoint: str,
                  late_seconds: int) -> None:
    """Drain a stream of rows with ``ts``; rows older than the watermark of the earlier batches are kept aside, as they stand."""

    def commit(batch: DataFrame, n: int) -> None:
        # the mark is written last: a batch that a base of marks holds is done
        if n <= max(marks.numbers("base"), default=-1):
            return
        mark = watermark_millis(marks, late_seconds, before=n)
        old = F.lit(False) if mark is None else F.unix_millis("ts") < mark
        late.commit(n, batch.where(old))
        take(batch.where(~old), n)
        marks.commit(n, batch.agg(F.max("ts").alias("newest")))

    drain(rows, commit, checkpoint)


DISPATCHES = "run_id bigint, status string, updated_at timestamp, beat_id bigint, requeued boolean"


class Dispatches(StatefulProcessor):
    """The newest beat of a run; a dispatched run that stays silent for the TTL goes back to pending."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = max(MIN_TTL, ttl_seconds) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at timestamp, beat bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            top = pdf.sort_values(["ts", "beat_id"]).iloc[-1]
            if newest is None or (top["ts"], top["beat_id"]) > (newest["ts"], newest["beat_id"]):
                newest = top
        held = self.last.get() if self.last.exists() else None
        if held is not None:
            if (newest["ts"], newest["beat_id"]) <= (pd.Timestamp(held[1]), held[2]):
                return
            if held[3] >= 0:
                self.handle.deleteTimer(held[3])
        # silent for more than the TTL: the first millisecond after it
        timer = millis(newest["ts"]) + self.ttl_ms + 1 if newest["status"] == "dispatched" else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.last.update((newest["status"], newest["ts"].to_pydatetime(), int(newest["beat_id"]), timer))
        yield self._row(key, newest["status"], newest["ts"], newest["beat_id"], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, at, beat, timer = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() == timer:
            self.last.update(("pending", at, beat, -1))
            yield self._row(key, "pending", pd.Timestamp(at), beat, True)

    @staticmethod
    def _row(key: tuple, status: str, at: pd.Timestamp, beat: int, requeued: bool) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "updated_at": [at], "beat_id": [int(beat)], "requeued": [requeued]})

    def close(self) -> None:
        pass


def requeue_stream(beats: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """Changes of run state. Beats: run_id, status, ts, beat_id."""
    return keyed(beats, "run_id", late, Dispatches(ttl_seconds), DISPATCHES)


def fold_dispatches(states: DataFrame) -> DataFrame:
    """The newest change per run; a requeue comes after the beat that it answers."""
    newest = F.max(F.struct("updated_at", "beat_id", "requeued", "status")).alias("s")
    return states.groupBy("run_id").agg(newest).select("run_id", "s.status", "s.updated_at", "s.beat_id", "s.requeued")


def dispatch_view(states: DataFrame, ttl_seconds: int) -> DataFrame:
    """Runs with status and reason; a requeued run is dated to the end of its TTL."""
    ttl = max(MIN_TTL, ttl_seconds)
    at = F.when(F.col("requeued"), F.timestamp_micros(F.unix_micros("updated_at") + ttl * 1_000_000)).otherwise(F.col("updated_at"))
    return states.select("run_id", "requeued", "status", at.alias("updated_at"),
                         F.when(F.col("requeued"), F.lit(f"dispatch silent for more than {ttl} s, queued again")).alias("reason"))


BEATS = "run_id bigint, status string, ts timestamp, beat_id bigint"


def follow_dispatches(beats: DataFrame, state: FoldedTable, late: AppendTable, marks: FoldedTable, checkpoint: str, late_seconds: int) -> None:
    """Drain a stream of beats (run_id, status, ts, beat_id) into the newest beat per run (`DISPATCHES`, none requeued yet)."""

    def take(batch: DataFrame, n: int) -> None:
        state.commit(n, fold_dispatches(batch.select(
            "run_id", "status", F.col("ts").alias("updated_at"), "beat_id", F.lit(False).alias("requeued"))))

    follow_marked(beats, take, late, marks, checkpoint, late_seconds)


def requeued_at(states: DataFrame, watermark: int | None, ttl_seconds: int) -> DataFrame:
    """States of runs at a watermark (milliseconds): one that was dispatched and silent for the TTL is pending again."""
    ttl_ms = max(MIN_TTL, ttl_seconds) * 1000
    stale = (F.col("status") == "dispatched") & (F.unix_millis("updated_at") + ttl_ms < F.lit(watermark).cast("long"))
    stale = F.coalesce(stale, F.lit(False))
    return states.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "requeued": F.col("requeued") | stale})


LEASES = "batch_id bigint, validator_id bigint, item_id bigint, at timestamp, live boolean"


class Leases(StatefulProcessor):
    """Open assignments of a batch and what was derived under them; both leave when an assignment expires."""

    def __init__(self, timeout_seconds: int):
        self.timeout_ms = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "validator_id bigint", "at timestamp, timer bigint")
        self.done = handle.getMapState("done", "validator_id bigint", "at timestamp")
        self.derived = handle.getMapState("derived", "item_id bigint, validator_id bigint", "at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for row in pdf.sort_values(["ts", "kind"]).itertuples():
                who = (int(row.validator_id),)
                if row.kind == "derived":
                    self.derived.updateValue((int(row.item_id), int(row.validator_id)), (row.ts.to_pydatetime(),))
                    out.append((key[0], who[0], int(row.item_id), row.ts, True))
                elif row.kind == "done":
                    # its timer may be another validator's too: it stays, and finds no lease
                    if self.open.containsKey(who):
                        self.open.removeKey(who)
                    else:
                        # files may bring the end of an assignment before its start
                        self.done.updateValue(who, (row.ts.to_pydatetime(),))
                else:
                    if self.open.containsKey(who):
                        old, until = self.open.getValue(who)
                        if pd.Timestamp(old) >= row.ts:
                            continue
                        # assigned anew: what ended before that leaves now, not when the watermark gets there
                        if until <= millis(row.ts):
                            out += self._expire(key, until)
                    if self.done.containsKey(who) and pd.Timestamp(self.done.getValue(who)[0]) >= row.ts:
                        self.done.removeKey(who)
                    else:
                        timer = millis(row.ts) + self.timeout_ms + 1
                        self.open.updateValue(who, (row.ts.to_pydatetime(), timer))
                        self.handle.registerTimer(timer)
                    out.append((key[0], who[0], None, row.ts, True))
            if out:
                yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._expire(key, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield self._rows(out)

    def _expire(self, key: tuple, until: int) -> list[tuple]:
        """Changes that end the leases of that timer and the rows derived before it."""
        gone = [(who, value) for who, value in self.open.iterator() if value[1] == until]
        out = []
        for who, value in gone:
            self.open.removeKey(who)
            out.append((key[0], who[0], None, pd.Timestamp(value[0]), False))
        if gone:
            # rows that came in with a later time belong to the next assignment
            rows = [(what, value) for what, value in self.derived.iterator() if millis(pd.Timestamp(value[0])) < until]
            for what, value in rows:
                self.derived.removeKey(what)
                out.append((key[0], what[1], what[0], pd.Timestamp(value[0]), False))
        return out

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["batch_id", "validator_id", "item_id", "at", "live"])
        return pdf.astype({"item_id": "Int64"})

    def close(self) -> None:
        pass


def lease_stream(changes: DataFrame, timeout_seconds: int, late: str) -> DataFrame:
    """Changes of leases (item_id null) and derived rows.

    Changes: batch_id, kind (assigned, done, derived), validator_id, item_id
    (of derived rows), ts. A lease ends with ``done``; one that does not within
    the timeout is removed, with the rows derived in its batch until then.
    """
    return keyed(changes, "batch_id", late, Leases(timeout_seconds), LEASES)


def fold_leases(states: DataFrame) -> DataFrame:
    """The newest change of every lease and derived row; an end comes after the start of the same time."""
    ended = F.struct("at", (~F.col("live")).alias("ended"))
    return states.groupBy("batch_id", "validator_id", "item_id").agg(F.max(ended).alias("s")).select(
        "batch_id", "validator_id", "item_id", "s.at", (~F.col("s.ended")).alias("live"))


CHANGES = "batch_id bigint, kind string, validator_id bigint, item_id bigint, ts timestamp"


def fold_changes(changes: DataFrame) -> DataFrame:
    """Every start and end of a lease once, and the newest time of every derived row."""
    when = F.when(F.col("kind") != "derived", F.col("ts"))
    return changes.groupBy("batch_id", "kind", "validator_id", "item_id", when.alias("_when")).agg(F.max("ts").alias("ts")).drop("_when")


def follow_leases(changes: DataFrame, state: FoldedTable, late: AppendTable, marks: FoldedTable, checkpoint: str, late_seconds: int) -> None:
    """Drain a stream of lease changes (`CHANGES`) into a folded table of them."""
    follow_marked(changes, lambda batch, n: state.commit(n, batch), late, marks, checkpoint, late_seconds)


def leases_at(changes: DataFrame, watermark: int | None, timeout_seconds: int) -> DataFrame:
    """Leases (item_id null) and derived rows at a watermark (milliseconds), as `LEASES`.

    A lease that neither is done nor starts anew within the timeout has run
    out once the watermark or a new start is past it, and takes the rows with
    it that were derived in its batch until then. Per batch only the last
    such time counts, so rows meet one time and no list of leases.
    """
    timeout = timeout_seconds * 1000 + 1
    events = changes.where("kind <> 'derived'")
    rest = Window.partitionBy("batch_id", "validator_id").orderBy("ts", "kind")
    ahead = rest.rowsBetween(1, Window.unboundedFollowing)

    def first(kind: str) -> Column:
        return F.unix_millis(F.min(F.when(F.col("kind") == kind, F.col("ts"))).over(ahead))

    until = F.unix_millis("ts") + timeout
    starts = events.select("*", until.alias("until"), first("assigned").alias("_next"), first("done").alias("_done")).where("kind = 'assigned'")
    done = (F.col("_done") < F.col("until")) & (F.col("_next").isNull() | (F.col("_done") < F.col("_next")))
    over = F.col("until") <= F.coalesce("_next", F.lit(watermark).cast("long"))
    judged = starts.withColumn("gone", F.coalesce(over, F.lit(False)) & ~F.coalesce(done, F.lit(False)))
    newest = judged.groupBy("batch_id", "validator_id").agg(F.max(F.struct("ts", "gone")).alias("s")).select(
        "batch_id", "validator_id", F.lit(None).cast("bigint").alias("item_id"), F.col("s.ts").alias("at"), (~F.col("s.gone")).alias("live"))
    gone = judged.where("gone").groupBy("batch_id").agg(F.max("until").alias("_until"))
    rows = changes.where("kind = 'derived'").join(gone, "batch_id", "left").select(
        "batch_id", "validator_id", "item_id", F.col("ts").alias("at"),
        F.coalesce(F.unix_millis("ts") >= F.col("_until"), F.lit(True)).alias("live"))
    return newest.unionAll(rows)


CALLS = ("session_id bigint, call_no bigint, matched string, n_messages bigint, new_messages bigint, n_working bigint, ts timestamp")


class Sessions(StatefulProcessor):
    """Two fingerprints per session: of the last input and of the last output."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "call_no bigint, at timestamp, timer bigint, "
                                          "n_in bigint, key_in string, n_out bigint, key_out string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for call in pdf.sort_values("call_no").itertuples():
                held = self.state.get() if self.state.exists() else None
                chain, given = list(call.input_chain), len(call.input_chain)
                if held is not None and call.call_no <= held[0]:
                    out.append((key[0], call.call_no, "late", given, given, given, call.ts))
                    continue
                matched, new, working = "reset", given, given
                if held is not None:
                    _, at, timer, n_in, key_in, n_out, key_out = held
                    self.handle.deleteTimer(timer)
                    if millis(call.ts) - millis(pd.Timestamp(at)) <= self.ttl_ms:
                        if n_out <= given and (chain[n_out - 1] if n_out else "") == key_out:
                            matched, new = "output", given - n_out
                        elif n_in <= given and (chain[n_in - 1] if n_in else "") == key_in:
                            matched, new, working = "input", given - n_in, n_out + given - n_in
                timer = millis(call.ts) + self.ttl_ms + 1
                self.handle.registerTimer(timer)
                self.state.update((int(call.call_no), call.ts.to_pydatetime(), timer, given, chain[-1] if given else "",
                                   int(call.n_output), call.output_key))
                out.append((key[0], call.call_no, matched, given, new, working, call.ts))
            yield pd.DataFrame(out, columns=["session_id", "call_no", "matched", "n_messages", "new_messages", "n_working", "ts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def chained(keys) -> "F.Column":
    """Running digests of an array of message keys: entry i stands for the first i + 1 messages."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc, key):
        link = F.sha2(F.concat(acc["last"], key), 256)
        return F.struct(link.alias("last"), F.concat(acc["all"], F.array(link)).alias("all"))

    return F.aggregate(keys, start, step, lambda acc: acc["all"])


def with_chains(calls: DataFrame) -> DataFrame:
    """Calls (session_id, call_no, ts, input_keys, output_keys) with what the session state compares."""
    return calls.select("session_id", "call_no", "ts", chained(F.col("input_keys")).alias("input_chain"),
                        chained(F.col("output_keys")).alias("out")).select(
        "session_id", "call_no", "ts", "input_chain", F.size("out").cast("long").alias("n_output"),
        F.coalesce(F.try_element_at("out", F.lit(-1)), F.lit("")).alias("output_key"))


def session_stream(calls: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """What each call of a session goes on from.

    ``output``: its messages begin with the previous output; ``input``: with
    the previous input, whose output then stands for it; ``reset``: neither,
    or silent for longer than the TTL; ``late``: not newer than the last call,
    state left alone. The digests of all prefixes of a call are chained once,
    on the JVM; state and worker only hold and compare single ones.
    """
    return keyed(with_chains(calls), "session_id", late, Sessions(ttl_seconds), CALLS)


def follow_calls(calls: DataFrame, ttl_seconds: int) -> DataFrame:
    """Batch twin of `session_stream` for calls in order."""
    chained_calls = with_chains(calls)
    before = Window.partitionBy("session_id").orderBy("call_no")
    held = {c: F.lag(c).over(before).alias(f"_{c}") for c in ("ts", "n_output", "output_key")}
    n, last = F.size("input_chain").cast("long"), F.coalesce(F.try_element_at("input_chain", F.lit(-1)), F.lit(""))
    seen = chained_calls.select("*", *held.values(), F.lag(n).over(before).alias("_n"), F.lag(last).over(before).alias("_key"))

    def prefix(count: str):
        return F.when(F.col(count) == 0, "").otherwise(F.get("input_chain", (F.col(count) - 1).cast("int")))

    fresh = F.unix_micros("ts") - F.unix_micros("_ts") <= ttl_seconds * 1_000_000
    matched = (F.when(F.coalesce(fresh & (prefix("_n_output") == F.col("_output_key")), F.lit(False)), "output")
               .when(F.coalesce(fresh & (prefix("_n") == F.col("_key")), F.lit(False)), "input").otherwise("reset"))
    new = n - F.when(F.col("matched") == "output", F.col("_n_output")).when(F.col("matched") == "input", F.col("_n")).otherwise(0)
    working = F.when(F.col("matched") == "input", F.col("_n_output") + n - F.col("_n")).otherwise(n)
    return seen.withColumn("matched", matched).select(
        "session_id", "call_no", "matched", n.alias("n_messages"), new.alias("new_messages"), working.alias("n_working"), "ts")
