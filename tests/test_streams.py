"""Stream tables and event-time timers: restarts, replays, files out of order."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runledger.streaming import live, timers
from runledger.streaming.tables import AppendTable, FoldedTable, drain

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def board_batch(spark, i):
    return live.board_partials(spark.range(1000).selectExpr(f"id + {i} * 1000 AS entity", "cast(id AS double) AS value"))


def test_a_batch_writes_only_itself(spark, tmp_path):
    root = str(tmp_path / "t")
    table = FoldedTable(spark, root, live.BOARD, live.fold_board, every=4)
    written = []
    for i in range(10):
        table.commit(i, board_batch(spark, i))
        if os.path.isdir(table.folder("part", i)):
            written.append(size_of(table.folder("part", i)))
    assert max(written[1:]) < 1.2 * written[0]
    assert table.numbers("base") == [7] and table.numbers("part") == [8, 9]
    assert sorted(os.listdir(root)) == ["base-000000000007", "part-000000000008", "part-000000000009"]
    assert table.current().count() == 10_000
    # batches that the base holds, and the newest one, again
    for i in (7, 9):
        table.commit(i, board_batch(spark, i))
    assert table.current().agg(F.sum("n")).first()[0] == 10_000
    assert FoldedTable(spark, root, live.BOARD, live.fold_board).current(before=9).count() == 9_000


def test_a_torn_write_is_not_read(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path / "t"), live.BOARD, live.fold_board)
    table.commit(0, board_batch(spark, 0))
    table.write("part", 1, board_batch(spark, 1))
    os.remove(table.folder("part", 1) + "/_SUCCESS")
    assert table.current().count() == 1000
    table.commit(1, board_batch(spark, 1))
    assert table.current().count() == 2000


def feed(spark, tmp_path, schema, files, run):
    """Each file arrives in a run of its own, from the checkpoint of the one before."""
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path))


def test_late_requests_are_kept_aside(spark, tmp_path):
    windows = FoldedTable(spark, str(tmp_path / "w"), live.WINDOWS, live.fold_windows)
    late = AppendTable(spark, str(tmp_path / "l"), live.LATE)
    files = [[(1, at(0)), (1, at(0))], [(1, at(50)), (2, at(49))], [(1, at(0)), (1, at(27)), (1, at(1))]]
    feed(spark, tmp_path, "key_id long, ts timestamp", files, lambda s: live.follow_requests(s, windows, late, str(tmp_path / "cp"), 24 * 3600))
    assert sorted(r["ts"] for r in late.current().collect()) == [at(0), at(1)]
    counted = windows.current().where("unit = 'day'").collect()
    assert sorted((r["key_id"], r["bucket"], r["n"]) for r in counted) == [(1, at(0), 2), (1, at(24), 1), (1, at(48), 1), (2, at(48), 1)]


def test_stale_dispatches_go_back_by_event_time(spark, tmp_path):
    state = FoldedTable(spark, str(tmp_path / "t"), timers.DISPATCHES, timers.fold_dispatches)
    files = [
        [(1, "dispatched", at(0), 1), (2, "dispatched", at(0), 2), (3, "completed", at(0), 3), (4, "dispatched", at(4), 4)],
        # run 2 reports, run 5's beats arrive newest first, run 4 is silent
        [(2, "completed", at(0.5), 5), (5, "dispatched", at(9), 6), (6, "dispatched", at(12), 7)],
        # run 1 is dispatched again after its requeue, an old beat of run 5 changes nothing
        [(1, "dispatched", at(13), 8), (5, "pending", at(8), 9), (7, "dispatched", at(16), 10)],
    ]
    feed(spark, tmp_path, "run_id long, status string, ts timestamp, beat_id long", files, lambda s: drain(
        timers.requeue_stream(s, 3600, "6 hours"), lambda b, n: state.commit(n, b), str(tmp_path / "cp"), "update"))
    got = {r["run_id"]: (r["status"], r["requeued"], r["updated_at"]) for r in timers.dispatch_view(state.current(), 3600).collect()}
    # the watermark ends at hour 10
    assert got == {1: ("dispatched", False, at(13)), 2: ("completed", False, at(0.5)), 3: ("completed", False, at(0)),
                   4: ("pending", True, at(5)), 5: ("dispatched", False, at(9)), 6: ("dispatched", False, at(12)), 7: ("dispatched", False, at(16))}


def test_leases_leave_with_what_they_carried(spark, tmp_path):
    state = FoldedTable(spark, str(tmp_path / "t"), timers.LEASES, timers.fold_leases)
    files = [
        [(1, "assigned", 7, None, at(0)), (2, "done", 7, None, at(1)), (1, "derived", 7, 11, at(1)), (1, "derived", 7, 12, at(30))],
        # the start of batch 2 comes after its end, batch 3 is done by one of two validators
        [(2, "assigned", 7, None, at(0)), (2, "derived", 7, 21, at(1)), (3, "assigned", 8, None, at(2)), (3, "assigned", 9, None, at(2)),
         (3, "done", 8, None, at(3)), (3, "derived", 8, 31, at(3))],
        [(4, "assigned", 7, None, at(100)), (1, "assigned", 7, None, at(99))],
    ]
    feed(spark, tmp_path, "batch_id long, kind string, validator_id long, item_id long, ts timestamp", files, lambda s: drain(
        timers.lease_stream(s, 24 * 3600, "40 hours"), lambda b, n: state.commit(n, b), str(tmp_path / "cp"), "update"))
    live_rows = {(r["batch_id"], r["validator_id"], r["item_id"]) for r in state.current().where("live").collect()}
    assert live_rows == {(1, 7, None), (1, 7, 12), (2, 7, None), (2, 7, 21), (3, 8, None), (4, 7, None)}


def test_dispatches_by_sets_equal_the_timers(spark, tmp_path):
    files = [
        [(1, "dispatched", at(0), 1), (2, "dispatched", at(0), 2), (3, "completed", at(0), 3), (4, "dispatched", at(4), 4)],
        [(2, "completed", at(0.5), 5), (5, "dispatched", at(9), 6), (6, "dispatched", at(12), 7)],
        [(1, "dispatched", at(13), 8), (5, "pending", at(8), 9), (7, "dispatched", at(16), 10)],
        # older than the watermark (hour 10): kept aside, its run stays requeued
        [(4, "completed", at(6), 11), (8, "dispatched", at(15), 12)],
    ]
    state = FoldedTable(spark, str(tmp_path / "t"), timers.DISPATCHES, timers.fold_dispatches, every=2)
    marks = FoldedTable(spark, str(tmp_path / "m"), timers.MARKS, timers.fold_marks, every=2)
    late = AppendTable(spark, str(tmp_path / "l"), timers.BEATS)
    feed(spark, tmp_path, timers.BEATS, files, lambda s: timers.follow_dispatches(s, state, late, marks, str(tmp_path / "cp"), 6 * 3600))
    mark = timers.watermark_millis(marks, 6 * 3600)
    view = timers.dispatch_view(timers.requeued_at(state.current(), mark, 3600), 3600)
    got = {r["run_id"]: (r["status"], r["requeued"], r["updated_at"]) for r in view.collect()}
    assert got == {1: ("dispatched", False, at(13)), 2: ("completed", False, at(0.5)), 3: ("completed", False, at(0)),
                   4: ("pending", True, at(5)), 5: ("dispatched", False, at(9)), 6: ("dispatched", False, at(12)),
                   7: ("dispatched", False, at(16)), 8: ("dispatched", False, at(15))}
    assert [r["beat_id"] for r in late.current().collect()] == [11]


def test_leases_by_sets_equal_the_timers(spark, tmp_path):
    import random

    rng = random.Random(11)
    rows = []
    for batch in range(40):
        for who in range(rng.randrange(1, 3)):
            # a batch may be assigned anew, inside the timeout or after it; some ends never come
            start = rng.randrange(0, 40)
            for _ in range(rng.randrange(1, 4)):
                rows.append((batch, "assigned", who, None, at(start)))
                if rng.random() < 0.4:
                    rows.append((batch, "done", who, None, at(start + rng.randrange(1, 20) + 0.25)))
                rows += [(batch, "derived", who, rng.randrange(0, 9), at(start + rng.randrange(0, 60) + 0.5)) for _ in range(3)]
                start += rng.choice([10, 20.75, 30, 90])
    # in order of time: the timers take what comes first, the sets what happened first
    order = sorted(rows, key=lambda r: r[4])
    files = [order[len(order) * i // 4:len(order) * (i + 1) // 4] for i in range(4)]
    kept = FoldedTable(spark, str(tmp_path / "a"), timers.LEASES, timers.fold_leases)
    state = FoldedTable(spark, str(tmp_path / "t"), timers.CHANGES, timers.fold_changes, every=2)
    marks, late = FoldedTable(spark, str(tmp_path / "m"), timers.MARKS, timers.fold_marks), AppendTable(spark, str(tmp_path / "l"), timers.CHANGES)
    (tmp_path / "one").mkdir()
    feed(spark, tmp_path / "one", timers.CHANGES, files, lambda s: drain(
        timers.lease_stream(s, 24 * 3600, "40 hours"), lambda b, n: kept.commit(n, b), str(tmp_path / "cp1"), "update"))
    (tmp_path / "two").mkdir()
    feed(spark, tmp_path / "two", timers.CHANGES, files, lambda s: timers.follow_leases(s, state, late, marks, str(tmp_path / "cp2"), 40 * 3600))
    held = timers.leases_at(state.current(), timers.watermark_millis(marks, 40 * 3600), 24 * 3600)
    cols = ["batch_id", "validator_id", "item_id", "at", "live"]
    want = {tuple(r) for r in kept.current().select(*cols).collect()}
    got = {tuple(r) for r in held.select(*cols).collect()}
    assert late.current().count() == 0 and {r[4] for r in want} == {True, False}
    assert (got - want, want - got) == (set(), set())


def test_stream_queries_run_no_worker_per_key(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(timers, "keyed", None)
    assert entry.queries()["str2_requeue_stream"](spark, sf_dir).count() > 0
    assert entry.queries()["str3_lease_stream"](spark, sf_dir).count() > 0


def test_sessions_go_on_from_output_input_or_start_anew(spark, tmp_path):
    row = "session_id long, call_no long, ts timestamp, input_keys array<string>, output_keys array<string>"
    files = [
        [(1, 1, at(0), ["a", "b", "c"], ["x"]), (2, 1, at(0), ["a", "b"], ["y"]), (3, 1, at(0), ["a", "b"], ["z"]), (4, 1, at(0), [], [])],
        [(1, 2, at(1), ["x", "d"], ["x", "e"]), (2, 2, at(1), ["a", "b", "c", "d"], ["y", "w"]), (3, 2, at(1), ["q", "b"], ["z"]), (4, 2, at(1), ["a"], ["a"])],
        [(1, 3, at(2), ["x", "e", "f", "g"], []), (1, 2, at(2), ["x"], []), (2, 3, at(900), ["y", "w"], ["y"]), (3, 3, at(2), ["z"], ["z"])],
    ]
    out = AppendTable(spark, str(tmp_path / "t"), timers.CALLS)
    feed(spark, tmp_path, row, files, lambda s: drain(
        timers.session_stream(s, 30 * 86_400, "1 hour"), lambda b, n: out.commit(n, b), str(tmp_path / "cp"), "update"))
    got = {(r["session_id"], r["call_no"], r["matched"], r["new_messages"], r["n_working"]) for r in out.current().collect()}
    want = {(1, 1, "reset", 3, 3), (2, 1, "reset", 2, 2), (3, 1, "reset", 2, 2), (4, 1, "reset", 0, 0),
            (1, 2, "output", 1, 2), (2, 2, "input", 2, 3), (3, 2, "reset", 2, 2), (4, 2, "output", 1, 1),
            (1, 3, "output", 2, 4), (2, 3, "reset", 2, 2), (3, 3, "output", 0, 1)}
    assert got == want | {(1, 2, "late", 1, 1)}
    in_order = spark.createDataFrame([c for f in files for c in f if c[:3] != (1, 2, at(2))], row)
    assert {tuple(r)[:3] + (r["new_messages"], r["n_working"]) for r in timers.follow_calls(in_order, 30 * 86_400).collect()} == want
