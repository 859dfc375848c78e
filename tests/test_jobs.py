"""Registry contract, gates, sinks, and multi-batch streaming against batch."""

import os

import pytest
from pyspark.sql import functions as F

from runledger import catalog
from runledger.operators import research as R
from runledger.functions.values import integral
from runledger.sources import sinks, snapshots
from runledger.streaming import live
from runledger.streaming.tables import AppendTable, FoldedTable


def test_registry_contract():
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(queries) - set(oracle) == {"txt20_profile_sweep"}


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8


def candidate_rows(spark, rows):
    return spark.createDataFrame(rows, "category string, pass boolean, neg_runs int, n_runs int, ratio double, score double, broke boolean, "
                                 "new_broke boolean, pairing_error boolean, missing_patch boolean")


def test_gate_accepts_and_rejects(spark):
    base = spark.createDataFrame([(4.0, 0.1, 1.5)], "avg_ratio double, medium_neg_rate double, medium_score double")
    good = candidate_rows(spark, [("Medium", True, 0, 5, 5.0, 1.8, False, False, False, False), ("Easy", True, 1, 5, 4.5, 1.7, True, False, False, False)])
    bad = candidate_rows(spark, [("Medium", True, 3, 5, 4.1, 1.2, True, True, True, False)])
    assert {r["decision"] for r in R.full_gate(good, good.limit(0), base).collect()} == {"ACCEPT"}
    verdicts = {r["check"]: r["rejected"] for r in R.full_gate(bad, bad.limit(0), base).collect()}
    assert all(verdicts.values()) and len(verdicts) == 5


def test_correlation_is_null_without_variance(spark):
    cells = spark.createDataFrame([("a", i, "Easy", True, False, 2.0, 0.1 * i, 1.0) for i in range(4)],
                                  "entrant string, task_id int, category string, miner_pass boolean, broke_baseline boolean, ratio double, neg_rate double, score double")
    out = {r["category"]: r for r in R.depth_correlations(cells, cells.select("task_id"), ["a"]).collect()}
    assert set(out) == {"overall", "Easy"} and out["overall"]["ratio_vs_neg_rate"] is None and out["overall"]["n_points"] == 4


def test_stability_counts_come_with_the_scores(spark, tmp_path):
    """Runs are scored once: the cells hold what a second pass over scored runs would count."""
    from runledger.operators import pairs

    tasks = spark.sql("SELECT 1L AS task_id, 't1' AS task_name, 0L AS competition_id, false AS is_screener")
    entrants = spark.sql("SELECT 1L AS entrant_id, 'E1' AS hotkey, false AS banned")
    rows = [(1, 1, 1, 1, 100, True)] + [(i, 1, 1, i, tokens, False) for i, tokens in enumerate([50, 50, None, 900, 0, 200], 2)]
    runs = spark.createDataFrame(rows, "run_id long, task_id long, entrant_id long, attempt_no int, tokens_used long, baseline_run boolean")
    validations = spark.createDataFrame([(i, i, r) for i, r in enumerate([True, True, True, False, False, None], 1)], "validation_id long, run_id long, resolved boolean")
    judged = pairs.judged_runs(runs, validations)
    scores = pairs.judged_run_scores(tasks, judged, entrants)
    want = R.run_cells(scores.withColumns({"entrant": F.col("hotkey"), "run_pass": F.col("run_resolved")})).collect()
    got = R.counted_cells(pairs.scored_cells(tasks, judged, entrants)).select("entrant", "task_id", "n", "neg", "passes").collect()
    assert got == want and tuple(got[0]) == ("E1", 1, 6, 2, 2)
    assert R.counted_cells(pairs.task_cells(scores)).collect() == got


def test_snapshot_sink_refuses_empty_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "d1")], "x int, day string")
    with pytest.raises(ValueError):
        sinks.write_snapshot(df.limit(0), str(tmp_path / "s0"))
    sinks.write_snapshot(df, str(tmp_path / "s1"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_snapshot(df, str(tmp_path / "s1"))


def test_detail_documents_stay_small(spark, sf_dir, monkeypatch):
    """Documents are written compressed and a month is cut by order ranges; every run is read back."""
    from runledger.catalog import ingest
    from runledger.catalog.views import Views

    v = Views(spark, sf_dir)
    n_runs = v.lineitems.join(v.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).count()
    monkeypatch.setattr(ingest, "FILE_KEYS", 500, raising=False)
    for single in (False, True):
        path = ingest.detail_files(v, "true", single=single)
        files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert sum(map(os.path.getsize, files)) < 150 * n_runs
        runs = snapshots.scan_run_snapshots(spark, path, lines=True)
        assert runs.count() == runs.select("run_id").distinct().count() == n_runs
        if single:
            assert len(files) > len({os.path.dirname(f) for f in files})


def test_detail_lines_move_once(spark, sf_dir):
    from runledger.catalog.views import Views

    v = Views(spark, sf_dir)
    by_order = v.lineitems_by_order
    assert by_order.exceptAll(v.lineitems).count() == 0 and by_order.count() == v.lineitems.count()
    plan = by_order.groupBy("l_orderkey").agg(F.collect_list("l_linenumber"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unreadable_documents_are_skipped(spark, tmp_path):
    day = tmp_path / "2024-01-02"
    os.makedirs(day)
    (day / "a.json").write_text('{"hotkey": "k1", "tasks": [{"task_id": 1, "runs": [{"run_id": 5, "attempt_no": 1, "platform_score": -1.0}]}]}')
    (day / "b.json").write_text('{"observed_at": "2024-01-03", "miners": [{"hotkey": "k2", "tasks": [{"task_id": 2, "runs": [{"run_id": 6, "attempt_no": 1}]}]}]}')
    (day / "c.json").write_text("{broken")
    rows = {r["run_id"]: r for r in snapshots.scan_run_snapshots(spark, str(tmp_path)).collect()}
    assert set(rows) == {5, 6}
    assert rows[5]["observed_at"] == "2024-01-02" and rows[6]["observed_at"] == "2024-01-03"


def test_registry_section(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text('first:\n  a1: {hotkey: "h1", total: 1.5, ok: true}\n\nsecond:\n  b1: {hotkey: "h2", total: null}\n')
    got = snapshots.scan_registry(spark, str(path), "second", ["hotkey", "total"]).collect()
    assert [tuple(r) for r in got] == [("b1", "h2", None)]


def test_streams_over_many_batches_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    as_beats = lambda e: e.selectExpr(
        "user_id AS entity", "event_type AS status", "CASE WHEN value > 15 THEN concat('v', cast(value AS int)) END AS version", "event_type AS model", "cast(ts AS timestamp) AS ts", "event_id AS beat_id")
    table = FoldedTable(spark, str(tmp_path / "state"), live.STATE, live.fold_heartbeats)
    history = AppendTable(spark, str(tmp_path / "history"), live.HISTORY)

    def drained():
        live.follow_heartbeats(as_beats(stream), table, history, str(tmp_path / "cp"))
        return live.heartbeat_view(table.current())

    want = live.heartbeat_state(as_beats(events))
    assert drained().count() == want.count()
    got = drained()  # a restart without new files
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    assert history.current().count() == events.count()
    board = FoldedTable(spark, str(tmp_path / "board"), live.BOARD, live.fold_board)
    live.follow_board(stream.selectExpr("user_id AS entity", "value"), board, str(tmp_path / "cp2"))
    assert board.current().agg(F.sum("n")).first()[0] == events.count()


def test_replayed_batch_counts_once(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path / "t"), live.BOARD, live.fold_board)
    batch = spark.createDataFrame([(1, 2.0), (1, 3.0)], "entity long, value double")
    for _ in range(2):
        table.commit(0, live.board_partials(batch))
    assert table.current().first()["n"] == 2


def test_late_version_beats_an_earlier_one(spark, tmp_path):
    first = spark.sql("SELECT 1L AS entity, 'a' AS status, 'v1' AS version, 'm1' AS model, timestamp'2024-01-01 00:01:00' AS ts, 1L AS beat_id"
                      " UNION ALL SELECT 1L, 'c', NULL, NULL, timestamp'2024-01-01 00:05:00', 3L")
    late = spark.sql("SELECT 1L AS entity, 'b' AS status, 'v2' AS version, NULL AS model, timestamp'2024-01-01 00:04:00' AS ts, 2L AS beat_id")
    table = FoldedTable(spark, str(tmp_path / "t"), live.STATE, live.fold_heartbeats)
    for i, batch in enumerate((first, late)):
        table.commit(i, live.heartbeat_parts(batch))
    state = table.current()
    assert state.columns == spark.createDataFrame([], live.STATE).columns
    assert live.heartbeat_view(state).collect() == live.heartbeat_state(first.unionByName(late)).collect()
    assert state.first()["version"] == "v2" and state.first()["model"] == "m1" and state.first()["status"] == "c"
    assert FoldedTable(spark, str(tmp_path / "none"), live.STATE, live.fold_heartbeats).current().count() == 0


def test_reports_are_parsed_once(spark, capsys):
    texts = ['{"ok_status": true, "patch_capture_status": "true", "total_tokens": -1, "metadata": {"total": {"total_tokens": 7.0}, "agent": {"steps": "3"}}}',
             '{"metadata": 5, "steps": 4, "error": " e "}', '{"total_tokens": true, "metadata": {"total": 9, "token_usage": {"total": {"total_tokens": "12"}}}}',
             '[{"total_tokens": 1}]', '{"total_tokens": 1', "", None, '{"total_tokens": {"a": [1, 2.50]}, "metadata": {"result": {"stderr": {"b": 1.50}}}}',
             ' {"metadata": {"reason": "", "stderr": "late"}, "agent_steps": 1e1, "execution_time_seconds": "2.5"}', '{"metadata": [1], "total_tokens": null}', "7"]
    reports = spark.createDataFrame(list(enumerate(texts)), "run_id long, report string")
    out = snapshots.extract_run_metrics(reports)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.lower().count("from_json") <= 1 and "get_json_object" not in plan
    single = lambda paths: F.coalesce(*[integral(F.get_json_object("report", p)) for p in paths])
    want = reports.withColumns({"total_tokens": single(snapshots.TOKEN_PATHS), "agent_steps": single(snapshots.STEP_PATHS)})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    errors = snapshots.read_reports(reports).select("run_id", snapshots.report_error())
    plain = reports.select("run_id", F.coalesce(*[F.nullif(F.trim(F.get_json_object("report", p)), F.lit("")) for p in snapshots.ERROR_PATHS]))
    assert sorted(map(tuple, errors.collect())) == sorted(map(tuple, plain.collect()))
