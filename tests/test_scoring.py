"""Closed forms of the scoring, difficulty and reward rules."""

import math
import time

import pytest
from pyspark.sql import functions as F

from runledger.functions import scoring as S
from runledger.operators import difficulty, pairs, rewards


def test_multiplier_points(spark):
    df = spark.createDataFrame([(-0.5,), (-0.2,), (0.0,), (0.2,), (0.5,), (None,)], "s double")
    got = [r[0] for r in df.select(S.savings_multiplier("s")).collect()]
    assert got == pytest.approx([0, 0, 0.5, 1, 1, 1])


def test_adjusted_scores(spark):
    df = spark.createDataFrame([(2.0, 100, 80), (2.0, 100, 120), (2.0, 100, 100), (2.0, None, 80)], "r double, b int, c int")
    got = [r[0] for r in df.select(S.adjust_score("r", "b", "c")).collect()]
    assert got == pytest.approx([2.0, -4.0, -1.0, 2.0])


def test_outcomes_and_log_ratio(spark):
    df = spark.createDataFrame(
        [(True, True, 100, 50), (True, False, 100, 50), (False, True, 100, 0), (False, False, 1000000, 1), (None, True, 1, 1)],
        "bp boolean, cp boolean, b long, c long")
    got = [r[0] for r in df.select(S.pair_score("bp", "cp", "b", "c")).collect()]
    assert got[:4] == pytest.approx([1 + 0.5 * math.log(2), -4.0, 4.0, 0.2])
    assert got[4] is None


def cells(spark, rows):
    return spark.createDataFrame(rows, "entrant_id long, hotkey string, task_id long, task_name string, is_screener boolean, n_runs long, "
                                 "n_pass long, score_sum double, n_scored long, run_tokens double, run_token_sum long")


def test_entrant_total_uses_the_global_multiplier(spark):
    c = cells(spark, [(1, "a", 1, "t1", True, 1, 1, 2.0, 1, 80.0, 80), (1, "a", 2, "t2", False, 1, 0, 0.0, 1, 120.0, 120)])
    base = spark.createDataFrame([(1, 100), (2, 100)], "task_id long, baseline_token_sum long")
    row = pairs.entrant_scores(c, base).first()
    assert row["total_score"] == pytest.approx(-1.5)
    assert row["screener_score"] == pytest.approx(2.0)


def test_difficulty_scores_and_thirds(spark):
    inputs = spark.createDataFrame([("a", 1, 0.7, 100.0), ("b", 2, 0.35, 100.0), ("c", 3, 0.0, 100.0)],
                                   "task_name string, task_id long, loss_ratio double, avg_tokens double")
    got = {r["task_name"]: (r["difficulty_score"], r["category"])
           for r in difficulty.assign_difficulty(difficulty.difficulty_score(inputs)).collect()}
    assert got["a"][0] == pytest.approx(0.775) and got["c"][0] == pytest.approx(0.25)
    assert [got[t][1] for t in "abc"] == ["Hard", "Medium", "Easy"]
    seven = spark.createDataFrame([(f"t{i}", i, float(-i)) for i in range(7)], "task_name string, task_id long, difficulty_score double")
    classes = [r["category"] for r in difficulty.assign_difficulty(seven).orderBy("task_id").collect()]
    assert classes == ["Hard"] * 3 + ["Medium"] * 2 + ["Easy"] * 2


def test_category_scores_need_every_task(spark):
    c = cells(spark, [(1, "a", 1, "t1", False, 1, 1, 2.0, 1, 1.0, 1), (1, "a", 2, "t2", False, 2, 1, 3.0, 2, 1.0, 1),
                      (2, "b", 1, "t1", False, 1, 1, 4.0, 1, 1.0, 1)])
    classes = spark.createDataFrame([(1, "Hard"), (2, "Hard")], "task_id long, category string")
    rows = difficulty.category_scores(c, classes).collect()
    assert [(r["hotkey"], r["category"], r["category_score"]) for r in rows] == [("a", "Hard", 1.75)]


def test_reward_lattice_ties_and_burn(spark):
    category = spark.createDataFrame(
        [("A", "Easy", 1.0), ("A", "Medium", 0.0), ("A", "Hard", 0.0), ("B", "Easy", 0.0), ("B", "Medium", 1.0), ("B", "Hard", 0.0),
         ("C", "Easy", 0.9), ("C", "Medium", 0.9), ("C", "Hard", 0.9), ("D", "Easy", 9.0)],
        "hotkey string, category string, category_score double")
    scores = rewards.subset_scores(category.where("hotkey <> 'D'"))
    got = {r["hotkey"]: r["raw_weight"] for r in rewards.winners(scores).groupBy("hotkey").agg(F.sum("share").alias("raw_weight")).collect()}
    # A and B win their single class, C the rest
    assert got == pytest.approx({"A": 1 / 12, "B": 1 / 12, "C": 1 + 3 / 6 + 1 / 12})
    final = {r["hotkey"]: r["final_weight"] for r in rewards.reward_weights(scores, 0.5).collect()}
    assert sum(final.values()) == pytest.approx(0.5)
    incomplete = rewards.subset_scores(category).where("hotkey = 'D'").collect()
    assert [r["element"] for r in incomplete] == ["Easy"]


def test_empty_burn_table_burns_everything(spark):
    empty = spark.createDataFrame([], "request_id long, created_at timestamp, is_active boolean, burn_ratio double")
    assert tuple(rewards.burn_state(empty).first()) == (True, 1.0)


def test_payout_overflow_goes_to_zero(spark):
    reg = spark.createDataFrame([("a", 5)], "hotkey string, uid long")
    pay = lambda w: {r["uid"]: r["weight"] for r in rewards.payout(
        reg.select("uid"), 0.1, spark.createDataFrame([("a", w), ("x", 0.1)], "hotkey string, weight double"), reg).collect()}
    assert pay(0.5) == pytest.approx({5: 0.6, 0: 0.4})
    assert pay(5.0) == pytest.approx({0: 1.0})


def test_run_scores_equal_the_pair_means(spark, sf_dir):
    from runledger.catalog.views import Views

    v = Views(spark, sf_dir).settled()
    fast = pairs.run_scores(v.tasks, v.runs, v.validations, v.entrants).select("run_id", "run_score")
    slow = pairs.pair_scores(pairs.run_pairs(v.tasks, v.runs, v.validations, v.entrants)).groupBy("run_id").agg(
        F.avg("pair_score").alias("slow"))
    both = fast.join(slow, "run_id", "full")
    assert both.count() == fast.count() == slow.count()
    assert both.where("NOT (run_score <=> slow) AND (abs(run_score - slow) > 1e-9 OR run_score IS NULL OR slow IS NULL)").count() == 0


def test_pair_counts_equal_the_pairs_and_make_none(spark, sf_dir, monkeypatch):
    from runledger.catalog import scoring
    from runledger.catalog.views import Views

    def counts(p):
        return p.groupBy("task_id", "hotkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("run_id").alias("n_runs"),
                                                  F.countDistinct("baseline_run_id").alias("n_base"))

    def rows(df):
        return sorted(map(tuple, df.select("task_id", "hotkey", "n_pairs", "n_runs", "n_base").collect()))

    v = Views(spark, sf_dir).settled()
    # some runs have several verdicts, some none
    verdicts = v.validations.withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("run_id") % 3).cast("int")))).where("n > 0 OR run_id % 4 = 0")
    verdicts = verdicts.withColumn("validation_id", F.col("validation_id") * 10 + F.col("n")).drop("n")
    args = (v.tasks, v.runs, verdicts, v.entrants, True, ["E1", "E4", "E7"], 1)
    want = rows(counts(pairs.run_pairs(*args)))
    assert want and rows(pairs.pair_counts(*args)) == want
    # the query itself does not expand pairs
    monkeypatch.setattr(pairs, "run_pairs", None)
    assert scoring.joi2(v).count() > 0


def test_duplicate_verdicts_add_pairs(spark):
    tasks = spark.createDataFrame([(1, "t", 0, False, 1)], "task_id long, task_name string, competition_id long, is_screener boolean, planned_repeats int")
    runs = spark.createDataFrame([(1, 1, 0, 1, 100, True), (2, 1, 1, 1, 50, False)],
                                 "run_id long, task_id long, entrant_id long, attempt_no int, tokens_used long, baseline_run boolean")
    verdicts = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True)], "validation_id long, run_id long, resolved boolean")
    who = spark.createDataFrame([(1, "a", False)], "entrant_id long, hotkey string, banned boolean")
    got = pairs.run_scores(tasks, runs, verdicts, who).first()["run_score"]
    half = 0.5 * math.log(2)
    assert got == pytest.approx(((1 + half) + (4 + half)) / 2)
    # the summary looks at the latest verdict only
    assert pairs.baseline_summary(runs, verdicts).first()["baseline_pass"] is False


def test_pairs_start_from_one_written_join_and_broadcast_no_side(spark, monkeypatch):
    """Runs and verdicts used to be joined once for each side, by broadcast while their files were small."""
    steps, keep = [], pairs.through_parquet
    monkeypatch.setattr(pairs, "through_parquet", lambda df, label, **kw: steps.append((label, kw, df)) or keep(df, label, **kw))
    tasks = spark.createDataFrame([(t, f"t{t}", 1, False) for t in (1, 2)], "task_id long, task_name string, competition_id long, is_screener boolean")
    entrants = spark.createDataFrame([(0, "E0", False), (1, "E1", True)], "entrant_id long, hotkey string, banned boolean")
    # every seventh run is a baseline, one is neither; task 3 and entrant 2 are unknown
    listed = [(i, 1 + i % 3, i % 3 if i % 7 else 0, i, 100 * i, None if i == 5 else i % 7 == 0) for i in range(42)]
    verdicts = [(i, i % 2 == 0) for i in range(0, 42, 2)] + [(7, None), (8, False), (14, False)]
    runs = spark.createDataFrame(listed, "run_id long, task_id long, entrant_id long, attempt_no int, tokens_used long, baseline_run boolean")
    found = pairs.run_pairs(tasks, runs, spark.createDataFrame(verdicts, "run_id long, resolved boolean"), entrants)
    assert [s[:2] for s in steps] == [("pair-runs", {"release": True})]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [run_id" in plan(steps[0][2]) and "Broadcast" not in plan(steps[0][2])
    joins = [line.split("[")[1] for line in plan(found).splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 1 and joins[0].startswith("task_id") and "_salt" in joins[0]
    judged = [(*r, x) for r in listed for x in ([x for i, x in verdicts if i == r[0]] or [None])]
    want = sorted((b[0], str(b[6]), r[0], str(r[6])) for b in judged if b[5] for r in judged
                  if r[5] is False and r[1] == b[1] < 3 and r[2] < 2)
    got = found.select("baseline_run_id", "baseline_resolved", "run_id", "run_resolved").collect()
    assert sorted((a, str(b), c, str(d)) for a, b, c, d in got) == want and len(want) == 48


def test_written_steps_release_their_shuffle_files(spark):
    from runledger.session import CLEAN_UP, through_parquet

    def held():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    was, setting = held(), spark.conf.get(CLEAN_UP, None)
    out = through_parquet(spark.range(1000).repartition(4, "id"), "released", release=True)
    until = time.time() + 20
    while held() - was and time.time() < until:
        time.sleep(0.2)
    assert not held() - was and spark.conf.get(CLEAN_UP, None) == setting
    assert out.count() == 1000
