"""The skew helpers give the same rows as the plain forms, hot keys included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.operators import boards, queues
from runledger.scale import attach_by_block, attach_facts, global_totals, positions, quantiles, ranked, running_totals, values_at


def rows(spark):
    # key 0 holds a third of all rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"), F.col("id"), (F.col("id") * 37 % 101).alias("v"))


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_attach_facts_splits_hot_groups(spark):
    df = rows(spark)
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    want = df.join(facts.drop("n"), "k")
    assert same(attach_facts(df, facts, ["k"], "n", hot_rows=100), want)
    assert same(attach_facts(df, facts, ["k"], "n", hot_rows=10**9), want)


def test_attach_facts_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    assert {(r["k"], r["m"]) for r in attach_facts(df, facts, ["k"], "n").collect()} == {(None, 1), (1, 2)}


def numbered(spark):
    return positions(rows(spark), ["k"], F.floor(F.col("id") / 50), ["id"], "pos")


def test_positions_equal_row_numbers(spark):
    w = Window.partitionBy("k").orderBy("id")
    assert same(numbered(spark), rows(spark).withColumn("pos", F.row_number().over(w)))


def test_running_totals_equal_windows(spark):
    df = numbered(spark)
    w = Window.partitionBy("k").orderBy("pos")
    got = running_totals(df, ["k"], "pos", {"s": F.col("v")}, {"m": F.when(F.col("v") % 2 == 0, F.col("v"))}, block=16)
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max(F.when(F.col("v") % 2 == 0, F.col("v"))).over(w))
    assert same(got, want)


def test_attach_by_block(spark):
    df = numbered(spark)
    facts = df.groupBy("k").agg(F.max("pos").alias("last"), F.max("v").alias("best"))
    assert same(attach_by_block(df, facts, ["k"], "pos", "last", block=16), df.join(facts.drop("last"), "k"))


def crowded(spark):
    # nine tenths without a score, the rest with few distinct ones
    return spark.range(20_000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).cast("double").alias("score"))


def test_ranks_of_crowds_equal_row_numbers(spark):
    df = crowded(spark).unionByName(spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (2, 3, None)], "k int, id long, score double"))
    w = Window.partitionBy("k").orderBy(F.col("score").desc_nulls_last(), "id")
    assert same(ranked(df, ["k"], "score", ["id"]), df.withColumn("rank", F.row_number().over(w)))
    assert ranked(df.limit(0), ["k"], "score", ["id"]).count() == 0


def test_no_range_holds_a_crowd(spark):
    sized = global_totals(crowded(spark).withColumn("v", F.lit(1)), ["k"], [F.col("score").desc_nulls_last()], F.lit(1), "pos", "n")
    assert sized.agg(F.max("pos"), F.min("n"), F.countDistinct("pos")).first() == (20_000, 20_000, 20_000)
    import glob
    import os

    import pyarrow.parquet as pq

    from runledger.session import scratch_root
    folder = max(glob.glob(scratch_root(spark) + "/dealt-*"), key=os.path.getmtime)
    sizes = sorted(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(folder + "/*.parquet"))
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and len(sizes) >= 7


def test_quantiles_equal_percentiles(spark):
    df = rows(spark).withColumn("v", F.when(F.col("id") % 5 > 0, F.col("v") / 7)).unionByName(
        spark.createDataFrame([(99, 1, None), (98, 1, 4.0), (None, 1, 1.0), (None, 2, 2.0)], "k int, id long, v double"))
    got = {r["k"]: (r["m"], r["p"]) for r in quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect()}
    want = {r["k"]: (r["m"], r["p"]) for r in df.groupBy("k").agg(F.median("v").alias("m"), F.percentile("v", 0.95).alias("p")).collect()}
    assert want.pop(99) == (None, None) and got.keys() == want.keys()
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))
    assert [tuple(r) for r in values_at(df.where("k = 98"), [], "v", {"first": lambda n: F.lit(1), "none": lambda n: n + 1}).collect()] == [(1, 4.0, None)]


def test_deep_pages_equal_top_pages(spark):
    df = crowded(spark)
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    assert same(boards.page(df, order, 7, 300, top_rows=100), boards.page(df, order, 7, 300, top_rows=10_000))


def test_interval_join_equals_range_join(spark):
    import datetime
    import random

    rng = random.Random(5)
    day = datetime.datetime(2024, 3, 1)
    at = lambda s: day + datetime.timedelta(seconds=s)
    spans = [(i, at(rng.randrange(0, 600_000)), None) for i in range(300)]
    # half of all intervals lie in one hour; some are points, some end before they start, some have microseconds
    spans = [(i, a if i % 2 else at(3600 + i % 60), (a if i % 2 else at(3600 + i % 60)) + datetime.timedelta(
        seconds=rng.choice([0, 1, 59, 3600, 100_000, -5]), microseconds=rng.choice([0, 1, 500_000]))) for i, a, _ in spans] + [(900, None, at(5)), (901, at(5), None)]
    times = [(i, at(rng.randrange(0, 700_000)) if i % 3 else at(3600 + i % 90)) for i in range(500)] + [(990, None), (991, spans[0][1]), (992, spans[1][2])]
    a = spark.createDataFrame(times, "t long, ts timestamp")
    b = spark.createDataFrame(spans, "i long, starts_at timestamp, ends_at timestamp")
    got = sorted((r["t"], r["i"]) for r in queues.valid_at(a, b, "ts").collect())
    assert got == sorted((t, i) for t, x in times for i, s, e in spans if x and s and e and s <= x <= e)
    assert queues.valid_at(a, b.limit(0), "ts").count() == 0


def test_no_interval_is_broadcast(spark, monkeypatch, capsys):
    day = F.lit("2024-03-01").cast("timestamp")
    a = spark.range(40).select("id", (day + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))
    b = spark.range(2000).select(F.col("id").alias("i"), (day + F.make_dt_interval((F.col("id") % 30).cast("int"))).alias("starts_at"))
    b = b.withColumn("ends_at", F.col("starts_at") + F.make_dt_interval(F.lit(14)))
    few = queues.valid_at(a, b, "ts")
    few.explain()
    plan = capsys.readouterr().out
    # the look-ups are the side that is sent, whatever the size checks say
    assert "BroadcastHashJoin" in plan and ("BuildLeft" in plan) and ("BuildRight" not in plan)
    monkeypatch.setattr(queues, "SENT_LOOKUPS", 100)
    many = queues.valid_at(a, b, "ts")
    many.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert few.count() > 20_000 and same(few, many)


def test_interval_cells_are_few_and_exact(spark):
    df = spark.createDataFrame([(3, 1000), (-7, 9), (8, 15), (5, 5), (0, 2**21 - 2)], "a long, b long").withColumn("c", queues.dyadic_cells(F.col("a"), F.col("b"), 20))
    for r in df.collect():
        covered = sorted(x for c in r["c"] for x in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"]))
        assert covered == list(range(r["a"], r["b"] + 1)) and len(r["c"]) <= 42
