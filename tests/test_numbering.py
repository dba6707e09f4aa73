"""Places within groups: hot groups, nulls, ties, and the plan."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import conversation as C
from mnemospark.operators import inventory as INV
from mnemospark.operators import numbering as N


def test_places_match_a_plain_count(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3 + i]), i if i % 7 else None, f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g long, o long, t string").repartition(7)
    got = N.place_in_group(df, ["g"], ["o", "t"], "n").collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i for i, r in enumerate(mine)}
    assert {r["t"]: r["n"] for r in got} == want and got[0].asDict().keys() == {"g", "o", "t", "n"}


def test_hot_group_lies_in_several_ranges(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("g"), "id")
    found = {}

    def keep(rows, name):
        found["parts"] = rows.filter("g = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        path = f"{N_dir(spark)}/{name}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    from mnemospark.session import work_dir

    def N_dir(s):
        return work_dir(s, "t-places")

    old, N.materialize = N.materialize, keep
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        got = N.place_in_group(df, ["g"], ["id"], "n")
        assert found["parts"] >= 2
        assert got.filter("g = 0 and n <> id").count() == 0 and got.filter("g > 0 and n <> 0").count() == 0
        plan = got._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        N.materialize = old
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_empty_and_repeated_rows(spark):
    assert N.place_in_group(spark.range(0), [], ["id"], "n").count() == 0
    twice = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "g int, o int")
    assert sorted(tuple(r) for r in N.place_in_group(twice, ["g"], ["o"], "n").collect()) == [(1, 1, 0), (1, 1, 1), (2, 1, 0)]


def test_hot_tick_and_long_thread(spark):
    df = spark.range(5000).select("id", F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts"))
    ids = [r["msg_id"] for r in INV.time_ordered_ids(df, "ts", "id", "2024-01-01 00:00:00").orderBy("id").collect()]
    assert [i - ids[0] for i in ids] == list(range(5000))
    st = spark.range(3000).select(F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("msg_id"),
                                  (F.lit(2999) - F.col("id")).alias("seq"), F.lit("u").alias("role"),
                                  F.col("id").cast("string").alias("text"))
    got = C.prompt_rows(st, "be brief").orderBy("position").collect()
    assert [r["text"] for r in got] == ["be brief", *[str(i) for i in range(2999, -1, -1)]]
    assert [r["position"] for r in got] == list(range(3001))
