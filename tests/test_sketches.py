"""Stored profiles: exact parts, bounds of the sketches, plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import sketches as SK
from mnemospark.session import work_dir
from mnemospark.sources.tables import table
from tests.conftest import SF_MID


def _stored(spark, df, chunk):
    store = SK.ProfileStore(spark, work_dir(spark, "t-sketches"))
    store.put(df, chunk)
    return store


def test_sketches_are_within_their_bounds(spark):
    rows = table(spark, SF_MID, "lineitem").withColumn("_month", F.date_format("l_shipdate", "yyyy-MM"))
    got = {r.column_name: r for r in _stored(spark, rows, "_month").profile().collect()}
    names = [c for c in rows.columns if c != "_month"]
    exact = rows.agg(*[F.countDistinct(c).alias(c) for c in names]).first()
    for c in names:
        assert got[c].distinct_estimate == pytest.approx(exact[c], rel=3 * SK.distinct_error(), abs=1)
    numbers = [c for c in names if got[c].quantiles]
    assert set(numbers) >= {"l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber"}
    for c in numbers:
        ranks = rows.agg(*[e for q in got[c].quantiles for e in (F.avg((F.col(c) < q).cast("int")), F.avg((F.col(c) <= q).cast("int")))])
        ranks = ranks.first()
        for k, q in enumerate(SK.QUANTILES):
            assert ranks[2 * k] - SK.QUANTILE_RANK_ERROR <= q <= ranks[2 * k + 1] + SK.QUANTILE_RANK_ERROR
        assert got[c].counted == got[c].rows


def test_edge_values_and_replay(spark):
    schema = ("day string, n int, x double, d date, t timestamp, ok boolean, s string, a array<int>, m map<string,int>, "
              "p decimal(10,2), none int")
    day, at = dt.date(1969, 12, 30), dt.datetime(1960, 1, 1, 0, 0, 0, 5)
    rows = [("a", -5, -0.0, day, at, False, "", [1], {"k": 1}, 3, None), ("a", 7, 0.0, day, at, True, "é", [1], {}, 1, None),
            ("b", None, None, None, None, None, None, None, None, None, None), ("b", 7, 1e300, day, at, True, "", [2], {}, 2, None),
            (None, 7, float("nan"), day, at, True, "z", [], {}, 2, None)]
    df = spark.createDataFrame([(*r[:9], None if r[9] is None else __import__("decimal").Decimal(r[9]), r[10]) for r in rows], schema)
    store = _stored(spark, df, "day")
    store.put(df.filter("day = 'b'"), "day")
    got = {r.column_name: r for r in store.profile().collect()}
    assert set(got) == set(df.columns) - {"day", "m"}
    assert all(r.rows == 5 for r in got.values()) and got["n"].null_count == 1 and got["none"].null_count == 5
    assert (got["n"].min_value, got["n"].max_value, got["n"].distinct_estimate) == ("-5", "7", 2)
    assert got["x"].distinct_estimate == 3 and got["d"].min_value == "1969-12-30"
    assert got["t"].min_value == "1960-01-01 00:00:00.000005" and (got["ok"].min_value, got["ok"].max_value) == ("false", "true")
    assert (got["s"].min_value, got["s"].max_value, got["s"].distinct_estimate) == ("", "é", 3)
    assert got["a"].min_value is None and got["a"].distinct_estimate == 3
    assert got["none"].quantiles is None and got["s"].counted is None and got["p"].counted == 4
    only = {r.column_name: r.rows for r in store.profile("b", "b").collect()}
    assert set(only.values()) == {2}
    assert _stored(spark, df.limit(0), "day").chunks().count() == 0


def test_profile_reads_the_named_chunks_only(spark):
    df = spark.range(1000).withColumn("day", (F.col("id") % 10).cast("string"))
    plan = _stored(spark, df, "day").profile("3", "4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and plan.count("FileScan") == 1


def test_a_chunk_is_scanned_once(spark):
    plan = SK.chunk_sketches(table(spark, SF_MID, "events"), "event_type")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
