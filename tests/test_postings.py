"""Stored keyword index (K7, K9): equal to the search without one, and what a
search reads."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import keyword as KW
from mnemospark.session import work_dir


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"alpha w{i % 7} w{i % 11} " + "the " * (i % 5) + ("rare" if i % 50 == 3 else "")) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "Alpha, ALPHA! <b>the</b>"), (903, "alpha alpha the")]
    return spark.createDataFrame(rows, "id long, t string")


@pytest.fixture(scope="module")
def index(spark, docs):
    idx = KW.Postings(spark, work_dir(spark, "t-postings"), "id", buckets=16)
    for part in range(3):
        idx.add(docs.filter(F.col("id") % 3 == part), "t", str(part))
    return idx


def _rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["alpha rare", "the", "w3 w5 the", "missing", "missing rare"])
def test_index_equals_search_without_one(docs, index, query):
    plain = docs.withColumn("t", F.coalesce("t", F.lit("")))
    assert _rows(index.top_k(query, 7)) == _rows(KW.bm25_top_k(plain, "id", "t", query, 7))


def test_a_repeated_part_is_replaced(spark, docs, index):
    before = _rows(index.top_k("alpha rare the", 9))
    index.add(docs.filter(F.col("id") % 3 == 1), "t", "1")
    assert _rows(index.top_k("alpha rare the", 9)) == before
    with pytest.raises(ValueError):
        index.add(docs, "t", "a/b")


def test_a_search_reads_its_terms_only(index):
    plan = index.top_k("rare w3", 3)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "tf" in line.split("[", 1)[1]]
    assert scans and all("bucket#" in s.split("PartitionFilters:")[1].split("PushedFilters")[0] for s in scans)
    assert all("In(term, [rare,w3])" in s for s in scans)


def test_a_frequent_term_is_dealt_to_several_tasks(spark):
    docs = spark.range(4000).select("id", F.lit("same").alias("t"))
    idx = KW.Postings(spark, work_dir(spark, "t-hot"), "id", buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows are one task else
    idx.add(docs, "t", "0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(idx.root + "/postings").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1 and idx.top_k("same", 2).count() == 2


def test_empty_index(spark):
    idx = KW.Postings(spark, work_dir(spark, "t-none"), "id")
    idx.add(spark.createDataFrame([(1, None)], "id long, t string"), "t", "0")
    assert idx.top_k("one").collect() == []
    idx.add(spark.createDataFrame([(2, "one two")], "id long, t string"), "t", "1")
    assert _rows(idx.top_k("one", 3))[0][0] == 2
