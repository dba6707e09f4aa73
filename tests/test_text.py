"""Text, name and numbering expressions on the fixture rows."""

from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.operators import inventory as INV


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col.alias("o")).first().o


def test_think_tags(spark):
    assert one(spark, X.strip_think(F.col("v")), "a<think>x\ny</think>b<think>z</think>c") == "abc"


def test_instruction(spark):
    got = one(spark, X.instruct(F.col("v"), "T"), "how much protein should a female eat")
    assert got == "Instruct: T\nQuery: how much protein should a female eat"


def test_file_name_validity(spark):
    cases = {"ok": True, "con.txt": False, "COM0": True, "a?b": False, "a.": False, "a ": False,
             "": False, ".con": True, "con.a.b": True}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.o for r in df.select("v", X.valid_file_name("v").alias("o")).collect()}
    assert got == cases
    assert one(spark, X.valid_file_name(F.col("v")), None) is False


def test_force_extension(spark):
    df = spark.createDataFrame([("data.txt",), ("data",), ("data.CSV",), (" x.csv ",), ("con.csv",)], "v string")
    got = [r.o for r in df.select(X.force_extension("v", "csv").alias("o")).collect()]
    assert got == ["data.csv", "data.csv", "data.CSV", "x.csv", None]


def test_numbering(spark):
    df = spark.createDataFrame([("out_2025-01-02_3.csv",), ("out_2025-01-02_12.csv",), ("plain.csv",)], "path string")
    runs, plain = INV.file_numbers(df)
    r = runs.first()
    assert (r.base, r.ext, r.last_run, r.next_run, r.files) == ("out_2025-01-02", ".csv", 12, 13, 2)
    assert [p.path for p in plain.collect()] == ["plain.csv"]


def test_append_date(spark):
    df = spark.createDataFrame([("report",), ("r_2024-05-06",)], "v string")
    got = [r.o for r in df.select(X.append_date("v", F.lit("2025-01-02").cast("date")).alias("o")).collect()]
    assert got == ["report_2025-01-02", "r_2024-05-06"]


def test_formats(spark):
    df = spark.createDataFrame([("u", "hi")], "s string, t string")
    r = df.select(X.speaker_line("s", "t").alias("a"), X.input_reply("t", F.lit("yo")).alias("b"),
                  X.page_line(F.lit(1), F.lit(2), F.lit("@u"), F.col("t")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("u: hi", "**Input**: hi \n\nyo", "Page 1/2: @u hi")


def test_ordered_ids_increase_with_time(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00.001"), (2, "2024-01-01 00:00:00.002"),
                                (3, "2024-01-01 00:00:00.020")], "id long, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    ids = [r.msg_id for r in INV.time_ordered_ids(df, "ts", "id", "2024-01-01 00:00:00").orderBy("id").collect()]
    assert ids == [0, 1, 2 << 24]
