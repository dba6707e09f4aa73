"""Stored column profiles that add up (A5).

Each chunk of a table (a day, an hour) is scanned once, when it is stored: per
column its rows, NULLs, least and greatest value, an HLL sketch of the values
and, for numbers, a KLL sketch of their distribution.  A profile of the whole
table or of a range of chunks combines those rows and reads no data again.

Bounds: the relative standard error of a distinct count is
``distinct_error(lg_k)`` (1.6 % at ``lg_k`` = 12; counts up to some hundred are
exact), a quantile's rank is off by ``QUANTILE_RANK_ERROR`` at most with 99 %
confidence.  A chunk's sketches have a bounded size (4 KB and some 5 KB a
column), whatever its rows.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K = 12
KLL_K = 200
QUANTILE_RANK_ERROR = 0.0166  # of a sketch with k = 200
QUANTILES = (0.25, 0.5, 0.75)

_STORED = ("position int, column_name string, data_type string, rows long, null_count long, lo_long long, hi_long long, "
           "lo_double double, hi_double double, lo_text string, hi_text string, distinct binary, spread binary")


def distinct_error(lg_k: int = LG_K) -> float:
    return 1.04 / sqrt(1 << lg_k)


def _ordered(c: Column, t: T.DataType) -> tuple[str, Column] | None:
    """The stored kind and the value whose order is the column's own."""
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "long", c.cast("long")
    if isinstance(t, T.DateType):
        return "long", F.unix_date(c).cast("long")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "long", F.unix_micros(c.cast("timestamp"))
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "double", c.cast("double")
    if isinstance(t, T.StringType):
        return "text", c
    return None


def _hashed(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(t)  # the two zeros are one value
    return F.when(c.isNotNull(), F.xxhash64(c))


def chunk_sketches(df: DataFrame, chunk_col: str, lg_k: int = LG_K) -> DataFrame:
    """``chunk`` (text) and a row for each other column; one pass.  Columns of
    map type are left out; arrays and structs have no range and decimals are
    profiled as doubles.  No rows: no chunk."""
    fields = [f for f in df.schema.fields if f.name != chunk_col and not isinstance(f.dataType, T.MapType)]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        kind, value = _ordered(c, f.dataType) or ("", None)
        aggs += [F.count_if(c.isNull()).alias(f"_n{i}"), F.hll_sketch_agg(_hashed(c, f.dataType), lg_k).alias(f"_d{i}")]
        if value is not None:
            aggs += [F.min(value).alias(f"_lo{i}"), F.max(value).alias(f"_hi{i}")]
        number = isinstance(f.dataType, T.NumericType)
        if number:
            aggs.append(F.kll_sketch_agg_double(c.cast("double"), KLL_K).alias(f"_q{i}"))
        ends = [(F.col(f"_{end}{i}") if kind == k else F.lit(None)).cast(t)
                for k, t in (("long", "long"), ("double", "double"), ("text", "string")) for end in ("lo", "hi")]
        values = [F.lit(i), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col("_rows"), F.col(f"_n{i}"), *ends,
                  F.col(f"_d{i}"), (F.col(f"_q{i}") if number else F.lit(None)).cast("binary")]
        rows.append(F.struct(*values).cast(f"struct<{_STORED.replace(' ', ':').replace(',:', ',')}>"))
    per = df.groupBy(F.col(f"`{chunk_col}`").cast("string").alias("chunk")).agg(*aggs)
    return per.select("chunk", F.explode(F.array(*rows)).alias("_r")).select("chunk", "_r.*")


def combine(stored: DataFrame) -> DataFrame:
    """One row for each column over all the chunks in ``stored``:
    ``position, column_name, data_type, rows, null_count, distinct_estimate,
    min_value, max_value, counted, quantiles``; ``counted`` is the number of
    values in the quantile sketch (null and ``quantiles`` null for columns
    that are no numbers)."""
    merged = stored.groupBy("position", "column_name", "data_type").agg(
        F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_estimate"),
        *[f(f"{end}_{k}").alias(f"{end}_{k}") for end, f in (("lo", F.min), ("hi", F.max)) for k in ("long", "double", "text")],
        F.count("spread").alias("_numbers"), F.kll_merge_agg_double("spread").alias("_spread"))
    counted = F.when(F.col("_numbers") > 0, F.kll_sketch_get_n_double("_spread"))
    return merged.withColumn("counted", counted).select(
        "position", "column_name", "data_type", "rows", "null_count", "distinct_estimate",
        _shown("lo").alias("min_value"), _shown("hi").alias("max_value"), "counted",
        F.when(F.col("counted") > 0, F.kll_sketch_get_quantile_double(
            "_spread", F.array(*[F.lit(q) for q in QUANTILES]))).alias("quantiles"))


def _shown(end: str) -> Column:
    n = F.col(f"{end}_long")
    as_long = (F.when(F.col("data_type") == "boolean", (n != 0).cast("string"))
               .when(F.col("data_type") == "date", F.date_from_unix_date(n.cast("int")).cast("string"))
               .when(F.col("data_type").startswith("timestamp"), F.timestamp_micros(n).cast("string"))
               .otherwise(n.cast("string")))
    return F.coalesce(as_long, F.col(f"{end}_double").cast("string"), F.col(f"{end}_text"))


class ProfileStore:
    """Sketch rows under ``path``, a folder for each chunk.  Storing a chunk
    again replaces its rows, so a repeated batch counts once; a chunk must be
    stored whole."""

    def __init__(self, spark: SparkSession, path: str, lg_k: int = LG_K):
        self.spark, self.path, self.lg_k = spark, path, lg_k

    def put(self, df: DataFrame, chunk_col: str) -> None:
        rows = chunk_sketches(df, chunk_col, self.lg_k)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(self.path))

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(f"{_STORED}, chunk string").parquet(self.path)

    def profile(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Over the chunks from ``first`` to ``last``, both included, in the
        order of their text (a partition filter); over all by default."""
        stored = self.chunks()
        if first is not None:
            stored = stored.filter(F.col("chunk") >= first)
        if last is not None:
            stored = stored.filter(F.col("chunk") <= last)
        return combine(stored)
