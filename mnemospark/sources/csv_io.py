"""CSV sources and sinks.

The CSV form holds the ten store columns in declared order, the vector
as ``[a, b, ...]`` text and times as ISO text with offset.  Fields are
quoted RFC-4180 style (quote doubled), so texts may hold quotes and
newlines; reading uses ``multiLine``, which gives a file to one task.  In the
line-safe form line breaks and backslashes in texts are written as ``\\n``,
``\\r`` and ``\\\\``: a record is one line, so a file is cut into byte ranges
that several tasks read.  Compression is chosen by option on write and
inferred from the file extension on read (S3); of the codecs only bzip2 and
none can be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import parse_vector, vector_is_valid, vector_to_text
from ..operators.numbering import running_total
from ..plans.broadcast import checked_broadcast
from ..schema import CSV_SCHEMA, STORE_FIELDS
from ..session import materialize

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "timestampFormat": TS_FORMAT,
               "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Columns that hold free text.
TEXT_FIELDS = [f.name for f in CSV_SCHEMA.fields
               if f.dataType.simpleString() == "string" and f.name in STORE_FIELDS and f.name != "embedding"]


def one_line(text: str) -> Column:
    """The text without line breaks; ``many_lines`` restores it."""
    out = F.replace(F.col(text), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def many_lines(text: str) -> Column:
    """Inverse of ``one_line``.  A pair of backslashes ends a piece, so what
    is left in a piece are line breaks only."""
    pieces = F.split(F.col(text), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(
        p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")


def to_csv_frame(df: DataFrame) -> DataFrame:
    """The CSV columns in fixed order; vectors as JSON text (P5)."""
    return df.select(*[vector_to_text("embedding").alias("embedding") if c == "embedding" else F.col(c)
                       for c in STORE_FIELDS])


def write_csv(df: DataFrame, path: str, mode: str = "append", compression: str | None = None,
              line_safe: bool = False) -> None:
    """Append (or overwrite) records with a header per file.
    An empty frame writes a header-only part, so the target exists."""
    rows = to_csv_frame(df)
    if line_safe:
        rows = rows.withColumns({c: one_line(c) for c in TEXT_FIELDS})
    w = rows.write.mode(mode).options(**CSV_OPTIONS)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, line_safe: bool = False) -> DataFrame:
    """Typed read with the fixed schema.  A malformed line keeps its
    raw text in ``_corrupt`` (PERMISSIVE) and becomes a reject; the
    vector is parsed element by element (P4) and checked as a whole.
    ``line_safe`` names the form the files were written in."""
    raw = (spark.read.schema(CSV_SCHEMA).options(**CSV_OPTIONS)
           .option("multiLine", "false" if line_safe else "true").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").csv(path))
    if line_safe:
        raw = raw.withColumns({c: many_lines(c) for c in TEXT_FIELDS})
    bad_vec = F.col("embedding").isNotNull() & ~vector_is_valid("embedding")
    return raw.select(
        *[c for c in STORE_FIELDS if c != "embedding"],
        parse_vector("embedding", "float").alias("embedding"),
        F.when(bad_vec & F.col("_corrupt").isNull(), F.lit("bad vector text")).otherwise(F.col("_corrupt"))
        .alias("_corrupt"),
    ).select(*STORE_FIELDS, "_corrupt")


def with_arrival(df: DataFrame) -> DataFrame:
    """Dense arrival numbers 0, 1, 2, ... in file-name and line order, so
    chunks of N arrival positions (S2) are chunks of N rows.

    The rows are written once with their input file, the byte range they
    were read from and their position (these depend on the physical plan, so
    they are fixed before reuse).  One small aggregate gives each range's row
    count and first position; running totals over the ranges, in two levels,
    give the offsets.  They are broadcast up to a counted bound; beyond it
    Spark joins them by range."""
    tagged = materialize(df.withColumn("_file", F.input_file_name())
                         .withColumn("_start", F.input_file_block_start())
                         .withColumn("_mid", F.monotonically_increasing_id()), "arrival")
    ranges = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = running_total(ranges, ["_file", "_start"], "_n", "_off").drop("_n")
    offsets, _, _ = checked_broadcast(offsets)
    return (tagged.join(offsets, ["_file", "_start"])
            .withColumn("seq", (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
            .drop("_file", "_start", "_mid", "_first", "_off"))
