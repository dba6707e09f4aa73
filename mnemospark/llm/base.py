"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.session import work_dir

__all__ = ["documents", "global_rank", "materialize", "row_key", "text_or_empty", "with_spans"]

#: Columns of ``documents`` that the pipeline hands from stage to stage.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the session's shared folder and reads it
    back: the plan runs once, and what a lost executor held is read again."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit columns that name a row by its id and whole text.  They are
    never null and do not depend on how the table is split, so two scans of
    the same table agree; rows that repeat id and text share the key."""
    return [F.xxhash64(F.col(id_col), F.col(id_col).isNull()).alias("_k1"),
            F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("_k2")]


def global_rank(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """``df`` with ``col``: the row's place, from 0, in the order of ``keys``.

    The rows are dealt by range and sorted in each range; a row's place is
    its place in the range plus the rows of earlier ranges.  Only the counts
    (one row for each range) meet in one task.
    """
    ranged = (df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = materialize(ranged, name).withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(before), "_part").withColumn(col, place)
            .drop("_part", "_at", "_before"))


SPANS = "array<struct<at:int,text:string>>"


def with_spans(df: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """``df`` with a column for each pattern: all its matches in ``text`` as
    structs ``(at, text)`` in order; ``at`` counts code points from 0.

    The pieces between the matches give the positions, so a pattern must not
    match the empty string.  Positions are running sums in pieces of
    ``PIECE`` matches, so the time grows with the matches and not with their
    square.  Null text: no matches.  Names that start with ``_`` and a
    pattern's own name are replaced.
    """
    none = F.array().cast(SPANS)
    found = df.withColumns({f"_hit_{n}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    found = found.withColumns({f"_size_{n}": F.when(F.size(f"_hit_{n}") > 0, F.zip_with(
        F.slice(F.split(text, p, -1), F.lit(1), F.size(f"_hit_{n}")), F.col(f"_hit_{n}"),
        lambda g, h: F.length(g) + F.length(h))) for n, p in patterns.items()})
    found = found.withColumns({f"_piece_{n}": _pieces(f"_size_{n}") for n in patterns})
    found = found.withColumns({f"_before_{n}": _running(F.col(f"_piece_{n}"), lambda x: F.element_at(x, -1), inclusive=False)
                               for n in patterns})
    spans = {}
    for n in patterns:
        ends = F.flatten(F.zip_with(f"_piece_{n}", f"_before_{n}", lambda p, b: F.transform(p, lambda x: x + b)))
        spans[n] = F.coalesce(F.zip_with(ends, f"_hit_{n}", lambda e, h: F.struct(
            (e - F.length(h)).alias("at"), h.alias("text"))), none)
    return found.withColumns(spans).drop(*[f"_{k}_{n}" for n in patterns for k in ("hit", "size", "piece", "before")])


#: Matches whose positions are summed up together.
PIECE = 64


def _pieces(sizes: str) -> Column:
    """Running sums of a column of sizes, apart in each piece of it."""
    return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(PIECE)), lambda at: _running(
        F.slice(sizes, at + 1, F.lit(PIECE)), lambda x: x, inclusive=True))


def _running(sizes: Column, of, inclusive: bool) -> Column:
    """Sums of ``of`` over the items before each, itself too if ``inclusive``."""
    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + of(x)
        return F.struct(end.alias("end"), F.array_append(acc["out"], end if inclusive else acc["end"]).alias("out"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda a: a["out"])
