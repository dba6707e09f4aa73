"""Places within groups, for groups of any size.

A window per group gives a hot thread or tick to one task.  Here the rows are
dealt by ranges of ``(group, order)``, so a large group lies in several ranges,
and a row's place is its place in the range plus the group's rows in earlier
ranges.  Only the first group of a range can have earlier rows: at most one
row per range is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PLACE_BITS = 33  # Spark keeps the place in a partition in the low 33 bits


def place_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: the row's place, from 0, among the rows of equal
    ``group`` in ``order``.  Null groups are one group, null order values come
    first; rows equal in ``order`` get different places in no fixed order.
    The sorted rows are written once, so that a row keeps its place when a
    task is run again.  Names that start with ``_place`` are taken."""
    keys = [*group, *order]
    ranged = (df.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
              .withColumn("_place_at", F.monotonically_increasing_id()))
    dealt = materialize(ranged, "places").withColumn("_place_part", F.shiftright("_place_at", _PLACE_BITS))
    return (_with_earlier(dealt, list(group))
            .withColumn(out, F.col("_place_local") + F.coalesce(F.col("_place_earlier"), F.lit(0)))
            .drop("_place_at", "_place_part", "_place_local", "_place_earlier"))


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before each in
    ``order`` (nulls first; 0 for the first row).  Rows are summed up in ranges;
    only the ranges' totals meet in one task.  Names that start with
    ``_total`` are taken."""
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in order])
                         .withColumn("_total_part", F.spark_partition_id()), "totals")
    earlier = Window.orderBy("_total_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy("_total_part").agg(F.sum(value).alias("_total_n"))
              .select("_total_part", F.coalesce(F.sum("_total_n").over(earlier), F.lit(0)).alias("_total_before")))
    within = Window.partitionBy("_total_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_total_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
            .join(F.broadcast(before), "_total_part")  # a row for each range
            .withColumn(out, F.col("_total_before") + F.col("_total_local"))
            .drop("_total_part", "_total_local", "_total_before"))


def _with_earlier(dealt: DataFrame, group: list[str]) -> DataFrame:
    local = Window.partitionBy(*group, "_place_part").orderBy("_place_at")
    before = Window.partitionBy(*group).orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_place_part").agg(F.count(F.lit(1)).alias("_place_n"))
    continued = (counts.withColumn("_place_earlier", F.sum("_place_n").over(before))
                 .filter(F.col("_place_earlier").isNotNull())  # one row per range at most
                 .select(F.col("_place_part").alias("_place_p"), "_place_earlier",
                         *[F.col(c).alias(f"_place_g{i}") for i, c in enumerate(group)]))
    same = F.col("_place_part") == F.col("_place_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_place_g{i}"))
    numbered = dealt.withColumn("_place_local", F.row_number().over(local) - 1)
    return (numbered.join(F.broadcast(continued), same, "left")
            .drop("_place_p", *[f"_place_g{i}" for i in range(len(group))]))
