"""File numbering (A1, S5) and time-ordered ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import place_in_group

ID_TICK_MICROS = 10_000   # 10 ms ticks
ID_SEQ_BITS = 24          # ids per tick: 2**24


def file_numbers(listing: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """A1: highest run number per ``(base, ext)`` from a file listing and
    the next number to use (S5 auto-increment); names without a number
    are returned apart.  One partial aggregate, no driver loop."""
    stem, ext = X.split_extension(path_col)
    parsed = listing.select(F.col(path_col), stem.alias("_stem"), ext.alias("ext"))
    base, num = X.split_number("_stem")
    parsed = parsed.select(path_col, base.alias("base"), "ext", num.alias("num"))
    runs = (parsed.filter(F.col("num").isNotNull()).groupBy("base", "ext")
            .agg(F.max("num").alias("last_run"), F.count(F.lit(1)).alias("files"))
            .withColumn("next_run", F.col("last_run") + 1))
    plain = parsed.filter(F.col("num").isNull()).select(path_col, "base", "ext")
    return runs, plain


def time_ordered_ids(df: DataFrame, ts_col: str, order_col: str, epoch: str) -> DataFrame:
    """64-bit ids ordered by time: ``tick << 24 | n`` where ``tick`` is
    10 ms since ``epoch`` and ``n`` numbers the rows of one tick in
    ``order_col`` order.  A tick with many rows is numbered by several tasks;
    more than 2**24 rows in one tick raises."""
    e = dt.datetime.fromisoformat(epoch)
    epoch_us = int((e - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    tick = F.floor((F.unix_micros(F.col(ts_col)) - F.lit(epoch_us)) / F.lit(ID_TICK_MICROS)).cast("long")
    return (place_in_group(df.withColumn("_tick", tick), ["_tick"], [order_col], "_n")
            .withColumn("msg_id", F.when(F.col("_n") < F.lit(1 << ID_SEQ_BITS),
                                         F.shiftleft(F.col("_tick"), ID_SEQ_BITS) + F.col("_n"))
                        .otherwise(F.raise_error(F.lit("more than 2**24 ids in one 10 ms tick"))))
            .drop("_tick", "_n"))
