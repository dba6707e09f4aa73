"""Reports over stored tables.

Each report is one aggregate job over the table; the profile computes
every column's statistics in a single pass (one ``agg`` with all
expressions) instead of one job per column.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_catalog(df: DataFrame, chunk_col: str = "chunk", ts_col: str = "timestamp") -> DataFrame:
    """A4: the time partitions with their range and size."""
    return df.groupBy(chunk_col).agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
                                     F.count(F.lit(1)).alias("rows"))


def dim_audit(df: DataFrame) -> DataFrame:
    """Rows per model and real vector length, with declared-length
    mismatches (C3)."""
    dim = F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long"))
    mism = F.col("embedding").isNotNull() & (F.size("embedding") != F.col("embedding_dim"))
    return (df.groupBy("embedding_model", dim.alias("dim"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(mism).alias("mismatched")))


_ORDERABLE = (T.NumericType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)


def table_profile(name: str, df: DataFrame, keys: dict[str, list[str]] | None = None,
                  comments: dict[str, str] | None = None) -> DataFrame:
    """A5: per column the declared type and nullability plus measured
    NULL count, approximate distinct count, min / max (as text) and
    whether the column alone is unique; plus exact uniqueness of the
    candidate keys in ``keys``.  All statistics in one aggregate pass,
    and one more pass per candidate key (a grouped count)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if isinstance(f.dataType, _ORDERABLE):
            aggs += [F.approx_count_distinct(c).alias(f"d{i}"),
                     F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        else:
            aggs += [F.lit(None).cast("long").alias(f"d{i}"), F.lit(None).cast("string").alias(f"lo{i}"),
                     F.lit(None).cast("string").alias(f"hi{i}")]
    stats = df.agg(*aggs)
    key_flags = {}
    for kname, cols in (keys or {}).items():
        most = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"))
        key_flags[kname] = (cols, F.coalesce(most.scalar(), F.lit(0)) <= 1)
    rows = []
    for i, f in enumerate(fields):
        in_keys = [k for k, (cols, _) in key_flags.items() if f.name in cols]
        rows.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
            F.col(f"n{i}").alias("null_count"), F.col(f"d{i}").alias("approx_distinct"),
            F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
            F.lit(",".join(in_keys)).alias("keys"),
            (reduce(and_, [key_flags[k][1] for k in in_keys]) if in_keys else F.lit(None).cast("boolean"))
            .alias("keys_unique"),
            F.lit((comments or {}).get(f.name)).cast("string").alias("comment"),
            F.col("__rows").alias("rows"),
        ))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_all(tables: dict[str, DataFrame], keys: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """A5 for every table of a catalogue: one profile per table, unioned."""
    out = None
    for name, df in tables.items():
        p = table_profile(name, df, (keys or {}).get(name))
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no tables to profile")
    return out


def describe_json(profile: DataFrame) -> DataFrame:
    """P25: one JSON text per table: name plus the list of column dicts."""
    cols = F.struct("column_name", "data_type", "nullable", "keys", "keys_unique", "comment")
    return (profile.groupBy("table_name")
            .agg(F.to_json(F.array_sort(F.collect_list(F.struct("position", cols.alias("c"))))).alias("_j"))
            .select("table_name", "_j"))
