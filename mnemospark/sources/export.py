"""Numbered export runs.

``export_run`` writes a frame under ``root/name/date=YYYY-MM-DD/run=N``.
With ``auto_increment`` N is one more than the highest run recorded for
that name (the first run is 1); without it the newest run is appended to,
in its own folder, on whatever day that was started.

A run is recorded, with its day, before its first rows, as a one-row JSON
table in ``root/name/_runs``, so a number is never given twice and the next
one is one small read.  Each export writes one folder ``batch=<id>`` of the
run and overwrites it: a retry with the same id and run rewrites itself.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import csv_io

RUNS_SCHEMA = "run long, date string, created string"


def _newest(spark, base: str):
    """The record of the newest run, or None."""
    try:
        runs = spark.read.schema(RUNS_SCHEMA).json(f"{base}/_runs")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no run yet
            return None
        raise
    return runs.agg(F.max_by(F.struct("run", "date"), "run").alias("r")).first()["r"]


def last_run(spark, root: str, name: str) -> int | None:
    newest = _newest(spark, f"{root.rstrip('/')}/{name}")
    return None if newest is None else int(newest["run"])


def export_run(df: DataFrame, root: str, name: str, date: dt.date | None = None,
               auto_increment: bool = True, fmt: str = "csv", compression: str | None = None,
               batch_id: str | None = None, run: int | None = None) -> str:
    """Write ``df`` as the next (or the newest) run; returns the run folder.

    A caller that may have to repeat an export names it (``batch_id``) and
    on the retry gives the ``run`` it was writing: then the rows stand there
    once, also after a crash halfway."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("fmt must be 'csv' or 'parquet'")
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    newest = _newest(spark, base)
    if run is not None:
        known = (spark.read.schema(RUNS_SCHEMA).json(f"{base}/_runs").filter(F.col("run") == run).first()
                 if newest is not None else None)
        if known is None:
            raise ValueError(f"no run {run} of {name!r} is recorded")
        day = known["date"]
    elif newest is not None and not auto_increment:
        run, day = int(newest["run"]), newest["date"]
    else:
        run = 1 if newest is None else int(newest["run"]) + 1
        day = (date or dt.datetime.now(dt.timezone.utc).date()).isoformat()
        rec = {"run": run, "date": day, "created": dt.datetime.now(dt.timezone.utc).isoformat()}
        (spark.createDataFrame([rec], RUNS_SCHEMA).coalesce(1).write.mode("errorifexists")
         .json(f"{base}/_runs/run={run}"))
    path = f"{base}/date={day}/run={run}"
    out = f"{path}/batch={batch_id or uuid.uuid4().hex}"
    if fmt == "csv":
        csv_io.write_csv(df, out, mode="overwrite", compression=compression)
    else:
        w = df.write.mode("overwrite")
        (w.option("compression", compression) if compression else w).parquet(out)
    return path


def read_run(spark, path: str) -> DataFrame:
    """The rows of a CSV run, of all its batches."""
    return csv_io.read_csv(spark, f"{path}/batch=*")
