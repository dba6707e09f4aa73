"""The message store: time-chunked parquet tables with integrity checks.

Layout of a store root::

    root/data/version=<n>/ingest_id=i-<id>/session_id=<s>/chunk=<c>/part-*.parquet
    root/_versions/version=<n>/part-*.json   one row per version

``chunk = floor(epoch micros / chunk micros)`` (S14, epoch aligned).  A
reader takes the newest version listed in ``_versions`` and prunes to
it; time searches also prune chunks.  Every write is a Spark job; the
driver only reads the small version table.

An append owns the folder of its ``ingest_id`` and overwrites it, so a replay
rewrites itself whatever an earlier attempt left, and nothing needs to record
how far that one came.  (The folder's name has a prefix, so that an id of
digits stays text.)
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import sign_words_expr
from ..operators import integrity as I
from ..schema import SHORT_TERM_CHUNK_SECONDS, STORE_FIELDS

WRITE_MODES = ("errorifexists", "overwrite", "append")
MANIFEST_SCHEMA = "rows long, min_ts string, max_ts string, checksum string"


def chunk_of(ts: Column | str, chunk_seconds: int) -> Column:
    """Epoch-aligned time chunk id of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(chunk_seconds * 1_000_000)).cast("long")


def prepare(df: DataFrame, session_id: str | Column, chunk_seconds: int) -> DataFrame:
    """Add the stored columns: ``session_id``, ``chunk``, the sign
    signature ``sig`` (read by two-stage search) and the text digest
    ``text_sha256`` (read by the unique-key clash check), each computed
    once here."""
    sid = F.lit(session_id) if isinstance(session_id, str) else session_id
    return df.withColumns({
        "session_id": sid,
        "chunk": chunk_of("timestamp", chunk_seconds),
        "sig": F.when(F.col("embedding").isNotNull(), sign_words_expr("embedding")),
        I.TEXT_DIGEST: I.text_digest("text"),
    })


def _layout(df: DataFrame) -> DataFrame:
    """Cluster rows by partition before writing: a range partitioning on
    ``(session_id, chunk, trans_id)`` gives each task a contiguous run of
    chunks (few files) and splits a hot chunk over several tasks."""
    return df.repartitionByRange("session_id", "chunk", "trans_id")


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:  # noqa: D401
    """Write prepared rows.  ``errorifexists`` fails on an existing
    table, ``overwrite`` replaces it, ``append`` adds."""
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    _layout(df).write.mode(mode).partitionBy("session_id", "chunk").parquet(path)


def _write_in_place(df: DataFrame, path: str, mode: str) -> None:
    """``write_rows`` of rows that were laid out before."""
    df.write.mode(mode).partitionBy("session_id", "chunk").parquet(path)


def _checked_id(ingest_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", ingest_id):
        raise ValueError("ingest_id may hold letters, digits, '_', '.' and '-' only")
    return ingest_id


class MessageStore:
    """A short- or long-term message store rooted at a shared path."""

    def __init__(self, spark: SparkSession, root: str, chunk_seconds: int = SHORT_TERM_CHUNK_SECONDS,
                 model: str = "testdata-64", dim: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.chunk_seconds, self.model, self.dim = chunk_seconds, model, dim

    # ------------------------------------------------------------ versions
    def _versions(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException
        try:
            return self.spark.read.schema(
                "version long, rows long, reason string, created string").json(f"{self.root}/_versions")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no version written yet
                return None
            raise

    def current_version(self) -> int | None:
        v = self._versions()
        if v is None:
            return None
        row = v.agg(F.max("version").alias("v")).first()
        return None if row is None or row["v"] is None else int(row["v"])

    def _record_version(self, version: int, rows: int, reason: str, mode: str = "overwrite") -> None:
        rec = {"rows": rows, "reason": reason, "created": dt.datetime.now(dt.timezone.utc).isoformat()}
        (self.spark.createDataFrame([rec], "rows long, reason string, created string")
         .coalesce(1).write.mode(mode).json(f"{self.root}/_versions/version={version}"))

    def _recorded_rows(self, version: int) -> int:
        """Rows a version was recorded with; -1 while its first write runs."""
        row = self._versions().filter(F.col("version") == version).agg(F.max("rows").alias("n")).first()
        return -1 if row["n"] is None else int(row["n"])

    def data_path(self, version: int) -> str:
        return f"{self.root}/data/version={version}"

    def ingest_path(self, version: int, ingest_id: str) -> str:
        return f"{self.data_path(version)}/ingest_id=i-{ingest_id}"

    def _write(self, rows: DataFrame, version: int | None, ingest_id: str, reason: str, writer=None) -> None:
        """Replaces what the ingest wrote before.  The version is recorded
        before its first rows, so that a replay finds what was written, and
        as holding rows once it does, so that lost files are an error."""
        if version is None:
            self._record_version(0, -1, reason)
        (writer or write_rows)(rows, self.ingest_path(version or 0, ingest_id), "overwrite")
        if self._recorded_rows(version or 0) <= 0:
            self._record_version(version or 0, rows.count(), reason, "append")

    def put(self, rows: DataFrame, ingest_id: str = "load") -> None:
        """Prepared rows as they are, without checks, into the current
        version (a first one if there is none)."""
        self._write(rows, self.current_version(), _checked_id(ingest_id), "load")

    # ------------------------------------------------------------ read
    def read(self) -> DataFrame:
        """The current version (empty store -> empty frame)."""
        from pyspark.errors import AnalysisException

        from ..schema import STORED_SCHEMA
        v = self.current_version()
        if v is None:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        try:
            return self.spark.read.parquet(self.data_path(v))
        except AnalysisException as e:
            # A version without rows has no files; any other loss is an error.
            if (e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
                    and self._recorded_rows(v) <= 0):
                return self.spark.createDataFrame([], STORED_SCHEMA)
            raise

    # ------------------------------------------------------------ write
    def append(self, batch: DataFrame, session_id: str, strict: bool = False,
               writer=None, unknown_col: str | None = None,
               corrupt_col: str | None = None, ingest_id: str | None = None,
               written: bool = False) -> tuple[DataFrame, DataFrame]:
        """S9/S8 + C1-C6: check a batch against the store and append the
        accepted rows.  ``strict``: any reject fails the whole batch and
        nothing is written (one transaction per frame).  ``writer``
        (S17): a user function ``(accepted, path, mode) -> None`` that
        replaces the default parquet write; ``path`` is the ingest's own
        folder and ``mode`` is ``overwrite``.  Returns the accepted and
        rejected rows (the rejects are the dead letter).

        ``ingest_id`` makes the append idempotent: a repeated call with the
        same id is checked against the store without its own earlier rows
        (same decisions, same rejects) and rewrites them.  Without one the
        append gets an id of its own.  ``written``: the batch is a written
        table, which the check need not write again.
        """
        prepared = prepare(batch, session_id, self.chunk_seconds)
        current = self.current_version()
        store = self.read() if current is not None else None
        if ingest_id is None:
            ingest_id = f"auto-{uuid.uuid4().hex}"
        elif store is not None:
            store = store.filter(F.col("ingest_id") != f"i-{_checked_id(ingest_id)}")
        # Decisions are written before the store is: the clash check reads
        # the store, so outputs evaluated after the append must not see it.
        accepted, rejected = I.check_batch(prepared, store, unknown_col, corrupt_col, written)
        if strict and not rejected.isEmpty():
            raise ValueError(f"batch refused: {rejected.count()} rejected rows")
        self._write(accepted, current, _checked_id(ingest_id), "create", writer)
        return accepted, rejected

    def load(self, batch: DataFrame, session_id: str, chunk_rows: int,
             ingest_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Bulk load in chunks of ``chunk_rows`` arrival positions (S2, A3):
        rows of the chunks before the first chunk with a reject are
        appended, that chunk and later ones are not.  Returns ``(loaded,
        rejected, report)`` where the report is A2 per chunk.  A repeated
        load with the same ``ingest_id`` rewrites itself."""
        prepared = prepare(batch, session_id, self.chunk_seconds)
        current = self.current_version()
        store = self.read() if current is not None else None
        if ingest_id is None:
            ingest_id = f"load-{uuid.uuid4().hex}"
        elif store is not None:
            store = store.filter(F.col("ingest_id") != f"i-{_checked_id(ingest_id)}")
        accepted, rejected = I.check_batch(prepared, store)
        loaded = I.prefix_commit(accepted, rejected, chunk_rows).drop("batch_id")
        self._write(loaded, current, _checked_id(ingest_id), "load")
        return loaded, rejected, I.load_report(accepted, rejected, chunk_rows)

    def promote(self, short_term: DataFrame, session_id: str, strict: bool = False,
                ingest_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Append the short-term rows that this store does not hold yet
        (C4-C6, stored rows win).  Returns the rows added and the rest with
        their reasons; ``strict`` adds all rows or none."""
        cols = [c for c in STORE_FIELDS if c in short_term.columns] + ["seq"]
        return self.append(short_term.select(*cols), session_id, strict=strict, ingest_id=ingest_id)

    def snapshot(self, dest: str, codec: str = "zstd") -> dict:
        """A compressed copy of the current version plus a manifest."""
        df = self.read()
        df.write.mode("errorifexists").option("compression", codec).parquet(dest)
        man = manifest(self.spark.read.parquet(dest))
        (self.spark.createDataFrame([man], MANIFEST_SCHEMA).coalesce(1)
         .write.mode("overwrite").json(dest + "_manifest"))
        return man

    def reset(self, keep: Column, snapshot_dest: str) -> int:
        """Session reset.  Refuses unless a snapshot of the current
        version exists and matches it; then writes the kept rows as a new
        version and points readers at it.  Returns the new version."""
        current = self.current_version()
        if current is None:
            raise ValueError("empty store")
        snap = self.spark.read.schema(MANIFEST_SCHEMA).json(snapshot_dest + "_manifest").first().asDict()
        live = manifest(self.read())
        if {k: snap[k] for k in live} != live:
            raise ValueError("snapshot does not match the store; refusing to reset")
        kept = self.read().filter(keep).drop("ingest_id")
        new = current + 1
        # one folder, so that many small appends become few files a chunk
        path = self.ingest_path(new, f"version-{new}")
        # The files of one ingest lie in ranges already; only those of several are dealt anew.
        several = self.read().select("ingest_id").distinct().limit(2).count() > 1
        (write_rows if several else _write_in_place)(kept, path, "errorifexists")
        written = self.spark.read.schema(kept.schema).parquet(path).count()
        self._record_version(new, written, "reset")
        return new


def manifest(df: DataFrame) -> dict:
    """Row count, time range and an order-free checksum (sum of a 64-bit
    row hash) of a table: one aggregate job, one row to the driver."""
    cols = [c for c in df.columns]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").cast("string").alias("min_ts"),
        F.max("timestamp").cast("string").alias("max_ts"),
        F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("checksum"),
    ).first()
    return {"rows": int(row["rows"]), "min_ts": row["min_ts"], "max_ts": row["max_ts"],
            "checksum": row["checksum"] or "0"}


def promote(short_term: DataFrame, long_term: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short-term rows not yet in the long-term store, checked with
    C4-C6 against it (stored rows win).  Returns (new rows, rejected)."""
    cols = [c for c in STORE_FIELDS if c in short_term.columns] + ["seq"]
    return I.check_batch(short_term.select(*cols), long_term.select(*cols))

