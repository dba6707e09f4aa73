"""Command line for the batch jobs: bulk CSV load, backup (+ reset), search.

    python -m mnemospark load-csv --csv PATH --store ROOT [--session S] [--chunk-rows N]
    python -m mnemospark backup --store ROOT --out DIR [--reset-session S]
    python -m mnemospark search --store ROOT --vector "[...]" [--k 5] [--speaker S] [--days-ago N]

Every command runs Spark jobs on the session's cluster; only reports and
search results (k rows) are printed, as JSON lines.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import functions as F

from .schema import LONG_TERM_CHUNK_SECONDS
from .session import build_session, configure, ensure_checkpoint_dir


def _rows(df, limit=None):
    for r in (df.limit(limit) if limit else df).toLocalIterator():
        yield {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.asDict().items()}


def cmd_load_csv(spark, a) -> int:
    from .sources import csv_io
    from .sources.store import MessageStore
    rows = csv_io.with_arrival(csv_io.read_csv(spark, a.csv, line_safe=a.line_safe))
    store = MessageStore(spark, a.store, a.chunk_seconds)
    _, rejected, report = store.load(rows, a.session, a.chunk_rows)
    for r in _rows(report.orderBy("batch_id")):
        print(json.dumps({"chunk": r}))
    if a.dead_letter:
        rejected.write.mode("append").parquet(a.dead_letter)
    return 0


def cmd_backup(spark, a) -> int:
    from .sources import export
    from .sources.store import MessageStore
    store = MessageStore(spark, a.store, a.chunk_seconds)
    day = dt.datetime.now(dt.timezone.utc).date()
    csv_path = export.export_run(store.read().drop("sig", "text_sha256"), a.out, "csv", day,
                                 compression="gzip")
    snap = f"{a.out}/snapshot/{day.isoformat()}-v{store.current_version()}"
    man = store.snapshot(snap, codec=a.codec)
    print(json.dumps({"csv": csv_path, "snapshot": snap, "manifest": man}))
    if a.reset_session:
        v = store.reset(F.col("session_id") != a.reset_session, snap)
        print(json.dumps({"reset": a.reset_session, "version": v}))
    return 0


def cmd_search(spark, a) -> int:
    from .operators import search as S
    from .sources.store import MessageStore
    store = MessageStore(spark, a.store, a.chunk_seconds)
    q = [float(x) for x in json.loads(a.vector)]
    start = end = None
    if a.days_ago is not None:
        start, end = S.day_bounds(None, a.days_ago)
    top = S.search(store.read(), q, k=a.k, metric=a.metric, speaker=a.speaker, start=start, end=end,
                   chunk_seconds=a.chunk_seconds)
    for r in _rows(top):
        print(json.dumps(r))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("--chunk-seconds", type=int, default=LONG_TERM_CHUNK_SECONDS)
    sub = p.add_subparsers(dest="cmd", required=True)
    lc = sub.add_parser("load-csv")
    lc.add_argument("--csv", required=True)
    lc.add_argument("--store", required=True)
    lc.add_argument("--session", default="load")
    lc.add_argument("--chunk-rows", type=int, default=10_000)
    lc.add_argument("--dead-letter")
    lc.add_argument("--line-safe", action="store_true", help="the files hold escaped line breaks")
    bk = sub.add_parser("backup")
    bk.add_argument("--store", required=True)
    bk.add_argument("--out", required=True)
    bk.add_argument("--codec", default="zstd")
    bk.add_argument("--reset-session")
    se = sub.add_parser("search")
    se.add_argument("--store", required=True)
    se.add_argument("--vector", required=True)
    se.add_argument("--k", type=int, default=5)
    se.add_argument("--metric", default="cosine", choices=["cosine", "l2", "ip"])
    se.add_argument("--speaker")
    se.add_argument("--days-ago", type=int)
    a = p.parse_args(argv)
    spark = build_session()
    configure(spark)
    ensure_checkpoint_dir(spark)
    return {"load-csv": cmd_load_csv, "backup": cmd_backup, "search": cmd_search}[a.cmd](spark, a)


if __name__ == "__main__":
    sys.exit(main())
