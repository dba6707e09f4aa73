"""Spark session settings shared by the library, the tests and the bench.

The library never creates a session behind the caller's back: every
operator takes the caller's ``SparkSession``.  ``build_session`` is a
convenience for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on.  They are applied to the caller's
# session by ``configure`` (they are all runtime-settable SQL confs).
REQUIRED_CONF = {
    # Stored times are UTC instants; the test data is NTZ and is read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # P20: map merge where the newer map wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, turn joins into broadcasts when the real size allows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mnemospark", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
    )
    for key, value in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder
    and is used as is; without one this raises there.  Only in local mode
    (tests, a laptop) a fresh folder under the system temp directory is
    created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        sc = None
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    master = sc.master if sc is not None else "a remote session"
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set on {master}; name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="mnemospark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables (exports, snapshots, stores).

    It lives next to the checkpoints, in the shared folder the session
    names, so every executor sees it.  ``mnemospark.work.dir`` overrides.
    """
    root = spark.conf.get("mnemospark.work.dir", None)
    if not root:
        root = ensure_checkpoint_dir(spark).rstrip("/") + "/mnemospark-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table in the shared work
    folder and reading it back: the plan runs once, later stages (and a
    retry after a lost executor) start from the files."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
