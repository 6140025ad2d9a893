"""Spark session and lineage helpers.

Library code never invents storage locations: lineage is cut only in the
shared folder the cluster names in ``spark.checkpoint.dir``.  Tests (and the
local bench) may set one when the session has none.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lookups, grids and threshold tables are broadcast explicitly behind a
    # size check; the automatic threshold stays at Spark's 10 MB default.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def _default_driver_memory() -> str:
    """Local mode: 60 % of physical memory, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_spark(master: str | None = None, app: str = "casework",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """The running session as it is, or a new one with the engine defaults.

    Master, driver memory and shuffle partitions are only set when asked for
    (benches and tests do); else they come from the launcher."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    conf = dict(_DEFAULTS)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # the driver JVM is the only executor
            conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", _default_driver_memory())
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's ``spark.checkpoint.dir``; set ``fallback`` only when
    it is unset (tests and local benches)."""
    d = checkpoint_dir(spark)
    if not d:
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        d = fallback
    return d


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for files between steps: ``spark.checkpoint.dir``.
    Only a local session that names none (tests, benches) gets a scratch folder."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        import tempfile
        d = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="casework-ckpt-"))
    return d.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for iterative / multi-pass operators.

    Uses the shared folder named by ``spark.checkpoint.dir``.  Only when the
    session names none (local runs and tests) a scratch folder is set up,
    as the session contract allows; on a cluster the setting is always given.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: a table of up to so many rows is sent to every worker by ``few_rows``
FEW_ROWS = 100_000


def few_rows(df: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """``df`` for a join with a large table: broadcast if it has at most
    ``limit`` rows.  Without the hint a table of a few keys is exchanged by key,
    however small it is (adaptive execution does not broadcast a side whose
    partitions are mostly empty), and a key's rows then lie in one task."""
    held = materialize(df)
    return F.broadcast(held) if held.count() <= limit else held
