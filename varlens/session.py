"""Session helpers.

Library functions never build their own session: they take DataFrames.  The
helpers here are for tests, ``bench.py`` and scripts, plus the one place where
the library needs a session setting (the checkpoint directory).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run of this library wants: AQE re-plans joins and partition
# counts from runtime sizes (this is what turns a join with a small side into a
# broadcast only after its size is known), and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "varlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (a cluster passes its own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("VARLENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    is.  Only in local mode, when nothing is set, a fresh scratch folder is
    made; on a cluster a folder of the driver's own would lose data, so that
    raises.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="varlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured
