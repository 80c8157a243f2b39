"""Spark session helpers.

The library only relies on settings a cluster operator would set anyway: UTC session time zone,
ANSI mode (Spark 4 default), AQE with skew-join handling. Nothing here is needed on a cluster
where the session is already configured; ``ensure_session_defaults`` only fills gaps.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings that every job in the library assumes.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults; UI off."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SQL_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.sql.execution.arrow.pyspark.enabled"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Pin the UTC session zone (timestamps in the test Parquet are zone-less)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    On a cluster the operator sets ``spark.checkpoint.dir`` to shared storage and it is used as
    is. Where it is unset, a scratch folder is made for a local master (tests); any other master
    is refused, as its executors would write to disks that the others can't read."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder with master {master}")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a context, unless they find it on
    PYTHONPATH anyway. Needed by jobs that run the library's Python inside tasks."""
    sc = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(home)
    if getattr(sc, "_riskloom_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="riskloom-py-"), "riskloom-package"),
                               "zip", root, os.path.basename(home))
    sc.addPyFile(made)
    sc._riskloom_shipped = True
