"""Session helpers.

Library functions never build a session themselves; they take DataFrames. These
helpers are for tests, the bench and the driver entry point, plus the one place
that decides where intermediate files may be written (the shared checkpoint
folder of the cluster).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the analytics rely on. UTC makes day arithmetic on timestamps match
# the reference (it coerces every timestamp to UTC). AQE re-plans joins from
# runtime sizes (broadcast only when the shuffle output is actually small) and
# splits skewed partitions.
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "promolift", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (a cluster brings its own)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PROMOLIFT_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder and
    is used as is; without one a cluster session is refused, because executors
    don't see each other's local folders. A local session (tests) gets a fresh
    temp folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder (master is {master})")
        configured = tempfile.mkdtemp(prefix="promolift-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/promolift-{name}-{uuid.uuid4().hex[:12]}"


def remove_staged(spark: SparkSession, paths) -> None:
    """Delete staged folders (any Hadoop file system); missing ones are skipped."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df, label: str, staged: list[str] | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage (a lost executor re-reads files instead of
    recomputing upstream joins) and gives later scans column pruning and
    file statistics for join planning. The path is added to ``staged``, for a
    caller that removes its tables later (``remove_staged``)."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    if staged is not None:
        staged.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)   # known schema: no footer-inference job
