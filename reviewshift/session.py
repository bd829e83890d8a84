"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on; a cluster deployment sets the rest
# (executor sizing, shuffle partitions, checkpoint dir) itself.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "reviewshift",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, the bench) without a configured dir
    gets a fresh scratch folder; a cluster must name a shared one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        # setCheckpointDir makes a fresh sub-folder on every call: only once
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for cluster runs")
    d = tempfile.mkdtemp(prefix="run-ckpt-", dir=os.environ.get("REVIEWSHIFT_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, name: str = "stage", spread_out: bool = True) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint dir
    and continue from it.

    One write job (``Dataset.checkpoint`` computes the plan twice: once to
    count, once to save), a fresh short lineage that survives executor
    loss, and file statistics that size-based join planning can use.
    """
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").mode("error").parquet(path)
    back = df.sparkSession.read.parquet(path)
    # small stage outputs pack into few input splits: spread them so per-row
    # work keeps every core busy; lookup tables that are broadcast or only
    # aggregated (spread_out=False) are read as they are
    return spread(back) if spread_out else back


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition a scan that yields fewer partitions than cores.

    A single-row-group file is one input split, which would run all
    per-row text work in one task. A wide scan (the cluster case: one
    split per block) is returned untouched, so no extra shuffle is added.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys) if keys else df.repartition(n)
