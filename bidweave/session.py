"""Session helpers: settings the operators rely on, and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when the split costs one more shuffle upstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # top-k per group keeps only k rows per group and task before the shuffle, also for wide k
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a scan of a bucketed table keeps its buckets: it opens those that a filter names, one task each
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    # long texts: a batch and its copies in the Python worker stay at a few megabytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # rows that are large themselves, such as posting blocks
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "bidweave", master: str | None = None, **conf) -> SparkSession:
    """Start (or get) a session; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Executors may be lost, so intermediate data must live on storage every node
    reads. A private folder is made only in local mode, when nothing is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
