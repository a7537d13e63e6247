"""Session helpers: defaults for local work and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "vouchsafe", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session, whose tasks share a disk, may go without one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named is None and current is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if current is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once to reliable storage so that nothing upstream runs again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
