"""Durable run reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.schemas import SAMPLE_REPORT_SCHEMA

REPORT_VERSION = "3"
EMPTY_STEPS = "map<string,decimal(18,6)>"


def write_report(samples: DataFrame, path: str) -> None:
    """One partition per run; writing a run again replaces that run only."""
    (
        samples.withColumn("report_version", F.lit(REPORT_VERSION))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )


def load_report(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Samples of all runs, or of one (its partition only); columns older files lack are empty."""
    rows = spark.read.schema(SAMPLE_REPORT_SCHEMA).parquet(path)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.withColumn("step_durations", F.coalesce("step_durations", F.create_map().cast(EMPTY_STEPS)))


def write_strategy_report(samples: DataFrame, strategy: str, path: str) -> None:
    """The same report labelled with its strategy."""
    (
        samples.withColumn("report_version", F.lit(REPORT_VERSION)).withColumn("strategy", F.lit(strategy))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "run_id").parquet(path)
    )


def load_strategy_report(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    rows = load_report(spark, path)
    return rows if strategy is None else rows.where(F.col("strategy") == strategy)


def write_exports(tables: dict[str, DataFrame], path: str, *, fmt: str = "parquet", month: str | None = None) -> None:
    """Write export tables of completed documents; texts are kept to the letter.

    ``month`` names a column to partition by.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if month and month in df.columns:
            writer = writer.partitionBy(month)
        if fmt == "csv":
            # backslashes stay as they are and quotes are doubled, so any reader gets the same text
            writer = writer.option("header", "true").option("quoteAll", "true").option("escape", '"')
            writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        writer.format(fmt).save(f"{path}/{name}")
