"""Shared pieces of the training-data operators: inputs, written lineage cuts, normal forms."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so a lost executor costs
    the tasks that it ran and nothing before the cut.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vouchsafe-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores in front as it takes to be no column of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def kept_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``key`` are a row of ``kept`` (doc_id, key), one of those that repeat both.

    A null doc_id equals another. The join goes by plain columns, and rows are grouped by the same: they move and are sorted once.
    """
    by = unused(docs, "_none", "_id", "_key")
    placed = lambda df, k: df.withColumns(dict(zip(by, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), k))))
    stay = placed(docs, key).join(placed(kept, F.col("key")).select(*by), by, "left_semi")
    return one_of_repeated(stay, docs.columns, by)


def one_of_repeated(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``columns`` of one row for each key: of rows that differ elsewhere the one with the smallest hash, in every run."""
    plain = [c for c in columns if "map<" not in df.schema[c].dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    first = df.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias("row"))
    return first.select("row.*")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(text: Column | str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spread(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Deal rows evenly for heavy work per row when the input has fewer pieces than the cluster cores.

    A table of few row groups would otherwise keep its work on a few cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)
