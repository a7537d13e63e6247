"""A table with one current row per key, fed by streams in update mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet files with a known schema, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class KeyedTable:
    """Changed rows by batch and key bucket; a reader takes the newest row of each key.

    A batch writes the rows it changes and nothing else. A repeated batch replaces its own partitions. Every
    ``compact_after`` batches the newest rows are written once as a snapshot, and readers leave out what is older;
    a snapshot counts from the moment its number is added to ``snapshots-done``, so a lost one changes nothing.
    Older folders are left to the retention of the store.
    """

    path: str
    schema: StructType
    key: Sequence[str]
    buckets: int = 64
    compact_after: int = 50

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("_batch", "long").add("_bucket", "integer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, batch_id: int) -> None:
        marked = rows.select(*self.schema.names, F.lit(batch_id).alias("_batch"), self._bucket().alias("_bucket"))
        # one file a bucket, and rows of a bucket from one task
        marked.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_bucket").parquet(
            f"{self.path}/{folder}")

    def merge(self, changes: DataFrame, batch_id: int) -> None:
        """Take in the current rows of the changed keys (each key once)."""
        self._write(changes, "changes", batch_id)
        if batch_id and batch_id % self.compact_after == 0:
            spark = changes.sparkSession
            self._write(self._newest(self._rows(spark)), "snapshots", batch_id)
            spark.createDataFrame([(batch_id,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots-done")

    def _rows(self, spark: SparkSession) -> DataFrame:
        done = read_if_there(spark, f"{self.path}/snapshots-done", "upto bigint").agg(F.max("upto")).first()[0]
        changes = read_if_there(spark, f"{self.path}/changes", self._stored())
        if done is None:
            return changes
        snapshot = read_if_there(spark, f"{self.path}/snapshots", self._stored()).where(F.col("_batch") == done)
        return snapshot.unionByName(changes.where(F.col("_batch") > done))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        return newest.select(*self.key, "_r.*").select(*self.schema.names)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._newest(self._rows(spark))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (the key columns); only the buckets these are in are read."""
        asked = keys.select(*self.key).distinct()
        hit = [r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        near = self._rows(keys.sparkSession).where(F.col("_bucket").isin(*hit))
        return self._newest(near.join(asked, list(self.key), "left_semi"))
