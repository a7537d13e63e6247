"""The content cache as a stored table, bucketed by key so that lookups don't move it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vouchsafe.operators.model_calls import cache_evict
from vouchsafe.session import settle


@dataclass(frozen=True)
class StoredCache:
    """Model answers (``schema`` with key and created_at) in buckets of ``key`` under ``location``.

    A store appends; readers take the newest entry of a key inside its bucket. Joins and aggregations by key read
    the buckets as they are: only the other side is shuffled, to as many partitions as there are buckets. ``compact``
    leaves one entry a key and one file a bucket.
    """

    location: str
    schema: StructType
    buckets: int = 64

    @property
    def name(self) -> str:
        return f"vouchsafe_cache_{hashlib.sha256(self.location.encode()).hexdigest()[:16]}"

    def _declare(self, spark: SparkSession) -> None:
        """Make the table known to this session's catalog; its files may be there already."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet"
            f" CLUSTERED BY (`key`) SORTED BY (`key`) INTO {self.buckets} BUCKETS LOCATION '{self.location}'",
        )

    def store(self, entries: DataFrame) -> None:
        """Append entries; of one key the newest counts, and of equally new ones that with the largest document."""
        self._declare(entries.sparkSession)
        # a task a bucket, so that an append adds one file to each
        entries.select(*self.schema.names).repartition(self.buckets, "key").write.insertInto(self.name)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest entry of each key."""
        self._declare(spark)
        order = F.struct("created_at", *[c for c in ("document",) if c in self.schema.names])
        rest = [c for c in self.schema.names if c != "key"]
        newest = spark.table(self.name).groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("e"))
        return newest.select("key", "e.*").select(*self.schema.names)

    def compact(self, spark: SparkSession, max_entries: int | None = None) -> None:
        """Rewrite the table with one entry a key, the newest ``max_entries`` of them where given."""
        current = self.read(spark)
        kept = settle(current if max_entries is None else cache_evict(current, max_entries))
        kept.repartition(self.buckets, "key").write.insertInto(self.name, overwrite=True)
