"""Continuous forms of ingest, processing and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vouchsafe import fixed_values as fv
from vouchsafe.functions.numbers import half_even
from vouchsafe.operators.admission import admit_files, dedupe_content, describe_files
from vouchsafe.session import settle
from vouchsafe.settings import MAX_UPLOAD_BYTES
from vouchsafe.sources.files import BINARY_SCHEMA, name_of
from vouchsafe.streaming.keyed import KeyedTable, read_if_there


def stream_files(spark: SparkSession, landing: str, *, files_per_trigger: int = 1000, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Described and judged files of a landing folder as they arrive."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
        .load(landing)
    )
    described = describe_files(raw.select("path", name_of(F.col("path")).alias("name"), "modificationTime", "content"))
    return admit_files(described, max_bytes)


def stream_ingest(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Admitted files, each content once within the delay; the documents table settles older repeats."""
    admitted = files.where("reason IS NULL")
    return admitted.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["object_key"])


#: Keys of a batch that are named to the scan one by one; more are looked up by a join with the partitions they may be in.
NAMED_KEYS = 1000
#: Leading hex digits of the content digest that name a partition of the documents table.
PREFIX_DIGITS = 2
DOCUMENTS = (
    "object_key string, doc_id string, path string, name string, size_bytes bigint, sha256 string, content_type string,"
    " status string, prefix string, batch bigint"
)
RESULTS = "file_id string, object_key string, doc_id string, status string, already_existed boolean, batch bigint"


def known_documents(spark: SparkSession, documents_path: str, keys: DataFrame, before: int) -> DataFrame:
    """(object_key, doc_id, status) of those ``keys`` (object_key, prefix) that batches before ``before`` have stored.

    Only partitions of the keys' prefixes are listed. Inside them the keys themselves are pushed to the scan, where
    the Bloom filters of the files leave out row groups that hold none of them.
    """
    table = read_if_there(spark, documents_path, DOCUMENTS).where(F.col("batch") < before)
    wanted = keys.limit(NAMED_KEYS + 1).collect()
    if len(wanted) <= NAMED_KEYS:
        named = table.where(F.col("prefix").isin(*{r["prefix"] for r in wanted}) & F.col("object_key").isin(*[r["object_key"] for r in wanted]))
        return named.select("object_key", "doc_id", "status")
    prefixes = [r["prefix"] for r in keys.select("prefix").distinct().collect()]  # at most 16 ** PREFIX_DIGITS
    return table.where(F.col("prefix").isin(*prefixes)).join(keys.select("object_key"), "object_key", "left_semi").select("object_key", "doc_id", "status")


def stream_ingest_into(
    files: DataFrame, documents_path: str, results_path: str | None = None, *, statuses: KeyedTable | None = None,
) -> DataStreamWriter:
    """Store contents that the documents table does not hold yet, and answer every admitted file, batch by batch.

    The answer (``results_path``) is the id and status of the file's document and whether that was there before:
    a repeated upload gets those of the stored one, with the newest status of ``statuses`` (keyed by doc_id) where
    given. The document of a new content has the smallest path of its batch as id. Both tables have a partition for
    each batch, so a batch repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        admitted = batch.where("reason IS NULL").withColumn("prefix", F.substring("sha256", 1, PREFIX_DIGITS)).persist()
        old_threshold = spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(NAMED_KEYS))
        try:
            known = known_documents(spark, documents_path, admitted.select("object_key", "prefix").distinct(), batch_id)
            if statuses is not None:
                newest = statuses.lookup(known.select("doc_id")).select("doc_id", F.col("status").alias("_newest"))
                known = known.join(newest, "doc_id", "left").select("object_key", "doc_id", F.coalesce("_newest", "status").alias("status"))
            known = settle(known)  # at most a row a key of the batch
            if results_path is not None:
                answered = dedupe_content(admitted.select(F.col("path").alias("file_id"), "object_key"), known)
                _replace(answered.withColumn("batch", F.lit(batch_id)), results_path, "batch")
            first = admitted.groupBy("object_key", "prefix").agg(
                F.min(F.struct("path", "name", "size_bytes", "sha256", "content_type")).alias("f"))
            rows = first.join(known.select("object_key"), "object_key", "left_anti").select(
                "object_key", F.col("f.path").alias("doc_id"), "f.*", F.lit("uploaded").alias("status"), "prefix", F.lit(batch_id).alias("batch"))
            _replace(rows.repartition("prefix"), documents_path, "prefix", "batch")
        finally:
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", old_threshold)
            admitted.unpersist()

    return files.writeStream.foreachBatch(write)


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#object_key", "true")
        .partitionBy(*partitions).parquet(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents table; empty before its first batch."""
    return read_if_there(spark, path, DOCUMENTS)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The answers to all files so far; a repeated batch counts once."""
    return read_if_there(spark, path, RESULTS)


def stream_process(
    files: DataFrame, process: Callable[[DataFrame], DataFrame], results_path: str, *, concurrency: int,
) -> DataStreamWriter:
    """Run ``process`` (text, model, rules, status) on each micro-batch with a cap on parallel calls."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = process(batch.repartition(concurrency)).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(results_path)

    return files.writeStream.foreachBatch(write)


def _rank(status: str = "status"):
    place = F.lit(None).cast("int")
    for i, name in enumerate(fv.DOCUMENT_STATUSES):
        place = F.when(F.col(status) == name, i).otherwise(place)
    return place


TERMINAL = ("completed", "failed")


def latest_status(events: DataFrame) -> DataFrame:
    """Status per document (doc_id, status, ts, is_correction).

    A terminal status holds against later non-terminal ones unless those come from a correction, so
    the latest terminal event and the latest correction decide; otherwise the latest event does.
    Only running maxima are kept per document: the same expression serves batch and stream.
    """
    order = F.struct("ts", _rank().alias("rank"))
    final = F.col("status").isin(*TERMINAL)
    binding = final | F.coalesce("is_correction", F.lit(False))
    kept = events.groupBy("doc_id").agg(
        F.max(F.struct(order.alias("o"), F.col("status").alias("s"))).alias("last"),
        F.max(F.when(binding, F.struct(order.alias("o"), F.col("status").alias("s"), final.alias("f")))).alias("bound"),
    )
    stays = F.col("bound").isNotNull() & F.col("bound.f")
    return kept.select("doc_id", F.when(stays, F.col("bound.s")).otherwise(F.col("last.s")).alias("status"))


def stream_status(events: DataFrame) -> DataFrame:
    """Status per document. In update mode a batch gives the documents it has events of, and no others."""
    return latest_status(events)


def stream_daily_counts(events: DataFrame, delay: str = "1 day", column: str = "ts") -> DataFrame:
    """Documents per calendar day; a day is final once the watermark has passed it, and later rows of it are dropped.

    Append mode gives final days only. Update mode gives the counts of open days too, as they change, so a table
    keyed by day holds every day at any time.
    """
    windowed = events.withWatermark(column, delay).groupBy(F.window(column, "1 day").alias("w"))
    return windowed.agg(F.count("*").alias("n_documents")).select(
        F.to_date("w.start").alias("day"), "n_documents")


def stream_step_totals(log: DataFrame) -> DataFrame:
    """Running totals per run and step; negative measurements count as zero."""
    seconds = F.greatest(F.col("seconds"), F.lit(0)).cast("decimal(18,9)")
    named = log.where(F.trim("step") != "").withColumn("_s", seconds)
    return named.groupBy("run_id", "step").agg(half_even(F.sum("_s"), 6).cast("decimal(18,6)").alias("seconds"))


def stream_into(changes: DataFrame, table: KeyedTable) -> DataStreamWriter:
    """Keep ``table`` at the newest row of each key of an aggregated stream; a batch writes its changed keys only."""
    return changes.writeStream.outputMode("update").foreachBatch(table.merge)
