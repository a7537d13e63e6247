"""Lists, search and integrity of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vouchsafe import fixed_values as fv
from vouchsafe.functions.identifiers import literal_map
from vouchsafe.functions.numbers import dec
from vouchsafe.operators.rows import rows_of

SORT_KEYS = {"file_name": "file_name", "doc_type": "detected_type", "status": "status", "uploaded_at": "created_at"}


def latest_rows(extractions: DataFrame) -> DataFrame:
    """The row with the highest attempt of each document, by partial aggregation instead of sorting."""
    columns = [c for c in extractions.columns if c != "doc_id"]
    latest = extractions.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "attempt_no").alias("_x"))
    return latest.select("doc_id", "_x.*")


def latest_extraction(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Documents with their latest extraction; documents without any stay."""
    return docs.join(latest_rows(extractions), "doc_id", "left")


def latest_success(docs: DataFrame, extractions: DataFrame, tenant: Column | int) -> DataFrame:
    """Documents of one tenant with the newest succeeded result; other tenants see nothing."""
    mine = docs.where(F.col("tenant_id") == tenant)
    return mine.join(latest_rows(extractions.where(F.col("status") == "succeeded").drop("status")), "doc_id", "left")


def search_documents(rows: DataFrame, query: str) -> DataFrame:
    """Substring search in file name, parties and number; % and _ work as wildcards."""
    text = query.strip()
    if not text:
        return rows
    pattern = f"%{text}%"
    hit = F.lit(False)
    for column in ("file_name", "supplier_name", "buyer_name", "number"):
        hit = hit | F.coalesce(F.col(column).ilike(pattern), F.lit(False))
    return rows.where(hit)


def filter_documents(rows: DataFrame, doc_type: str = "", status: str = "") -> DataFrame:
    if doc_type:
        rows = rows.where(F.col("detected_type") == doc_type)
    if status:
        rows = rows.where(F.col("status") == status)
    return rows


def sort_order(key: str, direction: str) -> list[Column]:
    """Known columns only, newest first otherwise; the id makes the order total."""
    column = F.col(SORT_KEYS.get(key, "created_at"))
    return [column.asc() if direction == "asc" else column.desc(), F.col("doc_id").asc()]


def sort_documents(rows: DataFrame, key: str = "uploaded_at", direction: str = "desc") -> DataFrame:
    return rows.orderBy(*sort_order(key, direction))


def paginate(rows: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of an ordered relation."""
    size = min(100, max(5, per_page))
    return rows.offset((max(1, page) - 1) * size).limit(size)


def page_after(
    rows: DataFrame, cursor: tuple[object, object] | None, key: str = "uploaded_at", direction: str = "desc", per_page: int = 25,
) -> DataFrame:
    """The page behind a cursor (sort value and doc_id of the last row seen; none for the first page).

    The cursor becomes a filter that reaches the scan, so a deep page costs what the first one does.
    """
    size = min(100, max(5, per_page))
    column, ident = F.col(SORT_KEYS.get(key, "created_at")), F.col("doc_id")
    if cursor is not None:
        value, last = cursor
        later = ident > F.lit(last)
        if value is None:  # nulls are first upwards and last downwards
            behind = column.isNull() & later
            behind = behind | column.isNotNull() if direction == "asc" else behind
        elif direction == "asc":
            behind = (column > F.lit(value)) | ((column == F.lit(value)) & later)
        else:
            behind = column.isNull() | (column < F.lit(value)) | ((column == F.lit(value)) & later)
        rows = rows.where(behind)
    return sort_documents(rows, key, direction).limit(size)


@dataclass(frozen=True)
class PagedTable:
    """An ordered relation stored in ranges, with the number of rows in each, so that any page reads one or two of them."""

    path: str

    def write(self, rows: DataFrame, order: Sequence[Column], ranges: int) -> None:
        """Store ``rows`` in ``ranges`` pieces of about equal size; ``order`` must be total."""
        dealt = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(f"{self.path}/rows")
        stored = rows.sparkSession.read.schema(dealt.schema).parquet(f"{self.path}/rows")
        counts = stored.groupBy("_range").agg(F.count("*").alias("n"))
        # as many rows as there are ranges
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges")

    def _ranges(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("_range int, n bigint, first bigint").parquet(f"{self.path}/ranges")

    def total(self, spark: SparkSession) -> int:
        return self._ranges(spark).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, spark: SparkSession, schema: StructType, order: Sequence[Column], page: int = 1, per_page: int = 25) -> DataFrame:
        """Rows of one page in order; the ranges that hold none of it aren't listed."""
        size = min(100, max(5, per_page))
        start = (max(1, page) - 1) * size
        touched = self._ranges(spark).where((F.col("first") < start + size) & (F.col("first") + F.col("n") > start)).collect()  # size at most
        stored = spark.read.schema(StructType([*schema.fields]).add("_range", "integer")).parquet(f"{self.path}/rows")
        near = stored.where(F.col("_range").isin([r["_range"] for r in touched])).drop("_range")
        return near.orderBy(*order).offset(start - min((r["first"] for r in touched), default=start)).limit(size)


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def facets(docs: DataFrame) -> DataFrame:
    """Distinct types and statuses in one pass: each row offers both, pairs are aggregated early."""
    offered = F.array(
        F.struct(F.lit("type").alias("facet"), F.col("detected_type").alias("value")),
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")),
    )
    return rows_of(docs, [], offered).where("value IS NOT NULL").distinct().orderBy("facet", "value")


def check_integrity(docs: DataFrame, extractions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Broken keys, ranges and references as (table_name, rule, row_key)."""

    def found(df: DataFrame, name: str, rule: str, key: Column) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), key.cast("string").alias("row_key"))

    twice = lambda df, cols: df.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1")
    attempt = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("attempt_no").cast("string"))
    ranges = F.array_compact(F.array(
        F.when(~F.col("overall_confidence").between(0, 1), "confidence_range"),
        F.when(F.col("input_tokens") < 0, "input_tokens_range"),
        F.when(F.col("output_tokens") < 0, "output_tokens_range"),
        F.when(F.col("response_ms") < 0, "response_time_range"),
    ))
    broken = rows_of(extractions, ["extraction_id"], F.transform(ranges, lambda r: F.struct(r.alias("rule")))).select(
        F.lit("extractions").alias("table_name"), "rule", F.col("extraction_id").cast("string").alias("row_key"))
    parts = [
        found(docs.where("size_bytes <= 0"), "documents", "size_positive", F.col("doc_id")),
        found(twice(docs, ["object_key"]), "documents", "object_key_unique", F.col("object_key")),
        found(twice(extractions, ["doc_id", "attempt_no"]), "extractions", "attempt_unique", attempt),
        broken,
        found(extractions.join(docs.select("doc_id"), "doc_id", "left_anti"), "extractions", "document_exists", F.col("extraction_id")),
        found(tasks.join(extractions.select("extraction_id"), "extraction_id", "left_anti"), "tasks", "extraction_exists", F.col("task_id")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def type_label(code: Column) -> Column:
    labels = literal_map(fv.TYPE_LABELS)
    return F.coalesce(F.try_element_at(labels, code), code)


def document_rows(rows: DataFrame) -> DataFrame:
    """List projection over documents joined to their latest result (text values)."""
    day = F.substring("doc_date", 1, 10)
    return rows.select(
        "doc_id", "file_name",
        type_label(F.coalesce("document_type", "detected_type")).alias("doc_type"),
        F.col("supplier_name").alias("counterparty"),
        F.col("total_amount").try_cast("decimal(18,2)").alias("total_amount"),
        "currency",
        F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd")).alias("doc_date"),
        "status", F.col("created_at").alias("uploaded_at"), "size_bytes", "error_code",
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """Line items as bare values."""
    names = ("name", "quantity", "unit", "unit_price", "amount", "vat_rate", "vat_amount")
    bare = F.transform("line_items", lambda x: F.struct(*[x[n]["value"].alias(n) for n in names]))
    return rows_of(docs, ["doc_id"], bare, "line_no")


def trace_rows(extractions: DataFrame) -> DataFrame:
    """Model trace of an extraction; without step log the model time stands for it.

    Expects ``settings_cache_hit``, ``attempt_cache_hits`` (list) and ``step_durations`` (map).
    """
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    fallback = F.create_map(
        F.lit("llm_extraction"), (F.col("response_ms").cast("decimal(18,3)") * dec("0.001", 4, 3)).cast("decimal(18,6)"))
    steps = F.when(F.coalesce(F.size("step_durations"), F.lit(0)) > 0, F.col("step_durations")).when(
        F.col("response_ms") > 0, fallback)
    return extractions.select(
        "extraction_id", "provider", "model", "prompt_version",
        F.nullif(total, F.lit(0)).alias("total_tokens"),
        "cost_usd",
        (F.coalesce("settings_cache_hit", F.lit(False))
         | F.coalesce(F.exists("attempt_cache_hits", lambda h: F.coalesce(h, F.lit(False))), F.lit(False))).alias("cache_hit"),
        "overall_confidence",
        steps.alias("step_durations"),
    )
