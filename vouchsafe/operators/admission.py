"""Admission and content-addressed deduplication of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.identifiers import content_type_of, file_suffix, object_key
from vouchsafe.operators.rows import lookup_join
from vouchsafe.settings import MAX_UPLOAD_BYTES


def describe_files(files: DataFrame, payload: str = "content") -> DataFrame:
    """(name, payload, …) -> size, hash, suffix, type by suffix, key, and the first bytes in hex.

    The payload is dropped here, so everything after this step moves a few hundred bytes per file.
    """
    body = F.col(payload).cast("binary")
    digest = F.sha2(body, 256)
    return (
        files.withColumn("size_bytes", F.octet_length(body).cast("bigint"))
        .withColumn("sha256", digest)
        .withColumn("suffix", file_suffix(F.col("name")))
        .withColumn("content_type", content_type_of(F.col("name")))
        .withColumn("object_key", object_key(F.col("sha256"), F.col("name")))
        .withColumn("header_hex", F.hex(F.substring(body, 1, 16)))
        .drop(payload)
    )


def _signature_suffix(header: Column) -> Column:
    found = F.lit(None).cast("string")
    for signature, suffix in reversed(fv.SUFFIX_SIGNATURES.items()):
        found = F.when(header.startswith(signature), suffix).otherwise(found)
    return found


def admission_reason(max_bytes: int) -> Column:
    """Size first, then suffix, then signature; null means admitted."""
    suffix = F.col("suffix")
    normal = F.when(suffix == ".jpeg", ".jpg").when(suffix == ".tiff", ".tif").otherwise(suffix)
    signature = _signature_suffix(F.col("header_hex"))
    return (
        F.when(F.col("size_bytes") > max_bytes, "upload_too_large")
        .when(F.col("content_type").isNull(), "unsupported_content_type")
        .when(signature.isNull() | (signature != normal), "unsupported_content_type")
    )


def admit_files(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    return files.withColumn("reason", admission_reason(max_bytes))


def admit_declared(
    files: DataFrame, allowed: tuple[str, ...] = tuple(fv.DECLARED_SIGNATURES), max_bytes: int = MAX_UPLOAD_BYTES,
) -> DataFrame:
    """Second contract: the declared type must be allowed and the first bytes must be of that type."""
    header, matches = F.col("header_hex"), F.lit(False)
    for declared, signatures in fv.DECLARED_SIGNATURES.items():
        for signature in signatures:
            matches = matches | ((F.col("declared_type") == declared) & header.rlike("^" + signature))
    allowed_type = F.coalesce(F.col("declared_type").isin(*allowed), F.lit(False))
    return files.withColumn("reason", (
        F.when(~allowed_type | ~F.coalesce(matches, F.lit(False)), "unsupported_file_type")
        .when((F.col("size_bytes") == 0) | (F.col("size_bytes") > max_bytes), "upload_too_large")
    ))


def dedupe_content(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Idempotent ingest: per file the document it belongs to, its status and whether it was known.

    ``files`` (file_id, object_key) are admitted, ``existing`` (object_key, doc_id, status) is
    unique by key. Copies are aggregated before the join, so a key with a huge number of copies
    costs no more than a partial count, and its files are spread over tasks on the way back.
    """
    batch = files.groupBy("object_key").agg(F.min("file_id").alias("_first"), F.count("*").alias("copies"))
    known = existing.select("object_key", F.col("doc_id").alias("_doc"), F.col("status").alias("_status"))
    keys = batch.join(known, "object_key", "left")
    joined = lookup_join(files, keys, "object_key", copies="copies", spread=["file_id"])
    return joined.select(
        "file_id", "object_key",
        F.coalesce("_doc", "_first").alias("doc_id"),
        F.coalesce("_status", F.lit("uploaded")).alias("status"),
        (F.col("_doc").isNotNull() | (F.col("file_id") != F.col("_first"))).alias("already_existed"),
    )


def new_documents(files: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per unknown content: what has to be inserted."""
    first = files.groupBy("object_key").agg(F.min("file_id").alias("doc_id"))
    return first.join(existing.select("object_key"), "object_key", "left_anti")
