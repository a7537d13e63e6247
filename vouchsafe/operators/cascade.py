"""Cheap model first, costly model only for disputed fields.

A document with its field list and violation list is one row, so finding the disputed paths and
building the question are row-local; only corrections coming back are joined, on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.operators.fields import (
    CORRECTION, canonical_path, document_columns, field_array, overlay_fields,
)
from vouchsafe.operators.guardrails import with_violations
from vouchsafe.operators.rows import once, rows_of
from vouchsafe.operators.validation import validate_fields
from vouchsafe.settings import GuardrailSettings

PATHS = "array<string>"


def escalation_split(docs: DataFrame, settings: GuardrailSettings) -> tuple[DataFrame, DataFrame]:
    """Documents accepted from the cheap model, and those that go on."""
    checked = with_escalation(docs, settings)
    return checked.where("NOT escalated").drop("escalated"), checked.where("escalated").drop("escalated")


def with_escalation(docs: DataFrame, settings: GuardrailSettings) -> DataFrame:
    """All documents with ``escalated``: both sides of the split in one pass."""
    return with_violations(docs, settings).withColumn("escalated", F.col("requires_review"))


def disputed(leaves: Column, violation_paths: Column) -> Column:
    """Leaf paths in dispute: the named leaf, or all leaves below the named node; first mention counts."""
    def leaves_of(path: Column) -> Column:
        exact = canonical_path(path)
        below = F.concat(exact, F.lit("/"))
        return F.when(F.array_contains(leaves, exact), F.array(exact)).otherwise(
            F.filter(leaves, lambda leaf: leaf.startswith(below)))

    return F.array_distinct(F.flatten(F.transform(violation_paths, leaves_of)))


def with_disputed(docs: DataFrame, settings: GuardrailSettings, *, every: bool = False) -> DataFrame:
    """(doc_id, fields, disputed) of every document that has violations, or of ``every`` document."""
    checked = with_violations(docs, settings)
    checked = checked if every else checked.where("requires_review")
    paths = F.transform("violations", lambda v: v["field_path"])
    listed = once(checked.select("doc_id", field_array().alias("fields"), paths.alias("paths")), leaves=F.expr("fields.path"))
    return once(listed, disputed=disputed(F.col("leaves"), F.col("paths"))).select("doc_id", "fields", "disputed")


def disputed_paths(marked: DataFrame) -> DataFrame:
    """(doc_id, ord, path): disputed leaves in order of first mention."""
    entries = F.transform("disputed", lambda p: F.struct(p.alias("path")))
    return rows_of(marked, ["doc_id"], entries, "ord")


def reask_requests(marked: DataFrame) -> DataFrame:
    """Per document one JSON object: disputed path -> current value, confidence and evidence."""
    wanted = F.filter("fields", lambda f: F.array_contains("disputed", f["path"]))
    entries = F.transform(wanted, lambda f: F.struct(
        f["path"], F.struct(f["value"].alias("value"), f["confidence"].alias("confidence"), f["sources"].alias("sources"))))
    body = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    return marked.where(F.size("disputed") > 0).select(
        "doc_id", F.size("disputed").alias("n_disputed"), body.alias("request_json"))


def parse_corrections(responses: DataFrame) -> DataFrame:
    """Entries of a JSON object that hold value, confidence and sources; anything else is ignored.

    Paths stay as the model spelled them: only the spelling that was asked for counts later. Of entries
    with one path the last stays.
    """
    entries = F.when(
        F.try_parse_json("content").isNotNull() & F.col("content").rlike(r"^\s*\{"),
        F.map_entries(F.from_json("content", "map<string,string>")),
    )
    exploded = rows_of(responses, ["doc_id"], entries, position="at")
    parts = F.from_json("value", "map<string,string>")
    complete = F.lit(True)
    for name in CORRECTION.names:
        complete = complete & F.coalesce(F.map_contains_key(parts, F.lit(name)), F.lit(False))
    parsed = exploded.where(complete).select(
        "doc_id", F.col("key").alias("path"), "at", F.from_json("value", CORRECTION).alias("c"),
    )
    return parsed.groupBy("doc_id", "path").agg(F.max_by("c", "at").alias("c")).select("doc_id", "path", "c.*")


def restrict_corrections(corrections: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrections of asked paths, and those to drop because nobody asked."""
    keys = asked.select("doc_id", "path")
    on = ["doc_id", "path"]
    return corrections.join(keys, on, "left_semi"), corrections.join(keys, on, "left_anti")


def with_asked(corrections: DataFrame, asked: DataFrame) -> DataFrame:
    """All corrections with ``asked``: both sides of the restriction in one join."""
    keys = asked.select("doc_id", "path").distinct().withColumn("asked", F.lit(True))
    return corrections.join(keys, ["doc_id", "path"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def overlay_corrections(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected field lists, validated again; ``rebuild_documents`` gives the nested form."""
    return validate_fields(overlay_fields(nested, corrections))


def corrected_documents(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Nested documents after the overlay, each with the errors that it has now (none: it validates)."""
    return overlay_corrections(nested, corrections).select("doc_id", *document_columns(), "errors")


def field_provenance(nested: DataFrame, marked: DataFrame | None, cheap: str, costly: str) -> DataFrame:
    """Model that supplied each known path: the costly one where it was asked.

    Without ``marked`` the field lists bring their own ``disputed`` (``with_disputed`` of every document).
    """
    if marked is None:
        joined = nested.withColumnRenamed("disputed", "asked")
    else:
        joined = nested.join(marked.select("doc_id", F.col("disputed").alias("asked")), "doc_id", "left")
    joined = joined.withColumn("asked", F.coalesce("asked", F.array().cast(PATHS)))
    entries = F.transform("fields", lambda f: F.struct(
        f["path"].alias("path"),
        F.when(F.array_contains("asked", f["path"]), costly).otherwise(cheap).alias("model"),
    ))
    return rows_of(joined, ["doc_id"], entries)


def cascade_usage(results: DataFrame) -> DataFrame:
    """(doc_id, used_costly, n_asked, input_tokens, output_tokens) -> one row of totals."""
    used = F.col("used_costly")
    return results.agg(
        F.count("*").alias("n_documents"),
        F.count_if(used).alias("n_escalated"),
        F.try_divide(F.count_if(used).cast("double"), F.count("*").cast("double")).alias("escalation_rate"),
        F.coalesce(F.sum("n_asked"), F.lit(0)).alias("n_asked_paths"),
        F.sum(F.when(used, F.col("input_tokens"))).alias("costly_input_tokens"),
        F.sum(F.when(used, F.col("output_tokens"))).alias("costly_output_tokens"),
    )
