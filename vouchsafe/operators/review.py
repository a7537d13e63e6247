"""Review tasks and corrections.

Tables: ``tasks`` (task_id, extraction_id, field_path, reason, status, original_value,
corrected_value, resolution_comment, created_at, resolved_at). Operators return new versions of
the rows they touch; nothing is changed in place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.identifiers import literal_map
from vouchsafe.functions.text import coerce_correction
from vouchsafe.operators.fields import canonical_path, overlay_values
from vouchsafe.operators.rows import rows_of
from vouchsafe.operators.validation import validate_fields
from vouchsafe.session import settle

KEYS = ["extraction_id", "field_path"]
TASK_COLUMNS = [
    "task_id", "extraction_id", "field_path", "reason", "status", "original_value", "corrected_value",
    "resolution_comment", "created_at", "resolved_at",
]


def is_open(status: Column) -> Column:
    return status.isin(*fv.OPEN_TASK_STATUSES)


def correction_map(tasks: DataFrame) -> DataFrame:
    """Effective corrections: per path the latest resolved task with a value or a manual reason."""
    manual = F.coalesce(F.col("reason"), F.lit("")).startswith(fv.MANUAL_PREFIX)
    usable = tasks.where((F.col("status") == "resolved") & (F.col("corrected_value").isNotNull() | manual))
    latest = F.struct("created_at", "task_id")
    return usable.groupBy(*KEYS).agg(F.max_by("corrected_value", latest).alias("value"))


def _by_document(corrections: DataFrame) -> DataFrame:
    return corrections.select(
        F.col("extraction_id").alias("doc_id"), canonical_path(F.col("field_path")).alias("path"), "value",
    ).dropDuplicates(["doc_id", "path"])


def apply_corrections(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Field lists with reviewer values laid over them; unknown paths are skipped."""
    return overlay_values(nested, _by_document(corrections))


def validate_corrections(nested: DataFrame, current: DataFrame, requests: DataFrame) -> DataFrame:
    """All or nothing per document: every path must exist and the corrected document must validate.

    ``requests`` (extraction_id, field_path, value) are raw reviewer inputs, ``current`` the
    effective corrections so far; a request outranks them.
    """
    wanted = requests.select(*KEYS, coerce_correction(F.col("value")).alias("value"))
    merged = current.join(wanted, KEYS, "left_anti").select(*KEYS, "value").unionByName(wanted)
    asked = wanted.groupBy(F.col("extraction_id").alias("doc_id")).agg(
        F.collect_set(canonical_path(F.col("field_path"))).alias("asked_paths"))
    checked = validate_fields(apply_corrections(nested.join(asked, "doc_id"), merged))
    unknown = F.array_except("asked_paths", F.transform("fields", lambda f: f["path"]))
    return checked.select(
        "doc_id", F.size("asked_paths").alias("n_requests"), F.size(unknown).alias("n_unknown_paths"),
        F.size("errors").alias("n_errors"),
        ((F.size(unknown) == 0) & (F.size("errors") == 0)).alias("accepted"),
    )


def upsert_corrections(tasks: DataFrame, requests: DataFrame, now: dt.datetime) -> DataFrame:
    """The newest task of each requested path takes the value, a path without task gets a new one.

    ``requests`` is unique by path and carries ``original_value``; new tasks have a derived id.
    """
    newest = tasks.join(requests.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(
        F.max_by("task_id", F.struct("created_at", "task_id")).alias("task_id"))
    value = coerce_correction(F.col("value"))
    updates = newest.join(requests.select(*KEYS, value.alias("_value")), KEYS).select("task_id", "_value", F.lit(True).alias("_hit"))
    moment = F.lit(now).cast("timestamp_ntz")
    touched = F.coalesce("_hit", F.lit(False))
    changed = tasks.join(updates, "task_id", "left").select(
        "task_id", *KEYS,
        F.when(touched, fv.MANUAL_REASON).otherwise(F.col("reason")).alias("reason"),
        F.when(touched, "resolved").otherwise(F.col("status")).alias("status"),
        "original_value",
        F.when(touched, F.col("_value")).otherwise(F.col("corrected_value")).alias("corrected_value"),
        "resolution_comment", "created_at",
        F.when(touched, moment).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    fresh = requests.join(newest, KEYS, "left_anti").select(
        new_task_id(F.lit("correction")).alias("task_id"), *KEYS,
        F.lit(fv.MANUAL_REASON).alias("reason"), F.lit("resolved").alias("status"),
        "original_value", value.alias("corrected_value"),
        F.lit(None).cast("string").alias("resolution_comment"), moment.alias("created_at"), moment.alias("resolved_at"),
    )
    return changed.select(*TASK_COLUMNS).unionByName(fresh.select(*TASK_COLUMNS))


def new_task_id(kind: Column) -> Column:
    """Identifier of a created task: the same job run twice creates the same task."""
    return F.sha2(F.concat_ws("|", kind, F.col("extraction_id").cast("string"), F.col("field_path")), 256)


def active_paths(violations: DataFrame) -> DataFrame:
    """Violated paths: the last violation words the reason, the first gives the original value."""
    reason = F.concat(F.col("rule"), F.lit(": "), F.col("message"))
    return violations.groupBy(F.col("doc_id").alias("extraction_id"), "field_path").agg(
        F.max_by(reason, "position").alias("_reason"), F.min_by("actual", "position").alias("_actual"))


def reconcile_tasks(tasks: DataFrame, violations: DataFrame, scope: DataFrame, now: dt.datetime) -> DataFrame:
    """Bring open tasks in line with the violations of the documents in ``scope``.

    Open tasks of clean paths are resolved, the oldest open task of a violated path is refreshed,
    a violated path without open task gets a new one. The violations are evaluated once.
    """
    return _reconcile(tasks, settle(active_paths(violations)), scope, now)


def _reconcile(tasks: DataFrame, active: DataFrame, scope: DataFrame, now: dt.datetime) -> DataFrame:
    moment = F.lit(now).cast("timestamp_ntz")
    first_open = tasks.where(is_open(F.col("status"))).groupBy(*KEYS).agg(
        F.min_by("task_id", F.struct("created_at", "task_id")).alias("_first"))
    seen = scope.select("extraction_id", F.lit(True).alias("_scope"))
    matched = (
        tasks.join(seen, "extraction_id", "left")
        .join(active.withColumn("_active", F.lit(True)), KEYS, "left")
        .join(first_open, KEYS, "left")
    )
    opened = is_open(F.col("status"))
    settled = F.coalesce(F.col("_scope") & opened & F.col("_active").isNull(), F.lit(False))
    refreshed = F.coalesce(F.col("_scope") & opened & F.col("_active") & (F.col("task_id") == F.col("_first")), F.lit(False))
    changed = matched.select(
        "task_id", *KEYS,
        F.when(refreshed, F.col("_reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(settled, "resolved").when(refreshed, "pending").otherwise(F.col("status")).alias("status"),
        "original_value", "corrected_value",
        F.when(settled, fv.COMMENT_PASSED).when(refreshed, F.lit(None)).otherwise(F.col("resolution_comment")).alias("resolution_comment"),
        "created_at",
        F.when(settled, moment).when(refreshed, F.lit(None)).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    fresh = active.join(first_open, KEYS, "left_anti").select(
        new_task_id(F.lit("violation")).alias("task_id"), *KEYS,
        F.col("_reason").alias("reason"), F.lit("pending").alias("status"), F.col("_actual").alias("original_value"),
        F.lit(None).cast("string").alias("corrected_value"), F.lit(None).cast("string").alias("resolution_comment"),
        moment.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )
    return changed.select(*TASK_COLUMNS).unionByName(fresh.select(*TASK_COLUMNS))


def review_outcomes(docs: DataFrame, violations: DataFrame, requests: DataFrame) -> DataFrame:
    """Decision per completion request.

    ``docs`` (extraction_id, status, has_result), ``requests`` (extraction_id, confirm). Any
    violation, blocking or not, needs the confirmation; other statuses are refused.
    """
    found = violations.groupBy(F.col("doc_id").alias("extraction_id")).agg(
        F.count("*").alias("_n"), F.bool_or("blocking").alias("_blocking"))
    joined = requests.join(docs, "extraction_id", "left").join(found, "extraction_id", "left")
    issues = F.coalesce("_n", F.lit(0))
    refusal = (
        F.when(F.col("status").isNull(), "unknown_document")
        .when(F.col("status") != "review_required", "not_in_review")
        .when(~F.col("has_result"), "no_result")
    )
    completed = refusal.isNull() & ((issues == 0) | F.col("confirm"))
    return joined.select(
        "extraction_id", "confirm",
        refusal.alias("refused"),
        issues.alias("issues"),
        completed.alias("completed"),
        (refusal.isNull() & ~completed).alias("requires_confirmation"),
        (~completed & F.coalesce("_blocking", F.lit(False))).alias("has_blocking"),
        (completed & (issues > 0)).alias("warnings_confirmed"),
        F.when(completed, "completed").otherwise(F.col("status")).alias("status"),
    )


def complete_review(
    docs: DataFrame, tasks: DataFrame, violations: DataFrame, requests: DataFrame, now: dt.datetime,
) -> tuple[DataFrame, DataFrame]:
    """Outcomes per request and the task table after it; refused requests change nothing.

    The violations are evaluated once and kept as slim rows; so are the outcomes, which the task table needs twice.
    """
    violations = settle(violations.select("doc_id", "field_path", "rule", "message", "position", "actual", "blocking"))
    outcomes = settle(review_outcomes(docs, violations, requests))
    accepted = outcomes.where("refused IS NULL")
    scope = accepted.select("extraction_id")
    scoped = violations.join(scope.withColumnRenamed("extraction_id", "doc_id"), "doc_id", "left_semi")
    active = settle(active_paths(scoped))
    reconciled = _reconcile(tasks, active, scope, now)
    moment = F.lit(now).cast("timestamp_ntz")
    confirmed = accepted.where("warnings_confirmed").select("extraction_id", F.col("issues").alias("_issues"))
    hot = active.select(*KEYS, F.lit(True).alias("_active"))
    joined = reconciled.join(confirmed, "extraction_id", "left").join(hot, KEYS, "left")
    close = F.coalesce(F.col("_issues").isNotNull() & F.col("_active") & is_open(F.col("status")), F.lit(False))
    closed = joined.select(
        "task_id", *KEYS, "reason",
        F.when(close, "resolved").otherwise(F.col("status")).alias("status"),
        "original_value", "corrected_value",
        F.when(close, fv.COMMENT_CONFIRMED).otherwise(F.col("resolution_comment")).alias("resolution_comment"),
        "created_at",
        F.when(close, moment).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    audit = confirmed.withColumn("field_path", F.lit(fv.CONFIRMATION_PATH)).select(
        new_task_id(F.lit("confirmation")).alias("task_id"), *KEYS,
        F.lit(fv.CONFIRMATION_REASON).alias("reason"), F.lit("resolved").alias("status"),
        F.lit(fv.CONFIRMATION_ORIGINAL).alias("original_value"), F.lit(None).cast("string").alias("corrected_value"),
        F.concat(F.lit("Пользователь подтвердил "), F.col("_issues").cast("string"), F.lit(" расхождений")).alias("resolution_comment"),
        moment.alias("created_at"), moment.alias("resolved_at"),
    )
    return outcomes, closed.select(*TASK_COLUMNS).unionByName(audit.select(*TASK_COLUMNS))


def field_label(pointer: Column) -> Column:
    labels = literal_map(fv.FIELD_LABELS)
    path = F.regexp_replace(pointer, "^/", "")
    return F.coalesce(F.try_element_at(labels, path), path)


def field_diff(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Scalar fields with value, original value and whether a reviewer changed them."""
    mine = _by_document(corrections).groupBy("doc_id").agg(F.collect_set("path").alias("corrected_paths"))
    scalar = nested.select("doc_id", F.filter("fields", lambda f: ~f["path"].startswith("/line_items/")).alias("fields"))
    original = scalar.select("doc_id", "fields", F.col("fields").alias("original")).join(mine, "doc_id", "left")
    effective = apply_corrections(original, corrections)

    def row(f: Column, i: Column) -> Column:
        return F.struct(
            f["path"].alias("path"), field_label(f["path"]).alias("label"), f["value"].alias("value"),
            F.get("original", i)["value"].alias("original_value"),
            F.coalesce(F.array_contains("corrected_paths", f["path"]), F.lit(False)).alias("corrected"),
            f["confidence"].alias("confidence"), f["sources"].alias("sources"),
        )

    return rows_of(effective, ["doc_id"], F.transform("fields", row))


def review_counters(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per document (extraction_id, status, has_result): open tasks, corrections, what may be done."""
    counted = tasks.groupBy("extraction_id").agg(F.count_if(is_open(F.col("status"))).alias("_open"))
    corrected = correction_map(tasks).groupBy("extraction_id").agg(F.count("*").alias("_corrected"))
    joined = docs.join(counted, "extraction_id", "left").join(corrected, "extraction_id", "left")
    return joined.select(
        "extraction_id",
        F.coalesce("_open", F.lit(0)).alias("open_count"),
        F.coalesce("_corrected", F.lit(0)).alias("correction_count"),
        F.coalesce("has_result", F.lit(False)).alias("can_complete"),
        (F.col("status") == "completed").alias("can_export"),
    )


def delete_documents(
    docs: DataFrame, extractions: DataFrame, tasks: DataFrame, ids: DataFrame,
) -> dict[str, DataFrame]:
    """Remaining tables, freed object keys and refused ids; unfinished documents are not deleted."""
    asked = ids.select("doc_id").distinct().join(docs, "doc_id", "left")
    reason = F.when(F.col("status").isNull(), "unknown_document").when(
        F.col("status").isin("uploaded", "processing"), "still_processing")
    judged = asked.withColumn("reason", reason)
    gone = judged.where("reason IS NULL").select("doc_id", "object_key")
    dropped = extractions.join(gone, "doc_id", "left_semi").select("extraction_id")
    return {
        "documents": docs.join(gone, "doc_id", "left_anti"),
        "extractions": extractions.join(gone, "doc_id", "left_anti"),
        "tasks": tasks.join(dropped, "extraction_id", "left_anti"),
        "freed": gone.select("object_key"),
        "refused": judged.where("reason IS NOT NULL").select("doc_id", "reason"),
    }
