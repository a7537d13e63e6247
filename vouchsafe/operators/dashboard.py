"""Aggregates for overview pages; the clock is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.numbers import delta
from vouchsafe.operators.browse import latest_rows, type_label
from vouchsafe.operators.guardrails import rule_label
from vouchsafe.session import settle


def _moment(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def period_counts(docs: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """Documents of the last period and of the one before, in one pass over two periods."""
    start, before = now - dt.timedelta(days=days), now - dt.timedelta(days=2 * days)
    made = F.col("created_at")
    recent = docs.where((made >= _moment(before)) & (made < _moment(now)))
    return recent.agg(
        F.count_if(made >= _moment(start)).alias("documents_current"),
        F.count_if(made < _moment(start)).alias("documents_previous"),
    )


def daily_counts(docs: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    start = now - dt.timedelta(days=days)
    recent = docs.where(F.col("created_at") >= _moment(start))
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_documents"))


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count("*").alias("n_documents"))


def queue_rollup(counts: DataFrame) -> DataFrame:
    """Four work queues out of the status counts; statuses outside of them are not shown."""
    queue = F.lit(None).cast("string")
    for label, statuses in fv.QUEUES.items():
        queue = F.when(F.col("status").isin(*statuses), label).otherwise(queue)
    return counts.select(queue.alias("queue"), "n_documents").where("queue IS NOT NULL").groupBy("queue").agg(
        F.sum("n_documents").alias("n_documents"))


def recent_documents(docs: DataFrame, extractions: DataFrame, k: int = 5) -> DataFrame:
    """The newest documents with their latest extraction; the top-k is taken before the join."""
    newest = docs.orderBy(F.desc("created_at"), F.asc("doc_id")).limit(k)
    mine = extractions.join(newest.select("doc_id"), "doc_id", "left_semi")
    return newest.join(latest_rows(mine), "doc_id", "left")


#: Tasks that are looked at for the feed before all of them are joined.
WIDEST = 100_000


def newest_with_document(tasks: DataFrame, extractions: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` tasks whose extraction exists, with its doc_id.

    The newest tasks are taken first and only they are joined; where orphans leave gaps, more are taken. The join
    gets ``k`` tasks as a rule, and all of them only behind more than WIDEST orphans.
    """
    order = [F.desc("created_at"), F.asc("task_id")]
    owners = extractions.select("extraction_id", "doc_id")
    n = k
    while n <= WIDEST:
        first = settle(tasks.orderBy(*order).limit(n))
        mine = settle(owners.join(F.broadcast(first.select("extraction_id").distinct()), "extraction_id", "left_semi"))
        found = first.join(F.broadcast(mine), "extraction_id")  # n rows at most on either side
        if found.count() >= k or first.count() < n:
            return found.orderBy(*order).limit(k)
        n *= 8
    return tasks.join(owners, "extraction_id").orderBy(*order).limit(k)


def event_feed(docs: DataFrame, runs: DataFrame, tasks: DataFrame, extractions: DataFrame, k: int = 12) -> DataFrame:
    """Newest uploads, runs and pending tasks; each source is cut before they are merged."""
    uploads = docs.orderBy(F.desc("created_at"), F.asc("doc_id")).limit(k).select(
        F.lit("document").alias("kind"), F.col("file_name").alias("title"),
        F.coalesce(type_label(F.col("detected_type")), F.lit("без типа")).alias("subtitle"),
        "created_at", F.col("doc_id").cast("string").alias("ref"),
    )
    done = runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(k).select(
        F.lit("run").alias("kind"), F.concat(F.lit("Прогон "), F.col("run_id").cast("string")).alias("title"),
        F.concat_ws(" · ", F.nullif("strategy", F.lit("")), F.nullif("model", F.lit(""))).alias("subtitle"),
        F.coalesce("completed_at", "started_at").alias("created_at"), F.col("run_id").cast("string").alias("ref"),
    )
    waiting = newest_with_document(tasks.where(F.col("status") == "pending"), extractions, k).select(
        F.lit("guardrail").alias("kind"),
        rule_label(F.coalesce("reason", F.lit("")), F.col("field_path")).alias("title"),
        F.coalesce("reason", F.lit("правило не пройдено")).alias("subtitle"),
        "created_at", F.col("doc_id").cast("string").alias("ref"),
    )
    merged = uploads.unionByName(done).unionByName(waiting)
    return merged.orderBy(F.desc_nulls_last("created_at"), "kind", "ref", "title").limit(k)


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(n)


def run_series(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last runs in ascending time."""
    return last_runs(runs, n).orderBy("started_at", F.desc("run_id")).select(
        "run_id", "started_at", "accuracy", "duration_seconds", "cost_usd")


def series_step_totals(runs: DataFrame, n: int = 20) -> DataFrame:
    """Step totals over the last runs (``step_totals`` map)."""
    return last_runs(runs, n).select(F.explode("step_totals").alias("step", "seconds")).groupBy("step").agg(
        F.sum("seconds").cast("decimal(18,6)").alias("seconds"))


def kpi_latest(runs: DataFrame, n: int = 20) -> DataFrame:
    """Latest and previous known accuracy and duration, and the cost sum, over the last runs."""

    def known(column: str) -> Column:
        # the series holds at most n runs
        values = F.filter(F.sort_array(F.collect_list(F.struct("started_at", column)), asc=False),
                          lambda s: s[column].isNotNull())
        return values

    picked = last_runs(runs, n).agg(
        known("accuracy").alias("a"), known("duration_seconds").alias("d"), F.sum("cost_usd").alias("cost_total"))
    get = lambda c, i: F.get(c, F.lit(i))
    return picked.select(
        get("a", 0)["accuracy"].alias("accuracy_current"), get("a", 1)["accuracy"].alias("accuracy_previous"),
        get("d", 0)["duration_seconds"].alias("duration_current"), get("d", 1)["duration_seconds"].alias("duration_previous"),
        "cost_total",
    )


def with_deltas(rows: DataFrame, current: str, previous: str, kind: str = "percent", higher_is_better: bool = True) -> DataFrame:
    change = delta(F.col(current), F.col(previous), kind=kind, higher_is_better=higher_is_better)
    return rows.withColumn("_d", change).select(*rows.columns, "_d.*")

