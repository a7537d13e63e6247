"""Continuous operators run over the events table until it is drained, and the model rounds."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vouchsafe.operators import model_calls as m
from vouchsafe.operators.admission import admit_files, describe_files
from vouchsafe.plans.model_queries import STEPS
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table
from vouchsafe.session import ensure_checkpoint_dir, settle
from vouchsafe.streaming import flows
from vouchsafe.streaming.keyed import KeyedTable


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def drained(spark: SparkSession, changes: DataFrame, key: list[str]) -> DataFrame:
    """Run a stream over what is there into a keyed table in the shared folder, and read that."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = KeyedTable(f"{base}/table", changes.schema, key)
    writer = flows.stream_into(changes, table).option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return table.read(spark)


STATUS = """
user_id as doc_id, case event_type when 'signup' then 'uploaded' when 'view' then 'processing' when 'click' then 'extracted'
  when 'error' then 'failed' else 'completed' end as status, ts, event_id % 10 = 0 as is_correction"""


@query("l3_stream_status", f"""
with s as (select {STATUS} from events), r as (select *, case status when 'uploaded' then 0 when 'processing' then 1 when 'extracted' then 2 when 'completed' then 4 else 5 end as k from s),
 l as (select doc_id, status, row_number() over (partition by doc_id order by ts desc, k desc) as n from r),
 b as (select doc_id, status, row_number() over (partition by doc_id order by ts desc, k desc) as n from r where status in ('completed', 'failed') or is_correction)
select l.doc_id, case when b.status in ('completed', 'failed') then b.status else l.status end as status from l left join b on b.doc_id = l.doc_id and b.n = 1 where l.n = 1""")
def _(spark, d):
    changes = spark.sql(f"select {STATUS} from {{events}}", events=events_stream(spark, d))
    return drained(spark, flows.stream_status(changes), ["doc_id"])


@query("l4_stream_daily_counts", """
select cast(ts as date) as day, count(*) as n_documents from events group by 1""")
def _(spark, d):
    timed = events_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, flows.stream_daily_counts(timed), ["day"])


@query("l5_stream_step_totals", "select run_id, step, seconds from run_steps", ("run_steps",))
def _(spark, d):
    columns = STEPS.split("select", 1)[1].rsplit("from", 1)[0]
    log = spark.sql(f"select {columns} from {{events}}", events=events_stream(spark, d))
    return drained(spark, flows.stream_step_totals(log), ["run_id", "step"])


@query("l1_stream_ingest", """
with f as (select concat('landing/', doc_id, '.pdf') as file_id, doc_id % 3 as arrival, sha256('%PDF-' || text) as sha, octet_length(encode('%PDF-' || text)) as size from documents),
 k as (select *, concat(substr(sha, 1, 2), '/', substr(sha, 3, 2), '/', sha, '.pdf') as object_key from f where size <= 5000),
 a as (select *, min(arrival) over (partition by object_key) as first from k),
 d as (select *, min(case when arrival = first then file_id end) over (partition by object_key) as doc_id from a)
select file_id, object_key, doc_id, case when first = 0 and arrival > 0 and size % 2 = 0 then 'completed' else 'uploaded' end as status, file_id <> doc_id as already_existed from d""")
def _(spark, d):
    """Files arrive in three parts; after the first one, half of its documents are processed."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    path = F.concat(F.lit("landing/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    raw = table(spark, d, "documents").select(
        "doc_id", path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"),
        F.concat(F.lit("%PDF-"), "text").cast("binary").alias("content"))
    files = settle(admit_files(describe_files(raw), 5000))
    statuses = KeyedTable(f"{base}/statuses", StructType().add("doc_id", "string").add("status", "string"), ["doc_id"])
    for arrival in range(3):
        files.where(F.col("doc_id") % 3 == arrival).drop("doc_id").write.mode("append").parquet(f"{base}/landing")
        arrived = spark.readStream.schema(files.drop("doc_id").schema).parquet(f"{base}/landing")
        writer = flows.stream_ingest_into(arrived, f"{base}/documents", f"{base}/results", statuses=statuses)
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        if arrival == 0:
            done = flows.read_documents(spark, f"{base}/documents").where("size_bytes % 2 = 0")
            statuses.merge(done.select("doc_id", F.lit("completed").alias("status")), 0)
    return flows.read_results(spark, f"{base}/results").drop("batch")


def _known(value: str | None) -> dict:
    return {"value": value, "confidence": 0.9 if value else 0.0, "sources": [{"kind": "pdf_text", "page": 1}] if value else []}


_PARTY = {"name": _known("ООО Ромашка"), "inn": _known("7707083893"), "kpp": _known(None)}
#: An answer that the schema accepts.
ACCEPTED = json.dumps({
    "document_type": _known("payment_invoice"), "number": _known("42"), "date": _known("2026-07-25"), "supplier": _PARTY, "buyer": _PARTY,
    "total_amount": _known("1200.00"), "vat_amount": _known("200.00"), "currency": _known("RUB"), "line_items": [],
})


def _echo_model(batches):
    """Deterministic stand-in for a model: by text length a timeout, a good answer at once or when asked again, or none."""
    for batch in batches:
        rows = []
        for key, messages in zip(batch.key, batch.messages):
            size = len(messages[0]["content"])
            down = size % 7 == 0
            good = size % 5 == 1 or (size % 5 == 2 and len(messages) > 1)
            answer = None if down else ACCEPTED if good else '{"size": %d}' % size
            rows.append((key, answer, size, len(messages), 1, "timeout" if down else None))
        yield pd.DataFrame(rows, columns=m.RESPONSE.names)


@query("d7_run_model", """
with k as (select distinct sha256(text) as key, length(text) % 7 = 0 as down, length(text) % 5 as kind from documents)
select key, 1 as attempt, case when down then 'timeout' end as provider_error, case when not down and kind <> 1 then 'schema' end as validation_error from k
union all select key, 2, null, case when kind <> 2 then 'schema' end from k where not down and kind <> 1""")
def _(spark, d):
    contents = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "text").groupBy("key").agg(F.min("text").alias("text"))
    pending = contents.selectExpr("key", "array(named_struct('role', 'user', 'content', text)) as messages")
    return m.run_model(pending, _echo_model).select("key", "attempt", "provider_error", "validation_error")
