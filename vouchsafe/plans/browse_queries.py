"""Lists, search, integrity and dashboard over tables derived from orders and events."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.operators import browse as b
from vouchsafe.operators import dashboard as db
from vouchsafe.operators import guardrails as g
from vouchsafe.plans import views
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table
from vouchsafe.session import ensure_checkpoint_dir

NOW = dt.datetime(2001, 8, 1)
NOW_SQL = "timestamp '2001-08-01 00:00:00'"

B_DOCS = """
select o_orderkey as doc_id, o_custkey % 5 as tenant_id,
  concat('Scan_', cast(o_orderkey as string), case o_orderkey % 3 when 0 then '.pdf' when 1 then '.PNG' else '.tif' end) as file_name,
  case when o_orderkey % 8 = 0 then null else case o_orderkey % 5 when 0 then 'payment_invoice' when 1 then 'vat_invoice'
    when 2 then 'universal_transfer_document' when 3 then 'consignment_note_torg12' else 'work_completion_act' end end as detected_type,
  case o_orderkey % 7 when 0 then 'uploaded' when 1 then 'processing' when 2 then 'extracted' when 3 then 'failed'
    when 4 then 'review_required' else 'completed' end as status,
  o_orderdate + interval '1' second * (o_orderkey % 86400) as created_at,
  o_orderkey % 1000 as size_bytes,
  concat('aa/', cast(case when o_orderkey % 500 = 1 then o_orderkey - 1 else o_orderkey end as string)) as object_key
from {orders}"""
B_EXT = """
select o_orderkey as doc_id, o_orderkey * 10 + a as extraction_id, cast(a as int) as attempt_no,
  case when (o_orderkey + a) % 4 = 0 then 'failed' else 'succeeded' end as status,
  case when a = 1 then 'small' else 'large' end as model, case when o_orderkey % 2 = 0 then 'local' else 'cloud' end as provider,
  concat('v', cast(a as string)) as prompt_version,
  case when (o_orderkey + a) % 10 = 0 then null else (o_orderkey * 7 + a * 13) % 5000 end as input_tokens,
  case when (o_orderkey + a) % 10 = 1 then null when (o_orderkey + a) % 97 = 0 then -1 else (o_orderkey * 3 + a) % 500 end as output_tokens,
  case when (o_orderkey + a) % 5 = 0 then null else (o_orderkey * 11 + a) % 9000 end as response_ms,
  cast(((o_orderkey + a) % 103) * cast(0.01 as decimal(3,2)) as decimal(5,4)) as overall_confidence,
  case when (o_orderkey + a) % 4 = 0 then 'provider_error' end as error_code,
  case when (o_orderkey + a) % 4 = 0 then null when o_orderkey % 6 = 0 then 'memo' else 'vat_invoice' end as document_type,
  case when (o_orderkey + a) % 4 = 0 then null else concat('INV-', cast(o_orderkey as string)) end as number,
  case when (o_orderkey + a) % 4 = 0 then null else concat('Supplier ', cast(o_custkey % 100 as string)) end as supplier_name,
  case when (o_orderkey + a) % 4 = 0 then null else concat('Покупатель ', cast(o_custkey as string)) end as buyer_name,
  case when o_orderkey % 9 = 0 then 'n/a' else cast(cast(o_totalprice as decimal(18,2)) as string) end as total_amount,
  case o_orderkey % 3 when 0 then 'RUB' when 1 then 'USD' end as currency,
  case when o_orderkey % 11 = 0 then 'unknown' else concat(cast(cast(o_orderdate as date) as string), 'T00:00') end as doc_date
from {attempts} where a <= o_orderkey % 4"""
B_TASKS = """
select concat('t', cast(o_orderkey * 10 + a as string)) as task_id, o_orderkey * 10 + o_orderkey % 4 as extraction_id,
  case (o_orderkey + a) % 6 when 0 then '/number' when 1 then '/supplier/inn' when 2 then '/total_amount' when 3 then '/line_items/0/amount'
    when 4 then '/buyer/kpp' else '' end as field_path,
  case (o_orderkey + 3 * a) % 6 when 0 then 'total_mismatch: sums' when 1 then 'low_confidence: weak' when 2 then 'manual note'
    when 3 then 'rule same_parties and invalid_inn' when 4 then null else 'vat_rate_mismatch: rate' end as reason,
  case (o_orderkey + 2 * a) % 4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'resolved' else 'rejected' end as status,
  o_orderdate + interval '1' minute * a as created_at
from {attempts} where (o_orderkey + a) % 3 = 0"""
_SPARK_ATTEMPTS = "(select *, explode(array(1L, 2L, 3L)) as a from {orders})"
_CHECK_ATTEMPTS = "(select *, unnest([1, 2, 3]) as a from orders)"

view("b_docs", (), B_DOCS.replace("{orders}", "orders"))
view("b_ext", (), B_EXT.replace("{attempts}", _CHECK_ATTEMPTS))
view("b_tasks", (), B_TASKS.replace("{attempts}", _CHECK_ATTEMPTS))
LATEST = "select *, row_number() over (partition by doc_id order by attempt_no desc) as rn from b_ext"
view("b_latest", ("b_ext",), f"select * from ({LATEST}) where rn = 1")
view("b_rows", ("b_docs", "b_latest"), """
select d.*, l.document_type, l.number, l.supplier_name, l.buyer_name, l.total_amount, l.currency, l.doc_date, l.error_code,
  l.attempt_no, l.extraction_id from b_docs d left join b_latest l on l.doc_id = d.doc_id""")


def docs(spark, d) -> DataFrame:
    return spark.sql(B_DOCS, orders=table(spark, d, "orders"))


def extractions(spark, d) -> DataFrame:
    return spark.sql(B_EXT.replace("{attempts}", _SPARK_ATTEMPTS), orders=table(spark, d, "orders"))


def tasks(spark, d) -> DataFrame:
    return spark.sql(B_TASKS.replace("{attempts}", _SPARK_ATTEMPTS), orders=table(spark, d, "orders"))


def rows(spark, d) -> DataFrame:
    return b.latest_extraction(docs(spark, d), extractions(spark, d).drop("status"))


# --- families of list queries -------------------------------------------------------
@query("h1_latest_extraction", "select doc_id, status, attempt_no, extraction_id, number from b_rows", ("b_rows",))
def _(spark, d):
    return rows(spark, d).select("doc_id", "status", "attempt_no", "extraction_id", "number")


@query("h2_latest_success", """
select d.doc_id, d.status, e.extraction_id, e.number from b_docs d left join (
  select *, row_number() over (partition by doc_id order by attempt_no desc) as rn from b_ext where status = 'succeeded') e
  on e.doc_id = d.doc_id and e.rn = 1 where d.tenant_id = 3""", ("b_docs", "b_ext"))
def _(spark, d):
    return b.latest_success(docs(spark, d), extractions(spark, d), 3).select("doc_id", "status", "extraction_id", "number")


@query("h3_search_documents", """
select doc_id, file_name, number from b_rows where file_name ilike '%ПОКУПАТЕЛЬ 1_2%' or supplier_name ilike '%ПОКУПАТЕЛЬ 1_2%'
  or buyer_name ilike '%ПОКУПАТЕЛЬ 1_2%' or number ilike '%ПОКУПАТЕЛЬ 1_2%'""", ("b_rows",))
def _(spark, d):
    return b.search_documents(rows(spark, d), "ПОКУПАТЕЛЬ 1_2 ").select("doc_id", "file_name", "number")


@query("h4_filter_documents", "select doc_id, detected_type, status from b_docs where detected_type = 'vat_invoice' and status = 'completed'",
       ("b_docs",))
def _(spark, d):
    return b.filter_documents(docs(spark, d), "vat_invoice", "completed").select("doc_id", "detected_type", "status")


@query("h5_sort_documents", "select doc_id, file_name, status, created_at from b_docs order by file_name, doc_id", ("b_docs",))
def _(spark, d):
    return b.sort_documents(docs(spark, d), "file_name", "asc").select("doc_id", "file_name", "status", "created_at")


@query("h6_paginate", "select doc_id, file_name, created_at from b_docs order by created_at desc, doc_id limit 25 offset 50", ("b_docs",))
def _(spark, d):
    return b.paginate(b.sort_documents(docs(spark, d), "unknown", "down"), 3, 25).select("doc_id", "file_name", "created_at")


@query("h6_page_of_ranges", """
select doc_id, file_name, created_at, (select count(*) from b_docs) as total from b_docs order by created_at desc, doc_id limit 25 offset (
  select (count(*) // 50) * 25 from b_docs)""", ("b_docs",))
def _(spark, d):
    """A page in the middle of all documents."""
    known = docs(spark, d)
    paged = b.PagedTable(f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}")
    order = b.sort_order("uploaded_at", "desc")
    paged.write(known, order, 16)
    total = paged.total(spark)
    page = paged.page(spark, known.schema, order, total // 50 + 1, 25)
    return page.select("doc_id", "file_name", "created_at", F.lit(total).alias("total"))


@query("h6_page_after", "select doc_id, file_name, created_at from b_docs order by created_at desc, doc_id limit 25 offset 25", ("b_docs",))
def _(spark, d):
    last = b.page_after(docs(spark, d), None).collect()[-1]  # the page that the user has seen
    return b.page_after(docs(spark, d), (last["created_at"], last["doc_id"])).select("doc_id", "file_name", "created_at")


@query("h7_count_rows", "select count(*) as total from b_docs where status = 'review_required'", ("b_docs",))
def _(spark, d):
    return b.count_rows(b.sort_documents(b.filter_documents(docs(spark, d), status="review_required")))


@query("h8_facets", """
select distinct 'type' as facet, detected_type as value from b_docs where detected_type is not null
union all select distinct 'status', status from b_docs""", ("b_docs",))
def _(spark, d):
    return b.facets(docs(spark, d))


@query("h9_check_integrity", """
select 'documents' as table_name, 'size_positive' as rule, cast(doc_id as varchar) as row_key from b_docs where size_bytes <= 0
union all select 'documents', 'object_key_unique', object_key from b_docs group by object_key having count(*) > 1
union all select 'extractions', 'attempt_unique', concat(cast(doc_id as varchar), '#', cast(n as varchar))
  from (select doc_id, case when doc_id % 50 = 3 then 1 else attempt_no end as n from b_ext) group by doc_id, n having count(*) > 1
union all select 'extractions', 'confidence_range', cast(extraction_id as varchar) from b_ext where overall_confidence > 1 or overall_confidence < 0
union all select 'extractions', 'output_tokens_range', cast(extraction_id as varchar) from b_ext where output_tokens < 0
union all select 'extractions', 'document_exists', cast(extraction_id as varchar) from b_ext where doc_id % 200 = 7
union all select 'tasks', 'extraction_exists', task_id from b_tasks where extraction_id not in (select extraction_id from b_ext)""",
       ("b_docs", "b_ext", "b_tasks"))
def _(spark, d):
    ext = extractions(spark, d).withColumn("attempt_no", F.expr("case when doc_id % 50 = 3 then 1 else attempt_no end"))
    known = docs(spark, d)
    found = b.check_integrity(known, ext, tasks(spark, d))
    # documents with key % 200 = 7 are taken away for the reference check only
    orphans = b.check_integrity(known.where("doc_id % 200 <> 7"), ext, tasks(spark, d)).where("rule = 'document_exists'")
    return found.where("rule <> 'document_exists'").unionByName(orphans)


LABEL = "case {c} " + " ".join(f"when '{k}' then '{t}'" for k, t in fv.TYPE_LABELS.items()) + " else {c} end"


@query("h10_document_rows", f"""
select doc_id, file_name, {LABEL.format(c='coalesce(document_type, detected_type)')} as doc_type, supplier_name as counterparty,
  try_cast(total_amount as decimal(18,2)) as total_amount, currency, try_cast(substr(doc_date, 1, 10) as date) as doc_date, status,
  created_at as uploaded_at, size_bytes, error_code from b_rows""", ("b_rows",))
def _(spark, d):
    return b.document_rows(rows(spark, d))


@query("h11_line_rows", "select doc_id, idx as line_no, name, quantity, unit, unit_price, amount, vat_rate, vat_amount from fx_items",
       ("fx_items",))
def _(spark, d):
    return b.line_rows(views.documents(spark, d))


@query("h12_trace_rows", """
select extraction_id, provider, model, prompt_version, nullif(coalesce(input_tokens, 0) + coalesce(output_tokens, 0), 0) as total_tokens,
  cast(null as decimal(32,12)) as cost_usd, (doc_id % 5 = 0 or attempt_no % 2 = 0) as cache_hit, overall_confidence,
  case when doc_id % 3 = 0 then 2.5 when response_ms > 0 then cast(response_ms * cast(0.001 as decimal(4,3)) as decimal(18,6)) end as llm_seconds
from b_ext""", ("b_ext",))
def _(spark, d):
    logged = extractions(spark, d).selectExpr(
        "*", "cast(null as decimal(32,12)) as cost_usd", "case when doc_id % 5 = 0 then true end as settings_cache_hit",
        "array(cast(null as boolean), attempt_no % 2 = 0) as attempt_cache_hits",
        "case when doc_id % 3 = 0 then map('llm_extraction', cast(2.5 as decimal(18,6))) end as step_durations")
    return b.trace_rows(logged).withColumn("llm_seconds", F.try_element_at("step_durations", F.lit("llm_extraction"))).drop("step_durations")


# --- dashboard ----------------------------------------------------------------------
@query("i1_period_counts", f"""
select count(*) filter (created_at >= {NOW_SQL} - interval 30 day) as documents_current,
  count(*) filter (created_at < {NOW_SQL} - interval 30 day) as documents_previous
from b_docs where created_at >= {NOW_SQL} - interval 60 day and created_at < {NOW_SQL}""", ("b_docs",))
def _(spark, d):
    return db.period_counts(docs(spark, d), NOW)


@query("i2_daily_counts", f"""
select cast(created_at as date) as day, count(*) as n_documents from b_docs where created_at >= {NOW_SQL} - interval 30 day
group by cast(created_at as date)""", ("b_docs",))
def _(spark, d):
    return db.daily_counts(docs(spark, d), NOW)


@query("i3_status_counts", "select status, count(*) as n_documents from b_docs group by status", ("b_docs",))
def _(spark, d):
    return db.status_counts(docs(spark, d))


@query("i3_queue_rollup", """
select case when status = 'review_required' then 'Нужно проверить' when status in ('uploaded', 'processing', 'extracted') then 'В обработке'
  when status = 'completed' then 'Готово' else 'Ошибки' end as queue, count(*) as n_documents from b_docs group by 1""", ("b_docs",))
def _(spark, d):
    return db.queue_rollup(db.status_counts(docs(spark, d)))


@query("i4_recent_documents", "select doc_id, file_name, created_at, number from b_rows order by created_at desc, doc_id limit 5", ("b_rows",))
def _(spark, d):
    return db.recent_documents(docs(spark, d), extractions(spark, d).drop("status")).select("doc_id", "file_name", "created_at", "number")


TITLE = "case " + " ".join(f"when contains(coalesce(reason, ''), '{k}') then '{t}'" for k, t in fv.RULE_LABELS.items()) + \
    " else coalesce(nullif(field_path, ''), '—') end"
B_RUNS = """
select cast(cast(ts as date) as string) as run_id, min(ts) as started_at,
  case when day(min(ts)) % 4 = 0 then null else max(ts) end as completed_at,
  case day(min(ts)) % 3 when 0 then 'cheap_only' when 1 then 'expensive_only' else 'cascade' end as strategy,
  case when day(min(ts)) % 5 = 0 then null else 'm1' end as model
from {events} group by cast(ts as date)"""
view("b_runs", (), B_RUNS.replace("{events}", "events"))


@query("e14_violation_stats", f"""
select {TITLE} as label, count(*) as n_tasks, count(*) filter (status in ('resolved', 'rejected')) as n_passed
from b_tasks group by 1""", ("b_tasks",))
def _(spark, d):
    return g.violation_stats(tasks(spark, d))


@query("i5_event_feed", f"""
select * from (
  select * from (select 'document' as kind, file_name as title, coalesce({LABEL.format(c='detected_type')}, 'без типа') as subtitle, created_at,
    cast(doc_id as varchar) as ref from b_docs order by created_at desc, doc_id limit 12)
  union all select * from (select 'run', concat('Прогон ', run_id), concat_ws(' · ', nullif(strategy, ''), nullif(model, '')),
    coalesce(completed_at, started_at), run_id from b_runs order by started_at desc, run_id limit 12)
  union all select * from (select 'guardrail', {TITLE}, coalesce(reason, 'правило не пройдено'), t.created_at, cast(e.doc_id as varchar)
    from b_tasks t join b_ext e on e.extraction_id = t.extraction_id where t.status = 'pending' order by t.created_at desc, task_id limit 12))
order by created_at desc nulls last, kind, ref, title limit 12""", ("b_docs", "b_runs", "b_tasks", "b_ext"))
def _(spark, d):
    runs = spark.sql(B_RUNS, events=table(spark, d, "events"))
    return db.event_feed(docs(spark, d), runs, tasks(spark, d), extractions(spark, d))
