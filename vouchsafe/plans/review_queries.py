"""Review, cascade and export over the derived documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.numbers import confidence_bucket, russian_date
from vouchsafe.functions.text import coerce_correction
from vouchsafe.operators import cascade as cs
from vouchsafe.operators import exports as ex
from vouchsafe.operators import fields as fl
from vouchsafe.operators import guardrails as g
from vouchsafe.operators import review as r
from vouchsafe.plans import browse_queries as bq
from vouchsafe.plans import views
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table

NOW = dt.datetime(2001, 8, 1)
NOW_SQL = "timestamp '2001-08-01 00:00:00'"
PATHS = ("case {n} % 7 when 0 then '/number' when 1 then '/supplier/inn' when 2 then '/total_amount' when 3 then '/line_items/0/vat_amount' "
         "when 4 then '/buyer/kpp' when 5 then '/date' else '/supplier/name' end")
TASKS = f"""
select concat('t', cast(o_orderkey * 10 + a as string)) as task_id, o_orderkey as extraction_id, {PATHS.format(n='(o_orderkey + a * a)')} as field_path,
  case (o_orderkey + a) % 3 when 0 then 'manual_correction: x' when 1 then 'total_mismatch: y' else 'note' end as reason,
  case (o_orderkey + 2 * a) % 4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'resolved' else 'rejected' end as status,
  concat('old', cast(a as string)) as original_value,
  case when (o_orderkey + a) % 5 = 0 then null when (o_orderkey + a) % 5 = 1 then '' else concat('v', cast(a as string)) end as corrected_value,
  cast(null as string) as resolution_comment, o_orderdate + interval '1' minute * a as created_at, cast(null as {{TS}}) as resolved_at
from {{attempts}} where (o_orderkey + a) % 2 = 0"""
REQUESTS = f"""
select o_orderkey as extraction_id, {PATHS.format(n='(o_orderkey + 1)')} as field_path,
  case when o_orderkey % 4 = 0 then '  ' else concat(' new ', cast(o_orderkey as string), ' ') end as value, 'before' as original_value
from {{orders}} where o_orderkey % 3 = 0"""
view("g_tasks", (), TASKS.replace("{TS}", "timestamp").replace("{attempts}", bq._CHECK_ATTEMPTS))
view("g_requests", (), REQUESTS.replace("{orders}", "orders"))
view("g_map", ("g_tasks",), """
select extraction_id, field_path, arg_max_null(corrected_value, created_at) as value from g_tasks
where status = 'resolved' and (corrected_value is not null or reason like 'manual_correction%') group by extraction_id, field_path""")


def tasks(spark, d) -> DataFrame:
    text = TASKS.replace("{TS}", "timestamp_ntz").replace("{attempts}", bq._SPARK_ATTEMPTS)
    return spark.sql(text, orders=table(spark, d, "orders"))


def requests(spark, d) -> DataFrame:
    return spark.sql(REQUESTS, orders=table(spark, d, "orders"))


def nested(spark, d) -> DataFrame:
    return fl.with_fields(views.documents(spark, d))


# --- review -----------------------------------------------------------------------------
@query("g1_correction_map", "select * from g_map", ("g_map",))
def _(spark, d):
    return r.correction_map(tasks(spark, d))


view("g_effective", ("fx_fields", "g_map"), """
select f.doc_id, f.ord, f.path, case when m.extraction_id is not null then m.value else f.value end as value,
  case when m.extraction_id is null then f.confidence when coalesce(m.value, '') = '' then cast(0 as double) else cast(1 as double) end as confidence,
  case when m.extraction_id is null then case when f.value is null then 0 else 1 end when coalesce(m.value, '') = '' then 0 else 1 end as n_sources,
  f.value as original_value, m.extraction_id is not null as corrected
from fx_fields f left join g_map m on m.extraction_id = f.doc_id and m.field_path = f.path""")


@query("g2_apply_corrections", "select doc_id, ord, path, value, confidence, n_sources from g_effective", ("g_effective",))
def _(spark, d):
    rows = r.apply_corrections(nested(spark, d), r.correction_map(tasks(spark, d)))
    return fl.rows_of(rows, ["doc_id"], "fields").selectExpr("doc_id", "ord", "path", "value", "confidence", "size(sources) as n_sources")


@query("g3_coerce_correction", "select extraction_id, nullif(trim(value), '') as value from g_requests", ("g_requests",))
def _(spark, d):
    return requests(spark, d).select("extraction_id", coerce_correction(F.col("value")).alias("value"))


@query("g4_validate_corrections")
def _(spark, d):
    return r.validate_corrections(nested(spark, d), r.correction_map(tasks(spark, d)), requests(spark, d))


@query("g5_upsert_corrections", f"""
select t.extraction_id, t.field_path, case when n.task_id is not null then '{fv.MANUAL_REASON}' else t.reason end as reason,
  case when n.task_id is not null then 'resolved' else t.status end as status, t.original_value,
  case when n.task_id is not null then nullif(trim(n.value), '') else t.corrected_value end as corrected_value, t.created_at
from g_tasks t left join (select t.task_id, q.value, row_number() over (partition by t.extraction_id, t.field_path order by t.created_at desc, t.task_id desc) as rn
  from g_tasks t join g_requests q on q.extraction_id = t.extraction_id and q.field_path = t.field_path) n on n.task_id = t.task_id and n.rn = 1
union all select extraction_id, field_path, '{fv.MANUAL_REASON}', 'resolved', original_value, nullif(trim(value), ''), {NOW_SQL} from g_requests q
where not exists (select 1 from g_tasks t where q.extraction_id = t.extraction_id and q.field_path = t.field_path)""", ("g_tasks", "g_requests"))
def _(spark, d):
    return r.upsert_corrections(tasks(spark, d), requests(spark, d), NOW).select(
        "extraction_id", "field_path", "reason", "status", "original_value", "corrected_value", "created_at")


# violations of the total and date rules are the active ones here
view("g_violations", ("v_total", "v_date"), """
select doc_id as extraction_id, field_path, concat(rule, ': ', message) as reason, actual, blocking from v_total
union all select doc_id, field_path, concat(rule, ': ', message), actual, blocking from v_date""")
RULES = {"total": g.total_rule, "date": g.date_rule}
view("g_open", ("g_tasks",), """
select * exclude (rn) from (select *, row_number() over (partition by extraction_id, field_path order by created_at, task_id) as rn
from g_tasks where status in ('pending', 'in_progress')) where rn = 1""")


def _violations(spark, d) -> DataFrame:
    return g.evaluate_guardrails(views.documents(spark, d), views.SETTINGS, RULES)


def _scope(spark, d) -> DataFrame:
    return views.documents(spark, d).select(F.col("doc_id").alias("extraction_id"))


@query("g6_reconcile_tasks", """
select t.extraction_id, t.field_path, case when o.task_id is not null and v.reason is not null then v.reason else t.reason end as reason,
  case when t.status in ('pending', 'in_progress') and d.doc_id is not null and v.reason is null then 'resolved'
    when o.task_id is not null and v.reason is not null then 'pending' else t.status end as status, t.original_value
from g_tasks t left join fx_docs d on d.doc_id = t.extraction_id left join g_violations v on v.extraction_id = t.extraction_id and v.field_path = t.field_path
  left join g_open o on o.task_id = t.task_id
union all select v.extraction_id, v.field_path, v.reason, 'pending', v.actual from g_violations v
where not exists (select 1 from g_open o where o.extraction_id = v.extraction_id and o.field_path = v.field_path)""",
       ("g_tasks", "g_violations", "g_open", "fx_docs"))
def _(spark, d):
    return r.reconcile_tasks(tasks(spark, d), _violations(spark, d), _scope(spark, d), NOW).select(
        "extraction_id", "field_path", "reason", "status", "original_value")


# every document, and as many numbers that no document has
COMPLETION = "select o_orderkey as extraction_id, o_orderkey % 2 = 0 as confirm from {orders} union all select -o_orderkey, true from {orders}"


@query("g7_complete_review", """
select q.extraction_id, coalesce(n, 0) as issues, case when b.status is null then 'unknown_document' when b.status <> 'review_required' then 'not_in_review' end as refused,
  coalesce(b.status = 'review_required' and (coalesce(n, 0) = 0 or confirm), false) as completed from (
  select o_orderkey as extraction_id, o_orderkey % 2 = 0 as confirm from orders union all select -o_orderkey, true from orders) q
left join b_docs b on b.doc_id = q.extraction_id left join (select extraction_id, count(*) as n from g_violations group by extraction_id) v on v.extraction_id = q.extraction_id""",
       ("b_docs", "g_violations"))
def _(spark, d):
    wanted = spark.sql(COMPLETION, orders=table(spark, d, "orders"))
    docs = bq.docs(spark, d).selectExpr("doc_id as extraction_id", "status", "true as has_result")
    outcomes, _ = r.complete_review(docs, tasks(spark, d), _violations(spark, d), wanted, NOW)
    return outcomes.select("extraction_id", "issues", "refused", "completed")


view("g_accepted", ("b_docs", "g_violations"), """
select q.o_orderkey as extraction_id, coalesce(n, 0) as issues, coalesce(n, 0) > 0 and q.o_orderkey % 2 = 0 as confirmed
from orders q join b_docs b on b.doc_id = q.o_orderkey left join (select extraction_id, count(*) as n from g_violations group by 1) v on v.extraction_id = q.o_orderkey
where b.status = 'review_required'""")
view("g_reconciled", ("g_tasks", "g_violations", "g_open", "g_accepted"), f"""
select t.extraction_id, t.field_path, v.reason is not null as active, coalesce(a.confirmed, false) as confirmed, t.original_value,
  case when o.task_id is not null and v.reason is not null then v.reason else t.reason end as reason,
  case when t.status in ('pending', 'in_progress') and a.extraction_id is not null and v.reason is null then 'resolved'
    when o.task_id is not null and v.reason is not null then 'pending' else t.status end as status,
  case when t.status in ('pending', 'in_progress') and a.extraction_id is not null and v.reason is null then '{fv.COMMENT_PASSED}'
    when o.task_id is not null and v.reason is not null then null else t.resolution_comment end as resolution_comment
from g_tasks t left join g_accepted a using (extraction_id) left join g_violations v on a.extraction_id is not null and v.extraction_id = t.extraction_id and v.field_path = t.field_path
  left join g_open o on o.task_id = t.task_id
union all select v.extraction_id, v.field_path, true, a.confirmed, v.actual, v.reason, 'pending', null from g_violations v join g_accepted a using (extraction_id)
where not exists (select 1 from g_open o where o.extraction_id = v.extraction_id and o.field_path = v.field_path)""")


@query("g7_completed_tasks", f"""
select extraction_id, field_path, reason, original_value, case when confirmed and active and status in ('pending', 'in_progress') then 'resolved' else status end as status,
  case when confirmed and active and status in ('pending', 'in_progress') then '{fv.COMMENT_CONFIRMED}' else resolution_comment end as resolution_comment from g_reconciled
union all select extraction_id, '{fv.CONFIRMATION_PATH}', '{fv.CONFIRMATION_REASON}', '{fv.CONFIRMATION_ORIGINAL}', 'resolved',
  concat('Пользователь подтвердил ', issues, ' расхождений') from g_accepted where confirmed""", ("g_reconciled", "g_accepted"))
def _(spark, d):
    wanted = spark.sql(COMPLETION, orders=table(spark, d, "orders"))
    docs = bq.docs(spark, d).selectExpr("doc_id as extraction_id", "status", "true as has_result")
    done = r.complete_review(docs, tasks(spark, d), _violations(spark, d), wanted, NOW)[1]
    return done.select("extraction_id", "field_path", "reason", "original_value", "status", "resolution_comment")


FIELD_LABEL = "case path " + " ".join(f"when '/{k}' then '{t}'" for k, t in fv.FIELD_LABELS.items()) + " end"
view("g_diff", ("g_effective",), f"select doc_id, path, {FIELD_LABEL} as label, value, original_value, corrected, confidence from g_effective where path not like '/line_items/%'")


@query("g8_field_diff", "select * from g_diff", ("g_diff",))
def _(spark, d):
    scalars = fl.with_fields(views.documents(spark, d), lines=False)  # the operator shows no others
    return r.field_diff(scalars, r.correction_map(tasks(spark, d))).drop("sources")


@query("g9_review_counters", """
select b.doc_id as extraction_id, coalesce(n, 0) as open_count, coalesce(m.k, 0) as correction_count, b.doc_id % 2 = 0 as can_complete, b.status = 'completed' as can_export
from b_docs b left join (select extraction_id, count(*) filter (status in ('pending', 'in_progress')) as n from g_tasks group by 1) t on t.extraction_id = b.doc_id
  left join (select extraction_id, count(*) as k from g_map group by 1) m on m.extraction_id = b.doc_id""", ("b_docs", "g_tasks", "g_map"))
def _(spark, d):
    docs = bq.docs(spark, d).selectExpr("doc_id as extraction_id", "status", "doc_id % 2 = 0 as has_result")
    return r.review_counters(docs, tasks(spark, d))


def _deleted(spark, d) -> dict[str, DataFrame]:
    ids = table(spark, d, "orders").selectExpr("o_orderkey as doc_id").where("doc_id % 4 = 0")
    return r.delete_documents(bq.docs(spark, d), bq.extractions(spark, d), bq.tasks(spark, d), ids)


GONE = "doc_id % 4 = 0 and doc_id % 7 > 1"


@query("g10_delete_documents", f"""
select 'documents' as part, count(*) as n from b_docs where not ({GONE})
union all select 'extractions', count(*) from b_ext where not ({GONE})
union all select 'tasks', count(*) from b_tasks where extraction_id not in (select extraction_id from b_ext where {GONE})
union all select 'freed', count(*) from b_docs where {GONE} union all select 'refused', count(*) from b_docs where doc_id % 4 = 0 and doc_id % 7 <= 1""",
       ("b_docs", "b_ext", "b_tasks"))
def _(spark, d):
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in _deleted(spark, d).items()]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


@query("g11_confidence_bucket", """
select bucket, count(*) as n from (select case when value is null then 'none' when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as bucket from fx_fields) group by bucket""",
       ("fx_fields",))
def _(spark, d):
    score = F.when(F.col("value").isNotNull(), F.col("confidence"))
    return views.fields(spark, d).groupBy(confidence_bucket(score).alias("bucket")).agg(F.count("*").alias("n"))


# --- cascade ---------------------------------------------------------------------------
@query("f1_escalation_split", "select doc_id, requires_review as escalated from v_summary", ("v_summary",))
def _(spark, d):
    return cs.with_escalation(views.documents(spark, d), views.SETTINGS).select("doc_id", "escalated")


view("f_disputed", ("fx_fields", "v_all"), """
select distinct f.doc_id, f.path from fx_fields f join v_all v on v.doc_id = f.doc_id
where f.path = v.field_path or (starts_with(f.path, concat(v.field_path, '/'))
  and v.field_path not in (select path from fx_fields x where x.doc_id = v.doc_id))""")
view("f_pairs", ("fx_fields", "v_all"), """
select distinct f.doc_id, f.path from fx_fields f join (select distinct doc_id, field_path from v_all) v on v.doc_id = f.doc_id
  and (f.path = v.field_path or (v.field_path = '/buyer' and f.path like '/buyer/%'))""")


def marked(spark, d) -> DataFrame:
    return cs.with_disputed(views.documents(spark, d), views.SETTINGS)


@query("f2_disputed_paths", "select * from f_pairs", ("f_pairs",))
def _(spark, d):
    return cs.disputed_paths(marked(spark, d)).select("doc_id", "path")


@query("f3_reask_requests", "select doc_id, count(*) as n_disputed from f_pairs group by doc_id", ("f_pairs",))
def _(spark, d):
    return cs.reask_requests(marked(spark, d)).where("request_json like '{%'").select("doc_id", F.col("n_disputed").cast("bigint"))


ANSWERS = """
select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'no json' when 1 then '[1]'
  else concat('{{"/number": {{"value": "N', cast(o_orderkey as string), '", "confidence": 0.9, "sources": [{{"kind": "ocr", "page": 2}}]}}, ',
    '"/currency": {{"value": "RUB", "confidence": 1.0, "sources": []}}, "number": {{"value": "X", "confidence": 0.5, "sources": []}}, "/date": {{"value": null, "confidence": 0}}, "x": 3}}') end as content from {orders}"""


def corrections(spark, d) -> DataFrame:
    return cs.parse_corrections(spark.sql(ANSWERS, orders=table(spark, d, "orders")))


view("f_corrections", (), """
select o_orderkey as doc_id, '/number' as path, concat('N', cast(o_orderkey as varchar)) as value, cast(0.9 as double) as confidence, 1 as n_sources from orders where o_orderkey % 5 > 1
union all select o_orderkey, '/currency', 'RUB', cast(1 as double), 0 from orders where o_orderkey % 5 > 1
union all select o_orderkey, 'number', 'X', cast(0.5 as double), 0 from orders where o_orderkey % 5 > 1""")


@query("f4_parse_corrections", "select * from f_corrections", ("f_corrections",))
def _(spark, d):
    return corrections(spark, d).selectExpr("doc_id", "path", "value", "confidence", "size(sources) as n_sources")


@query("f5_restrict_corrections", """
select c.doc_id, c.path, p.path is not null as asked from f_corrections c left join f_pairs p on p.doc_id = c.doc_id and p.path = c.path""", ("f_corrections", "f_pairs"))
def _(spark, d):
    return cs.with_asked(corrections(spark, d), cs.disputed_paths(marked(spark, d))).select("doc_id", "path", "asked")


@query("f6_overlay_corrections", """
select f.doc_id, f.path, case when c.doc_id is not null then c.value else f.value end as value,
  case when c.doc_id is not null then c.confidence else f.confidence end as confidence
from fx_fields f left join f_corrections c on c.doc_id = f.doc_id and c.path = f.path""",
       ("fx_fields", "f_corrections"))
def _(spark, d):
    done = fl.overlay_fields(nested(spark, d), corrections(spark, d))
    return fl.rows_of(done, ["doc_id"], "fields").select("doc_id", "path", "value", "confidence")


@query("f6_corrected_documents", """
select d.doc_id, case when c.doc_id is not null then c.value else d.number end as number from fx_docs d left join (
  select * from f_corrections where path = '/number') c on c.doc_id = d.doc_id""", ("fx_docs", "f_corrections"))
def _(spark, d):
    done = cs.corrected_documents(nested(spark, d), corrections(spark, d))
    return done.select("doc_id", F.col("number.value").alias("number"))


@query("f7_field_provenance", """
select f.doc_id, f.path, case when p.path is not null then 'large' else 'small' end as model from fx_fields f left join f_pairs p on p.doc_id = f.doc_id and p.path = f.path""",
       ("fx_fields", "f_pairs"))
def _(spark, d):
    return cs.field_provenance(cs.with_disputed(views.documents(spark, d), views.SETTINGS, every=True), None, "small", "large")


@query("f8_cascade_usage", """
select count(*) as n_documents, count(*) filter (k > 0) as n_escalated, count(*) filter (k > 0) / cast(count(*) as double) as escalation_rate, sum(k) as n_asked_paths,
  sum(doc_id % 100) filter (k > 0) as costly_input_tokens, sum(doc_id % 10) filter (k > 0) as costly_output_tokens from (
  select d.doc_id, count(p.path) as k from fx_docs d left join f_pairs p on p.doc_id = d.doc_id group by d.doc_id)""", ("fx_docs", "f_pairs"))
def _(spark, d):
    asked = marked(spark, d).select("doc_id", F.size("disputed").alias("n_asked"))
    rows = views.documents(spark, d).select("doc_id").join(asked, "doc_id", "left")
    return cs.cascade_usage(rows.selectExpr(
        "doc_id", "n_asked", "coalesce(n_asked, 0) > 0 as used_costly", "doc_id % 100 as input_tokens", "doc_id % 10 as output_tokens"))


# --- exports ---------------------------------------------------------------------------
ZERO = "coalesce({c}, cast(0 as decimal(18,2)))"
LINE_TOTAL = f"case when amount is not null or vat_amount is not null then cast({ZERO.format(c='amount')} + {ZERO.format(c='vat_amount')} as decimal(18,2)) end"
view("k_items", ("fx_items", "fx_docs"), "select i.* from fx_items i join fx_docs d on d.doc_id = i.doc_id and d.status = 'completed'")


@query("k1_export_positions", f"""
select doc_id, idx + 1 as no, name, unit, quantity, unit_price, amount,
  case when try_cast(vat_rate as decimal(9,4)) > 1 then cast(try_cast(vat_rate as decimal(9,4)) * cast(0.01 as decimal(3,2)) as decimal(9,4)) else try_cast(vat_rate as decimal(9,4)) end as vat_fraction,
  case when vat_rate = 'without_vat' then '{fv.WITHOUT_VAT_LABEL}' end as vat_label, vat_amount, {LINE_TOTAL} as total from k_items""", ("k_items",))
def _(spark, d):
    return ex.export_positions(views.documents(spark, d))


# lines as maps of text: other names, own totals, and totals that are no number
LOOSE = """transform(line_items, (x, i) -> map_filter(map_from_arrays(
    case when i % 2 = 0 then array('name', 'unit_name', 'qty', 'price', 'subtotal', 'vat_rate', 'vat_amount', 'total_amount', 'amount_words')
      else array('name', 'unit', 'quantity', 'unit_price', 'amount', 'vat_rate', 'vat_amount', 'total', 'note') end,
    array(x.name.value, x.unit.value, cast(x.quantity.value as string), cast(x.unit_price.value as string), cast(x.amount.value as string),
      cast(x.vat_rate.value as string), cast(x.vat_amount.value as string), case i % 3 when 0 then concat(i, '7.25') when 1 then 'сто' end, 'x')),
    (k, v) -> not (k = 'total' and i % 5 = 0)))"""
OWN_TOTAL = "coalesce(case when idx % 3 = 0 and not (idx % 2 = 1 and idx % 5 = 0) then cast(concat(idx, '7.25') as decimal(18,2)) end, " + LINE_TOTAL + ")"


@query("k1_loose_positions", f"""
select doc_id, idx + 1 as no, name, unit, quantity, cast(unit_price as decimal(18,2)) as unit_price, amount,
  case when try_cast(vat_rate as decimal(9,4)) > 1 then cast(try_cast(vat_rate as decimal(9,4)) * cast(0.01 as decimal(3,2)) as decimal(9,4)) else try_cast(vat_rate as decimal(9,4)) end as vat_fraction,
  case when vat_rate = 'without_vat' then '{fv.WITHOUT_VAT_LABEL}' end as vat_label, vat_amount, {OWN_TOTAL} as total from k_items""", ("k_items",))
def _(spark, d):
    return ex.loose_positions(views.documents(spark, d).withColumn("items", F.expr(LOOSE)))


@query("k2_loose_totals", f"""
select doc_id, cast(sum({ZERO.format(c='amount')}) as decimal(18,2)) as subtotal, cast(sum({ZERO.format(c='vat_amount')}) as decimal(18,2)) as vat_total,
  cast(sum({ZERO.format(c=OWN_TOTAL)}) as decimal(18,2)) as grand_total from k_items group by doc_id""", ("k_items",))
def _(spark, d):
    return ex.loose_totals(views.documents(spark, d).withColumn("items", F.expr(LOOSE)))


@query("k2_export_totals", f"""
select doc_id, cast(sum({ZERO.format(c='amount')}) as decimal(18,2)) as subtotal, cast(sum({ZERO.format(c='vat_amount')}) as decimal(18,2)) as vat_total,
  cast(sum({ZERO.format(c=LINE_TOTAL)}) as decimal(18,2)) as grand_total from k_items group by doc_id""", ("k_items",))
def _(spark, d):
    return ex.export_totals(views.documents(spark, d)).drop("in_words")


@query("k4_amount_in_words")
def _(spark, d):
    return ex.export_totals(views.documents(spark, d)).select("doc_id", "grand_total", "in_words")


RU_DATE = "concat('«', cast(day({c}) as varchar), '» ', [" + ", ".join(f"'{m}'" for m in fv.MONTHS_GENITIVE) + "][month({c})], ' ', cast(year({c}) as varchar), ' г.')"
DETAILS = "concat_ws('    ', case when {p}_inn is not null then concat('ИНН ', {p}_inn) end, case when {p}_kpp is not null then concat('КПП ', {p}_kpp) end)"


@query("k3_export_header", f"""
select d.doc_id, concat('{fv.EXPORT_DEFAULT_TYPE} № ', number, ' от ', {RU_DATE.format(c='doc_date')}) as title, supplier_name, {DETAILS.format(p='supplier')} as supplier_details,
  buyer_name, {DETAILS.format(p='buyer')} as buyer_details, cast(n_lines as int) as n_lines, coalesce(m.k, 0) as n_corrected, coalesce(t.ok, true) as all_passed
from fx_docs d left join (select extraction_id, count(*) as k from g_map group by 1) m on m.extraction_id = d.doc_id
  left join (select extraction_id, bool_and(status in ('resolved', 'rejected')) as ok from g_tasks group by 1) t on t.extraction_id = d.doc_id where d.status = 'completed'""",
       ("fx_docs", "g_map", "g_tasks"))
def _(spark, d):
    checks = tasks(spark, d).withColumnRenamed("extraction_id", "doc_id")
    fixed = r.correction_map(tasks(spark, d)).withColumnRenamed("extraction_id", "doc_id")
    return ex.export_header(views.documents(spark, d), checks, fixed)


@query("k5_russian_date", f"""
select o_orderkey, case o_orderkey % 3 when 0 then {RU_DATE.format(c='o_orderdate')} when 1 then 'вчера' else '' end as written from orders""")
def _(spark, d):
    text = "case o_orderkey % 3 when 0 then concat(cast(cast(o_orderdate as date) as string), 'T10:00:00') when 1 then 'вчера' end"
    return table(spark, d, "orders").select("o_orderkey", russian_date(F.expr(text)).alias("written"))


@query("k6_export_review_log", f"""
select doc_id, label as field, coalesce(original_value, '') as model_value, coalesce(value, '') as final_value, confidence,
  case when corrected then '{fv.CHANGED_LABEL}' else '{fv.UNCHANGED_LABEL}' end as state, path from g_diff""", ("g_diff",))
def _(spark, d):
    return ex.export_review_log(r.field_diff(nested(spark, d), r.correction_map(tasks(spark, d))))


EXPORT_LABEL = "case path " + " ".join(f"when '{k}' then '{t}'" for k, t in fv.EXPORT_FIELD_LABELS.items()) + " end"
view("k_checks", ("b_tasks",), f"""
select distinct doc_id, {bq.TITLE} as rule, status in ('resolved', 'rejected') as passed,
  trim(concat(field_path, ': ', coalesce(reason, '')), ': ') as message from (select cast(floor(extraction_id / 10) as bigint) as doc_id, * from b_tasks)""")


@query("k7_export_guardrail_log", f"""
select doc_id, coalesce({EXPORT_LABEL}, nullif(rule, ''), path) as "check", case when passed then '{fv.PASSED_LABEL}' else '{fv.ATTENTION_LABEL}' end as outcome,
  case when contains(message, ':') then trim(substr(message, strpos(message, ':') + 1)) else message end as explanation, path from (
  select *, case when rule like '/%' then rule when split_part(message, ':', 1) like '/%' then split_part(message, ':', 1) else '' end as path from k_checks)""", ("k_checks",))
def _(spark, d):
    return ex.export_guardrail_log(bq.tasks(spark, d).withColumn("doc_id", F.expr("extraction_id div 10")))
