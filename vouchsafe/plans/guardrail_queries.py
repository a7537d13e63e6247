"""Consistency rules, review tasks and routing over the derived documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.numbers import rounding_tolerance
from vouchsafe.operators import guardrails as g
from vouchsafe.plans import views
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table

S = views.SETTINGS
COLUMNS = ["doc_id", "rule", "field_path", "message", "expected", "actual", "blocking"]

TOL = "cast(cast(floor((greatest({n}, 1) + 1) / 2) as decimal(16,0)) * cast(0.01 as decimal(3,2)) as decimal(18,2))"
RATE = "case when vat_rate = 'without_vat' then cast(0 as decimal(5,2)) else try_cast(vat_rate as decimal(5,2)) end"


def _row(rule: str, path: str, message: str, expected: str, actual: str) -> str:
    blocking = "true" if rule in fv.BLOCKING_RULES else "false"
    return (
        f"doc_id, '{rule}' as rule, {path} as field_path, {message} as message, "
        f"cast({expected} as varchar) as expected, cast({actual} as varchar) as actual, {blocking} as blocking"
    )


view("v_total_in", ("fx_docs", "fx_items"), """
select d.doc_id, d.total_amount, d.vat_amount, count(*) as n, sum(case when i.amount is null then 1 else 0 end) as n_null,
  sum(i.amount) as s from fx_docs d join fx_items i on d.doc_id = i.doc_id group by d.doc_id, d.total_amount, d.vat_amount""")
view("v_total", ("v_total_in",), f"""
select {_row('total_mismatch', "'/total_amount'", f"concat('{fv.MESSAGE_TOTAL}', cast({TOL.format(n='n + 2')} as varchar))",
             'cast(s + vat_amount as decimal(28,2))', 'total_amount')}
from v_total_in where n_null = 0 and vat_amount is not null
  and abs(total_amount - (s + vat_amount)) > {TOL.format(n='n + 2')}""")
view("v_rated", ("fx_items",), f"""
select *, {RATE} as rate, coalesce({RATE} in (0, 10, 20), false) as legal,
  cast(round_even(amount * {RATE} * cast(0.01 as decimal(3,2)), 2) as decimal(18,2)) as line_vat from fx_items""")
view("v_rate", ("v_rated",), f"""
select {_row('vat_rate_mismatch', "concat('/line_items/', cast(idx as varchar), '/vat_rate')", f"'{fv.MESSAGE_RATE}'",
             f"'{fv.EXPECTED_RATES}'", 'vat_rate')} from v_rated where vat_rate is not null and not legal""")
view("v_line", ("v_rated",), f"""
select {_row('vat_rate_mismatch', "concat('/line_items/', cast(idx as varchar), '/vat_amount')", f"'{fv.MESSAGE_LINE_VAT}'",
             'line_vat', 'vat_amount')} from v_rated
where legal and amount is not null and vat_amount is not null and abs(vat_amount - line_vat) > cast(0.01 as decimal(3,2))""")
view("v_vat_in", ("v_rated", "fx_docs"), """
select d.doc_id, d.vat_amount, count(*) as n, cast(sum(r.vat_amount) as decimal(28,2)) as s
from fx_docs d join v_rated r on d.doc_id = r.doc_id
where r.legal and r.amount is not null and r.vat_amount is not null and d.vat_amount is not null
group by d.doc_id, d.vat_amount""")
view("v_vat", ("v_vat_in",), f"""
select {_row('vat_rate_mismatch', "'/vat_amount'", f"'{fv.MESSAGE_DOCUMENT_VAT}'", 's', 'vat_amount')}
from v_vat_in where abs(vat_amount - s) > {TOL.format(n='n + 1')}""")


def _weighted(col: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * cast(substr({col}, {i}, 1) as int)" for i, w in enumerate(weights, 1)) + ") % 11 % 10"


def inn_ok(col: str) -> str:
    ten = f"{_weighted(col, fv.INN10_WEIGHTS)} = cast(substr({col}, 10, 1) as int)"
    twelve = (f"{_weighted(col, fv.INN12_FIRST_WEIGHTS)} = cast(substr({col}, 11, 1) as int) and "
              f"{_weighted(col, fv.INN12_SECOND_WEIGHTS)} = cast(substr({col}, 12, 1) as int)")
    return (f"case when regexp_full_match({col}, '[0-9]{{10}}') then {ten} "
            f"when regexp_full_match({col}, '[0-9]{{12}}') then {twelve} when {col} is not null then false end")


view("v_inn", ("fx_docs",), " union all ".join(
    f"select {_row('invalid_inn', repr('/' + p + '/inn'), repr(fv.MESSAGE_INN), 'null', p + '_inn')} "
    f"from fx_docs where not ({inn_ok(p + '_inn')})" for p in ("supplier", "buyer")))
KEY = "trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '\\s+', ' ', 'g'))"
view("v_parties", ("fx_docs",), f"""
select {_row('same_parties', "'/buyer'", f"'{fv.MESSAGE_PARTIES}'", f"'{fv.EXPECTED_PARTIES}'",
             f"case when coalesce(supplier_inn = buyer_inn, false) then '{fv.SAME_INN}' else '{fv.SAME_NAME}' end")}
from fx_docs where coalesce(supplier_inn = buyer_inn, false)
  or coalesce({KEY.format(c='supplier_name')} = {KEY.format(c='buyer_name')}, false)""")
FIRST = "(date '2001-06-01' - 1825)"
LAST = "(date '2001-06-01' + 1)"
view("v_date", ("fx_docs",), f"""
select {_row('document_date_out_of_range', "'/date'", f"'{fv.MESSAGE_DATE}'",
             f"concat(cast(cast({FIRST} as date) as varchar), '..', cast(cast({LAST} as date) as varchar))", 'doc_date')}
from fx_docs where doc_date < {FIRST} or doc_date > {LAST}""")
view("v_confidence", ("fx_fields",), f"""
select {_row('low_confidence', 'path', f"'{fv.MESSAGE_CONFIDENCE}0.80'", "'0.8'", 'confidence')}
from fx_fields where value is not null and confidence < 0.8""")
ALL_RULES = ("v_total", "v_rate", "v_line", "v_vat", "v_inn", "v_parties", "v_date", "v_confidence")
view("v_all", ALL_RULES, " union all ".join(f"select * from {v}" for v in ALL_RULES))
view("v_summary", ("v_all", "fx_docs"), """
select d.doc_id, coalesce(n, 0) as n_violations, coalesce(n, 0) > 0 as requires_review,
  coalesce(n, 0) > 0 and not coalesce(blocked, false) as has_warnings
from fx_docs d left join (select doc_id, count(*) as n, bool_or(blocking) as blocked from v_all group by doc_id) v
  on v.doc_id = d.doc_id""")
view("v_tasks", ("v_all",), """
select doc_id, substr(field_path, 1, 512) as field_path, substr(message, 1, 1000) as reason, 'pending' as status,
  actual as original_value from v_all""")


@query("e1_rounding_tolerance", f"""
select l_orderkey as doc_id, count(*) as n, {TOL.format(n='count(*)')} as tolerance from lineitem group by l_orderkey""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    return lines.select("doc_id", "n", rounding_tolerance(F.col("n")).alias("tolerance"))


def _single(name: str, rule, source: str) -> None:
    @query(name, f"select * from {source}", (source,))
    def _(spark, d):
        return g.violations_of(views.documents(spark, d), rule, S).select(*COLUMNS)


_single("e2_guard_total", g.total_rule, "v_total")
_single("e3_guard_vat_rate", g.vat_rate_rule, "v_rate")
_single("e4_guard_vat_line", g.vat_line_rule, "v_line")
_single("e5_guard_vat_total", g.vat_total_rule, "v_vat")
_single("e6_guard_inn", g.inn_rule, "v_inn")
_single("e7_guard_parties", g.parties_rule, "v_parties")
_single("e8_guard_date", g.date_rule, "v_date")
_single("e9_guard_confidence", g.confidence_rule, "v_confidence")


@query("e10_mark_blocking", "select rule, blocking, count(*) as n from v_all group by rule, blocking", ("v_all",))
def _(spark, d):
    found = g.evaluate_guardrails(views.documents(spark, d), S).drop("blocking")
    return g.mark_blocking(found).groupBy("rule", "blocking").agg(F.count("*").alias("n"))


@query("e11_evaluate_guardrails", "select * from v_all", ("v_all",))
def _(spark, d):
    return g.evaluate_guardrails(views.documents(spark, d), S).select(*COLUMNS)


@query("e11_guardrail_summary", "select * from v_summary", ("v_summary",))
def _(spark, d):
    return g.guardrail_summary(views.documents(spark, d), S)


@query("e12_review_tasks", "select * from v_tasks", ("v_tasks",))
def _(spark, d):
    return g.make_review_tasks(g.evaluate_guardrails(views.documents(spark, d), S), path_width=512, reason_width=1000)


@query("e13_route_documents", """
select d.doc_id, d.document_type as detected_type, case when s.requires_review then 'review_required' else 'completed' end as status
from fx_docs d join v_summary s on s.doc_id = d.doc_id""", ("v_summary", "fx_docs"))
def _(spark, d):
    return g.route_documents(views.documents(spark, d), S)
