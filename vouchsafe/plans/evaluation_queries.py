"""Evaluation, run reports and comparisons over derived expected/actual documents and event samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions import compare as cmp
from vouchsafe.functions.identifiers import sample_key
from vouchsafe.functions.numbers import delta
from vouchsafe.functions.text import normalize_name
from vouchsafe.operators import comparison as c
from vouchsafe.operators import dashboard as db
from vouchsafe.operators import evaluation as e
from vouchsafe.operators.rows import once, rows_of
from vouchsafe.plans import views
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table
from vouchsafe.session import ensure_checkpoint_dir
from vouchsafe.sources import reports

# --- names and values ---------------------------------------------------------------
NAME = "trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


@query("j1_normalize_name", f"select p_partkey, {NAME.format(c=chr(39) + '«Ёлка-' + chr(39) + ' || p_name || p_brand')} as name from part")
def _(spark, d):
    text = F.concat(F.lit("«Ёлка-"), F.col("p_name"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", normalize_name(text).alias("name"))


@query("j2_name_similarity")
def _(spark, d):
    parts = table(spark, d, "part")
    return parts.select("p_partkey", cmp.name_similarity(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("ratio"))


@query("j3_decimal_equal", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(try_cast(a as decimal(38,10)) = try_cast(b as decimal(38,10)), false) as equal from (
  select *, case when l_partkey % 5 = 0 then 'without_vat' else concat(cast(l_linenumber as varchar), '.50') end as a,
    case when l_partkey % 5 = 0 then 'without_vat' when l_partkey % 5 = 1 then concat(cast(l_linenumber as varchar), '.5') else cast(l_linenumber as varchar) end as b
  from lineitem)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", """
      case when l_partkey % 5 = 0 then 'without_vat' else concat(cast(l_linenumber as string), '.50') end as a""", """
      case when l_partkey % 5 = 0 then 'without_vat' when l_partkey % 5 = 1 then concat(cast(l_linenumber as string), '.5') else cast(l_linenumber as string) end as b""")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cmp.decimal_equal(F.col("a"), F.col("b")).alias("equal"))


@query("j4_date_equal", """
select o_orderkey, o_orderkey % 3 = 0 as equal from orders""")
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as a", """
      case o_orderkey % 3 when 0 then cast(cast(o_orderdate as date) as string) when 1 then 'soon'
        else cast(date_add(cast(o_orderdate as date), 1) as string) end as b""")
    return rows.select("o_orderkey", cmp.date_equal(F.col("a"), F.col("b")).alias("equal"))


# --- expected and actual documents -----------------------------------------------------
def expected(spark, d) -> DataFrame:
    return e.bare_form(views.bare_documents(spark, d).withColumnRenamed("doc_id", "sample_id"), wrapped=False)


EDITED = {
    "number": "case when sample_id % 7 = 1 then concat(number, 'x') else number end",
    "buyer_kpp": "case when sample_id % 7 = 3 then null else buyer_kpp end",
    "currency": "case when sample_id % 7 = 2 then null else currency end",
    "vat_amount": "case when sample_id % 7 = 4 then coalesce(vat_amount, '1.00') else vat_amount end",
    "date": "case when sample_id % 7 = 5 then '2001-02-30' else date end",
    "total_amount": "case when sample_id % 7 = 6 then concat(total_amount, '000') else total_amount end",
}
# drop the first line, change or rename it, add a line, reverse the order, or leave all as it is
EDITED_LINES = """case sample_id % 7 when 0 then slice(lines, 2, size(lines))
  when 1 then transform(lines, (x, i) -> case when i = 0 then named_struct('name', x.name, 'quantity', x.quantity, 'unit', x.unit,
    'unit_price', x.unit_price, 'amount', '1.11', 'vat_rate', x.vat_rate, 'vat_amount', x.vat_amount) else x end)
  when 4 then concat(lines, array(named_struct('name', 'неожиданная позиция', 'quantity', '1', 'unit', null, 'unit_price', null,
    'amount', null, 'vat_rate', null, 'vat_amount', null)))
  when 5 then reverse(lines) else lines end"""


def actual(spark, d) -> DataFrame:
    rows = expected(spark, d)
    return rows.selectExpr(*[
        f"{EDITED[n]} as {n}" if n in EDITED else f"{EDITED_LINES} as lines" if n == "lines" else n for n in rows.columns])


def _outcome(exp: str, act: str, equal: str) -> str:
    return (f"case when {exp} is null and {act} is null then 'none' when {act} is null then 'miss' when {exp} is null then 'hallucination' "
            f"when {equal} then 'match' else 'mismatch' end")


def _scalar_outcomes() -> str:
    flat = {**{p: views.FLAT_OF[p] for p in fv.EVAL_SCALARS}}
    parts = []
    for path in fv.EVAL_SCALARS:
        exp, key = f"cast({flat[path]} as varchar)", path.replace(".", "_")
        act = EDITED.get(key, key).replace("sample_id", "doc_id")
        act = f"({act.replace(key, exp)})"
        if path in fv.DECIMAL_PATHS:
            equal = f"coalesce(try_cast({exp} as decimal(38,10)) = try_cast({act} as decimal(38,10)), false)"
        elif path in fv.DATE_PATHS:
            equal = f"coalesce(try_cast({exp} as date) = try_cast({act} as date), false)"
        else:
            equal = f"{exp} = {act}"
        parts.append(f"select doc_id as sample_id, '{path}' as field, {_outcome(exp, act, equal)} as outcome from fx_docs")
    return " union all ".join(parts)


view("x_scalars", ("fx_docs",), _scalar_outcomes())


@query("j5_compare_field", f"""
select doc_id, path, case when value is null then false when path like '%/name' then {NAME.format(c='value')} <> ''
  when path like '%/vat_rate' then value <> 'without_vat' else true end as equal
from fx_fields""", ("fx_fields",))
def _(spark, d):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^/line_items/[0-9]+/", "line_items[]."), "^/", ""), "/", ".")
    other = F.when(F.col("path").rlike("(quantity|unit_price|amount)$"), F.concat("value", F.lit("0"))).otherwise(F.col("value"))
    rows = once(views.fields(spark, d).select("doc_id", "path", "value"), field=path, other=other)
    return rows.select("doc_id", "path", cmp.compare_field(F.col("field"), F.col("value"), F.col("other")).alias("equal"))


@query("j6_field_outcomes", "select * from x_scalars", ("x_scalars",))
def _(spark, d):
    return e.field_outcomes(expected(spark, d), actual(spark, d))


GIVEN_PAIRS = """transform(
      filter(sequence(0, size(e.lines)), i -> i < size(e.lines) and not (sample_id % 7 = 0 and i = 0)),
      i -> named_struct('e', i, 'a', cast(case sample_id % 7 when 0 then i - 1 when 5 then size(e.lines) - 1 - i else i end as int),
        'score', 1.0D, 'name_ratio', case when get(e.lines, i).name is not null then 1.0D end))"""


@query("j7_line_similarity", "select sample_id, idx, cast(round(score, 6) as decimal(18,6)) as score from x_pairs", ("x_pairs",))
def _(spark, d):
    # the seeded edits say which lines belong together
    pairs = e.pair_samples(expected(spark, d), actual(spark, d)).withColumn("given", F.expr(GIVEN_PAIRS))
    lines = rows_of(pairs.select("sample_id", F.expr("transform(given, p -> named_struct('idx', p.e, 'le', get(e.lines, p.e), 'la', get(a.lines, p.a)))").alias("g")), ["sample_id"], "g")
    return lines.select("sample_id", "idx", F.round(e.line_similarity(F.col("le"), F.col("la")), 6).cast("decimal(18,6)").alias("score"))


@query("j8_match_lines")
def _(spark, d):
    return e.matched_pairs(e.match_lines(e.pair_samples(expected(spark, d), actual(spark, d))))


#: A line's score against an equal one, and with an amount that no longer agrees.
WEIGHT = " + ".join(f"case when {n} is not null then {w}::double else 0 end" for n, w in fv.LINE_WEIGHTS.items())
EQUAL = " + ".join(
    f"case when {f'{n} is not null' if n in ('name', 'unit') else f'try_cast({n} as decimal(38,10)) is not null'} then {w}::double else 0 end"
    for n, w in fv.LINE_WEIGHTS.items())
view("x_pairs", ("fx_items",), f"""
select doc_id as sample_id, idx, case when weight > 0 then (same - case when doc_id % 7 = 1 and idx = 0 and try_cast(amount as decimal(38,10)) is not null and try_cast(amount as decimal(38,10)) <> 1.11 then 0.2::double else 0 end) / weight else 0 end as score
from (select *, {WEIGHT} as weight, {EQUAL} as same from fx_items) where not (doc_id % 7 = 0 and idx = 0)""")


@query("j8_match_totals", f"""
select sample_id, count(*) as n_pairs, cast(round(sum(score), 6) as decimal(18,6)) as total from x_pairs where score >= {e.LINE_THRESHOLD} - 1e-9 group by 1""", ("x_pairs",))
def _(spark, d):
    pairs = e.matched_pairs(e.match_lines(e.pair_samples(expected(spark, d), actual(spark, d))))
    return pairs.groupBy("sample_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 6).cast("decimal(18,6)").alias("total"))


def _line_outcomes() -> str:
    parts = []
    for name in fv.EVAL_LINE_FIELDS:
        same = {"name": "name is not null and trim(name) <> ''", "vat_rate": "try_cast(vat_rate as decimal(38,10)) is not null",
                "unit": "true"}.get(name, "true")
        act = "case when doc_id % 7 = 1 and idx = 0 then '1.11' else cast(amount as varchar) end" if name == "amount" else f"cast({name} as varchar)"
        equal = f"try_cast(cast({name} as varchar) as decimal(38,10)) = try_cast({act} as decimal(38,10))" if name == "amount" else same
        field = f"'line_items[].{name}'"
        parts.append(f"""select doc_id as sample_id, {field} as field, case when doc_id % 7 = 0 and idx = 0 then
            case when {name} is null then 'none' else 'miss' end else {_outcome(f"cast({name} as varchar)", act, f"coalesce({equal}, false)")} end as outcome from fx_items""")
        extra = "'hallucination'" if name in ("name", "quantity") else "'none'"
        parts.append(f"select doc_id, {field}, {extra} from fx_docs where doc_id % 7 = 4")
    return " union all ".join(parts)


view("x_lines", ("fx_items", "fx_docs"), _line_outcomes())


def _all_outcomes() -> str:
    """Outcomes of whole documents: pairs below the threshold are a lost and an invented line."""
    below = f"(select sample_id from x_pairs where score < {e.LINE_THRESHOLD} - 1e-9)"
    low = f"exists (select 1 from x_pairs p where p.sample_id = i.doc_id and p.idx = i.idx and p.score < {e.LINE_THRESHOLD} - 1e-9)"
    parts = ["select * from x_scalars", f"select * from x_lines where sample_id not in {below}"]
    for name in fv.EVAL_LINE_FIELDS:
        field = f"'line_items[].{name}'"
        act = "'1.11'" if name == "amount" else f"cast({name} as varchar)"
        exp = f"cast({name} as varchar)"
        equal = {"amount": f"try_cast({exp} as decimal(38,10)) = 1.11", "name": "trim(name) <> ''", "vat_rate": "try_cast(vat_rate as decimal(38,10)) is not null"}.get(name, "true")
        changed = f"case when idx = 0 then {_outcome(exp, act, f'coalesce({equal}, false)')} else {_outcome(exp, exp, 'true' if name == 'amount' else f'coalesce({equal}, false)')} end"
        mine = f"doc_id % 7 = 1 and doc_id in {below}"
        parts += [
            f"select doc_id, {field}, {changed} from fx_items i where {mine} and not {low}",
            f"select doc_id, {field}, case when {name} is null then 'none' else 'miss' end from fx_items i where {mine} and {low}",
            f"select doc_id, {field}, case when {act} is null then 'none' else 'hallucination' end from fx_items i where {mine} and {low}",
        ]
    return " union all ".join(parts)


view("x_outcomes", ("x_scalars", "x_lines", "x_pairs", "fx_items"), _all_outcomes())


@query("j9_line_outcomes", "select sample_id, field, outcome, count(*) as n from x_lines group by all", ("x_lines",))
def _(spark, d):
    pairs = e.pair_samples(expected(spark, d), actual(spark, d))
    # pairs are given: the seeded edits say which lines belong together
    given = pairs.withColumn("matched", F.expr(GIVEN_PAIRS))
    return rows_of(e.line_outcomes(given), ["sample_id"], "line_fields").groupBy("sample_id", "field", "outcome").agg(F.count("*").alias("n"))


@query("j10_evaluate_documents", """
select sample_id, field, count(*) filter (outcome = 'match') as matches, count(*) filter (outcome = 'miss') as misses,
  count(*) filter (outcome = 'hallucination') as hallucinations, count(*) filter (outcome = 'mismatch') as mismatches
from x_outcomes group by all""", ("x_outcomes",))
def _(spark, d):
    return e.evaluate_documents(expected(spark, d), actual(spark, d))


@query("j10_scalar_counts", """
select sample_id, field, count(*) filter (outcome = 'match') as matches, count(*) filter (outcome = 'miss') as misses,
  count(*) filter (outcome = 'hallucination') as hallucinations, count(*) filter (outcome = 'mismatch') as mismatches
from x_scalars group by all""", ("x_scalars",))
def _(spark, d):
    return e.evaluate_documents(expected(spark, d), actual(spark, d), lines=False)


@query("j11_merge_metrics", """
select field, count(*) filter (outcome = 'match') as matches, count(*) filter (outcome = 'miss') as misses,
  count(*) filter (outcome = 'hallucination') as hallucinations, count(*) filter (outcome = 'mismatch') as mismatches
from x_scalars group by field""", ("x_scalars",))
def _(spark, d):
    outcomes = e.field_outcomes(expected(spark, d), actual(spark, d))
    return e.merge_metrics(e.count_outcomes(outcomes, "sample_id", "field"), "field")


# --- runs ----------------------------------------------------------------------------
FIELD_OF = "case event_id % 6 when 0 then 'number' when 1 then 'date' when 2 then 'supplier.name' when 3 then 'total_amount' when 4 then 'line_items[].name' else 'currency' end"
SAMPLES = f"""
select cast(cast(ts as date) as string) as run_id, event_id as sample_id, {FIELD_OF} as field,
  case when event_type = 'error' then 'failed' else 'succeeded' end as status,
  cast(value as decimal(18,6)) as duration_seconds, event_type <> 'view' as called,
  case when event_id % 3001 = 0 then null else event_id % 500 end as input_tokens, event_id % 90 as output_tokens,
  case when event_id % 2003 = 0 then null when user_id % 2 = 0 then cast(0 as decimal(32,12)) else cast((event_id % 40) * cast(0.0001 as decimal(5,4)) as decimal(32,12)) end as cost_usd,
  case when event_type = 'error' then 'Timeout' end as error_type, case when event_type = 'error' then concat('after ', props) end as error_message,
  case when user_id % 4 < 3 then 1 else 0 end as m1, case when user_id % 4 = 3 and event_id % 2 = 0 then 1 else 0 end as m2,
  case when user_id % 4 = 3 and event_id % 3 = 0 then 1 else 0 end as m3, case when user_id % 5 = 0 then 1 else 0 end as m4
from {{events}}"""
METRICS = """
select run_id, field, sum(cast(m1 as bigint)) as matches, sum(cast(m2 as bigint)) as misses, sum(cast(m3 as bigint)) as hallucinations,
  sum(cast(m4 as bigint)) as mismatches from {samples}
where not (run_id in ('2024-01-02', '2024-01-09') and field = 'currency') group by run_id, field"""
HEADERS = """
select run_id, 'accounting' as dataset_name, case when run_id < '2024-01-25' then 'v1' else 'v2' end as dataset_version, '1' as schema_version,
  case day(cast(run_id as date)) % 3 when 0 then 'cheap_only' when 1 then 'expensive_only' else 'cascade' end as strategy, 'qwen' as model,
  cast(cast(run_id as date) as timestamp) as started_at, case when day(cast(run_id as date)) % 6 = 5 then 'run broke' end as error_message from {runs}"""
view("samples", (), SAMPLES.replace("{events}", "events"))
view("metrics", ("samples",), METRICS.replace("{samples}", "samples"))
view("headers", ("samples",), HEADERS.replace("{runs}", "(select distinct run_id from samples)"))
_KNOWN = "case when called then {c} else 0 end"
view("reports", ("samples",), f"""
select run_id, count(*) as sample_count, count(*) filter (status = 'succeeded') as succeeded_count, count(*) filter (status = 'failed') as failed_count,
  case when count({_KNOWN.format(c='input_tokens')}) = count(*) then sum({_KNOWN.format(c='input_tokens')}) end as input_tokens,
  case when count({_KNOWN.format(c='output_tokens')}) = count(*) then sum({_KNOWN.format(c='output_tokens')}) end as output_tokens,
  cast(case when count({_KNOWN.format(c='cost_usd')}) = count(*) then sum({_KNOWN.format(c='cost_usd')}) end as decimal(32,12)) as cost_usd,
  cast(sum(duration_seconds) as decimal(28,6)) as total_duration_seconds,
  cast(sum(duration_seconds) as double) / count(*) as average_duration_seconds from samples group by run_id""")
R = "cast({p} as double) / nullif({w}, 0)"
view("ratios", ("metrics",), f"""
select *, {R.format(p='matches', w='(matches + misses + mismatches)')} as accuracy,
  {R.format(p='matches', w='(matches + hallucinations + mismatches)')} as "precision",
  {R.format(p='matches', w='(matches + misses + mismatches)')} as recall from metrics""")
view("scores", ("ratios",), """select *, case when "precision" + recall > 0 then "precision" * 2 * recall / ("precision" + recall) end as f1 from ratios""")
view("micro", ("metrics",), "select run_id, cast(sum(matches) as double) / nullif(sum(matches + misses + mismatches), 0) as micro_accuracy from metrics group by run_id")
view("macro", ("ratios",), "select run_id, avg(accuracy) as macro_accuracy from ratios group by run_id")
view("full_runs", ("headers", "reports", "micro"), """
select h.*, r.* exclude (run_id), m.micro_accuracy as accuracy from headers h join reports r on r.run_id = h.run_id left join micro m on m.run_id = h.run_id""")


def samples(spark, d) -> DataFrame:
    return spark.sql(SAMPLES, events=table(spark, d, "events"))


def metrics(spark, d) -> DataFrame:
    return spark.sql(METRICS, samples=samples(spark, d))


def headers(spark, d) -> DataFrame:
    text = HEADERS.replace("as timestamp)", "as timestamp_ntz)")
    return spark.sql(text, runs=samples(spark, d).select("run_id").distinct())


def full_runs(spark, d) -> DataFrame:
    accuracy = e.micro_accuracy(metrics(spark, d), "run_id").withColumnRenamed("micro_accuracy", "accuracy")
    return headers(spark, d).join(e.run_report(samples(spark, d)), "run_id").join(accuracy, "run_id", "left")


@query("j12_field_ratios", "select * from ratios", ("ratios",))
def _(spark, d):
    return e.field_ratios(metrics(spark, d))


@query("j13_field_f1", "select * from scores", ("scores",))
def _(spark, d):
    return e.field_f1(metrics(spark, d))


@query("j14_micro_accuracy", "select * from micro", ("micro",))
def _(spark, d):
    return e.micro_accuracy(metrics(spark, d), "run_id")


@query("j15_macro_accuracy", "select * from macro", ("macro",))
def _(spark, d):
    return e.macro_accuracy(metrics(spark, d), "run_id")


@query("j16_run_report", """
select r.*, coalesce(s.steps, '') as step_durations from reports r left join (
  select run_id, string_agg(concat(step, '=', cast(seconds as varchar)), ';' order by first_started_at, step) as steps from run_steps group by run_id) s using (run_id)""",
       ("reports", "run_steps"))
def _(spark, d):
    from vouchsafe.operators import model_calls as m
    from vouchsafe.plans.model_queries import steps
    report = e.run_report(samples(spark, d), steps=m.merge_step_durations(steps(spark, d)))
    listed = F.transform(F.map_entries("step_duration_totals"), lambda s: F.concat(s["key"], F.lit("="), s["value"].cast("string")))
    return report.withColumn("step_durations", F.array_join(listed, ";")).drop("step_duration_totals")


@query("j17_sample_results", """
select run_id, sample_id, status, duration_seconds, input_tokens, output_tokens, cost_usd, error_type, error_message,
  cast(m1 as double) / nullif(m1 + m2 + m4, 0) as accuracy from samples""", ("samples",))
def _(spark, d):
    rows = samples(spark, d)
    mine = rows.selectExpr("run_id", "sample_id", "m1 as matches", "m2 as misses", "m3 as hallucinations", "m4 as mismatches")
    return e.sample_results(rows, mine)


RUN_A, RUN_B = "2024-01-02", "2024-01-08"
REPORTED = (
    "run_id", "cast(sample_id as string) as sample_id", "status", "duration_seconds", "cast(input_tokens as bigint) as input_tokens",
    "cast(output_tokens as bigint) as output_tokens", "cost_usd",
)
REPORT_SQL = "select '3' as report_version, run_id, cast(sample_id as varchar) as sample_id, {status} as status, duration_seconds, input_tokens, output_tokens, cost_usd, 0 as n_steps{more} from samples"


def _stored(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a8_report_round_trip", REPORT_SQL.format(status=f"case when run_id = '{RUN_A}' then 'failed' else status end", more=""), ("samples",))
def _(spark, d):
    """Runs are stored, one of them again with another outcome, and read back."""
    path, rows = _stored(spark, "report"), samples(spark, d).selectExpr(*REPORTED)
    reports.write_report(rows, path)
    reports.write_report(rows.where(F.col("run_id") == RUN_A).withColumn("status", F.lit("failed")), path)
    return reports.load_report(spark, path).select(
        "report_version", "run_id", "sample_id", "status", "duration_seconds", "input_tokens", "output_tokens", "cost_usd",
        F.size("step_durations").alias("n_steps"))


@query("a8_one_run", REPORT_SQL.format(status="status", more="") + f" where run_id = '{RUN_B}'", ("samples",))
def _(spark, d):
    path = _stored(spark, "report")
    reports.write_report(samples(spark, d).selectExpr(*REPORTED), path)
    return reports.load_report(spark, path, RUN_B).select(
        "report_version", "run_id", "sample_id", "status", "duration_seconds", "input_tokens", "output_tokens", "cost_usd",
        F.size("step_durations").alias("n_steps"))


@query("a9_strategy_report", REPORT_SQL.format(status="status", more=", 'cascade' as strategy"), ("samples",))
def _(spark, d):
    """Two strategies are stored side by side, one is read back."""
    path, rows = _stored(spark, "strategies"), samples(spark, d).selectExpr(*REPORTED)
    reports.write_strategy_report(rows, "cascade", path)
    reports.write_strategy_report(rows.withColumn("status", F.lit("failed")), "cheap_only", path)
    return reports.load_strategy_report(spark, path, "cascade").select(
        "report_version", "run_id", "sample_id", "status", "duration_seconds", "input_tokens", "output_tokens", "cost_usd",
        F.size("step_durations").alias("n_steps"), "strategy")


@query("a10_exported_texts", "select doc_id, text, sha256(text) as digest from documents")
def _(spark, d):
    """Whole texts through delimited files and back, to the letter."""
    path = _stored(spark, "export")
    reports.write_exports({"texts": table(spark, d, "documents").select("doc_id", "text")}, path, fmt="csv")
    read = spark.read.schema("doc_id bigint, text string").option("header", "true").option("multiLine", "true").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("maxCharsPerColumn", "-1").option(
        "emptyValue", "").option("nullValue", "\u0000").option("lineSep", "\n").csv(f"{path}/texts")
    return read.select("doc_id", "text", F.sha2("text", 256).alias("digest"))


@query("j18_run_errors", """
select run_id, error_message as error from headers where error_message is not null
union all select run_id, trim(concat(cast(sample_id as varchar), ': ', error_type, ' ', error_message)) from samples where status = 'failed'""",
       ("headers", "samples"))
def _(spark, d):
    return e.run_errors(headers(spark, d), samples(spark, d))


@query("j19_sample_key", """
select doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)),
  concat(substr('89ab', 1 + cast(concat('0x', substr(h, 17, 1)) as int) % 4, 1), substr(h, 18, 3)), substr(h, 21, 12)) as sample_key
from (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('accounting:v1:', doc_id))) as h from documents)""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", sample_key(F.lit("accounting"), F.lit("v1"), F.col("doc_id").cast("string")).alias("sample_key"))


@query("j20_first_samples", "select sample_id, status from samples order by sample_id limit 50", ("samples",))
def _(spark, d):
    return e.first_samples(samples(spark, d), 50).select("sample_id", "status")


view("compared", ("ratios",), f"""
select field, case when ma is null or mb is null then 'mixed' when best is null then 'unchanged' when best > 0 and worst < 0 then 'mixed'
    when best > 0 then 'improved' else 'regressed' end as status, * exclude (field, best, worst, ma, mb) from (
  select *, greatest(case when abs(delta_accuracy) > 1e-12 then delta_accuracy end, case when abs(delta_precision) > 1e-12 then delta_precision end) as best,
    least(case when abs(delta_accuracy) > 1e-12 then delta_accuracy end, case when abs(delta_precision) > 1e-12 then delta_precision end) as worst from (
    select field, a.matches as ma, b.matches as mb, coalesce(b.matches, 0) - coalesce(a.matches, 0) as delta_matches, coalesce(b.misses, 0) - coalesce(a.misses, 0) as delta_misses,
      coalesce(b.hallucinations, 0) - coalesce(a.hallucinations, 0) as delta_hallucinations, coalesce(b.mismatches, 0) - coalesce(a.mismatches, 0) as delta_mismatches,
      a.accuracy as accuracy_a, b.accuracy as accuracy_b, b.accuracy - a.accuracy as delta_accuracy, a."precision" as precision_a, b."precision" as precision_b,
      b."precision" - a."precision" as delta_precision, a.recall as recall_a, b.recall as recall_b, b.recall - a.recall as delta_recall
    from (select * from ratios where run_id = '{RUN_A}') a full join (select * from ratios where run_id = '{RUN_B}') b using (field)))""")


@query("j21_compare_runs", "select * from compared", ("compared",))
def _(spark, d):
    return c.compare_runs(metrics(spark, d), headers(spark, d), RUN_A, RUN_B)


@query("j22_compare_runs_summary", f"""
select count(*) filter (d >= 0.01) as n_improved, count(*) filter (d <= -0.01) as n_degraded,
  (select cost_usd from full_runs where run_id = '{RUN_A}') as cost_a, (select total_duration_seconds from full_runs where run_id = '{RUN_A}') as duration_a,
  (select accuracy from full_runs where run_id = '{RUN_A}') as accuracy_a, (select cost_usd from full_runs where run_id = '{RUN_B}') as cost_b,
  (select total_duration_seconds from full_runs where run_id = '{RUN_B}') as duration_b, (select accuracy from full_runs where run_id = '{RUN_B}') as accuracy_b
from (select b.f1 - a.f1 as d from (select * from scores where run_id = '{RUN_A}') a full join (select * from scores where run_id = '{RUN_B}') b using (field))""",
       ("scores", "full_runs"))
def _(spark, d):
    runs = full_runs(spark, d).withColumnRenamed("total_duration_seconds", "duration_seconds")
    return c.compare_runs_summary(metrics(spark, d), runs, RUN_A, RUN_B)


@query("j22_moved_fields", f"""
select field, a.f1 as f1_a, b.f1 as f1_b, b.f1 - a.f1 as delta, case when b.f1 > a.f1 then 'improved' else 'degraded' end as direction
from (select * from scores where run_id = '{RUN_A}') a join (select * from scores where run_id = '{RUN_B}') b using (field) where abs(b.f1 - a.f1) >= 0.01""",
       ("scores",))
def _(spark, d):
    runs = full_runs(spark, d).withColumnRenamed("total_duration_seconds", "duration_seconds")
    return c.moved_fields(metrics(spark, d), runs, RUN_A, RUN_B)


PER_DOC = "cast(cast(cost_usd as double) / nullif(sample_count, 0) as decimal(20,9))"


@query("j23_compare_strategies", """
select run_id, strategy, model, macro_accuracy as average_accuracy, cheap_coverage, average_duration_seconds, cost_usd is not null as priced
from full_runs f left join macro m using (run_id) left join coverage v using (run_id) where dataset_version = 'v1'""", ("full_runs", "macro", "coverage"))
def _(spark, d):
    runs = full_runs(spark, d).where("dataset_version = 'v1'")
    rows = c.compare_strategies(runs, samples(spark, d), metrics(spark, d))
    return rows.select("run_id", "strategy", "model", "average_accuracy", "cheap_coverage", "average_duration_seconds",
                       F.col("average_cost_usd").isNotNull().alias("priced"))


view("coverage", ("headers", "samples"), """
select run_id, case h.strategy when 'cheap_only' then 1.0 when 'expensive_only' then 0.0 else coalesce(free / n, 0) end as cheap_coverage
from headers h left join (select run_id, cast(count(*) filter (cost_usd = 0) as double) as free, count(*) as n from samples where status = 'succeeded' group by run_id) using (run_id)""")


@query("j24_cheap_coverage", "select run_id, strategy, cheap_coverage from coverage join headers using (run_id)", ("coverage", "headers"))
def _(spark, d):
    return c.cheap_coverage(headers(spark, d), samples(spark, d))


@query("j25_weakest_fields", "select field, f1 from scores where run_id = '2024-01-05' order by f1 asc nulls first, field limit 3", ("scores",))
def _(spark, d):
    return e.weakest_fields(metrics(spark, d).where("run_id = '2024-01-05'"), 3).select("field", "f1")


@query("j26_run_verdict", """
select run_id, accuracy, case when accuracy is null then 'none' when accuracy >= 0.95 then 'stable' when accuracy >= 0.85 then 'workable' else 'weak' end as verdict
from full_runs""", ("full_runs",))
def _(spark, d):
    return e.run_verdict(full_runs(spark, d)).select("run_id", "accuracy", "verdict")


@query("j27_list_runs", "select run_id, strategy, (select count(*) from headers) as total from headers order by started_at desc, run_id limit 10 offset 10", ("headers",))
def _(spark, d):
    return e.list_runs(headers(spark, d), 2, 10).select("run_id", "strategy", "total")


@query("j27_get_runs", f"select run_id, strategy from headers where run_id in ('{RUN_A}', '{RUN_B}')", ("headers",))
def _(spark, d):
    return e.get_runs(headers(spark, d), [RUN_A, RUN_B]).select("run_id", "strategy")


# --- run series on the dashboard -------------------------------------------------------
@query("i6_run_series", """
select run_id, started_at, accuracy, total_duration_seconds as duration_seconds, cost_usd from full_runs order by started_at desc, run_id limit 20""", ("full_runs",))
def _(spark, d):
    return db.run_series(full_runs(spark, d).withColumnRenamed("total_duration_seconds", "duration_seconds"))


@query("i6_step_totals", """
select step, cast(sum(seconds) as decimal(18,6)) as seconds from run_steps where run_id in (select run_id from headers order by started_at desc, run_id limit 20) group by step""",
       ("run_steps", "headers"))
def _(spark, d):
    from vouchsafe.operators import model_calls as m
    from vouchsafe.plans.model_queries import steps
    totals = m.merge_step_durations(steps(spark, d)).withColumnRenamed("run_id", "doc_id")
    maps = m.step_maps(totals).selectExpr("doc_id as run_id", "step_durations as step_totals")
    return db.series_step_totals(headers(spark, d).join(maps, "run_id", "left"))


@query("i7_kpi_latest", """
with r as (select * from full_runs order by started_at desc, run_id limit 20),
 a as (select accuracy, row_number() over (order by started_at desc) as n from r where accuracy is not null),
 t as (select total_duration_seconds as s, row_number() over (order by started_at desc) as n from r where total_duration_seconds is not null)
select (select accuracy from a where n = 1) as accuracy_current, (select accuracy from a where n = 2) as accuracy_previous,
  (select s from t where n = 1) as duration_current, (select s from t where n = 2) as duration_previous, (select sum(cost_usd) from r) as cost_total""", ("full_runs",))
def _(spark, d):
    return db.kpi_latest(full_runs(spark, d).withColumnRenamed("total_duration_seconds", "duration_seconds"))


@query("i8_delta", """
select event_id, case when c is null or p is null or p = 0 then null else (c - p) / abs(p) end as diff,
  case when c is null or p is null or p = 0 then null else (c - p) / abs(p) end as ratio,
  case when c is null or p is null or p = 0 or abs((c - p) / abs(p)) < 1e-9 then 'neutral' when (c - p) / abs(p) < 0 then 'success' else 'danger' end as tone
from (select event_id, case when event_id % 10 = 0 then null else value end as c, case when event_id % 7 = 0 then 0 when event_id % 11 = 0 then value else -value + event_id % 5 end as p from events)""")
def _(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "case when event_id % 10 = 0 then null else value end as c",
        "case when event_id % 7 = 0 then 0D when event_id % 11 = 0 then value else -value + event_id % 5 end as p")
    return rows.select("event_id", delta(F.col("c"), F.col("p"), kind="relative", higher_is_better=False).alias("x")).select("event_id", "x.*")
