"""Model stage over attempts, calls and logs derived from events, documents and conversations."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.operators import model_calls as m
from vouchsafe.operators.rows import once
from vouchsafe.plans import views
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table
from vouchsafe.session import ensure_checkpoint_dir
from vouchsafe.sources.answers import StoredCache

PROMPT, MODEL = "v5", "qwen"

KEYED = """
select doc_id, concat('1:v5:qwen:', {SHA}) as key, {SHA} as content_hash, n_chars from {documents}"""
CACHED = """
select key, 'v5' as prompt_version, 'qwen' as model, content_hash, timestamp '2024-01-01 00:00:00' + interval '1' minute * (min(doc_id) % 500) as created_at,
  cast(2 as bigint) as hits, concat('{"n": ', cast(min(doc_id) as string), '}') as document
from {keyed} where doc_id % 3 = 0 group by key, content_hash"""
view("keyed", (), KEYED.replace("{SHA}", "sha256(text)").replace("{documents}", "documents"))
view("cached", ("keyed",), CACHED.replace("{keyed}", "keyed"))


def keyed(spark, d) -> DataFrame:
    return spark.sql(KEYED.replace("{SHA}", "sha2(text, 256)"), documents=table(spark, d, "documents"))


def cached(spark, d) -> DataFrame:
    return spark.sql(CACHED.replace('{"n": ', '{{"n": ').replace("'}')", "'}}')"), keyed=keyed(spark, d))


@query("d1_cache_key", "select doc_id, key, sha256(key) as key_digest from keyed", ("keyed",))
def _(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return m.with_cache_key(hashed, PROMPT, MODEL).select("doc_id", "key", "key_digest")


@query("d2_plan_calls", """
select k.doc_id, k.key, case when c.key is not null then 'hit' when k.doc_id = min(k.doc_id) over (partition by k.key) then 'call' else 'share' end as action
from keyed k left join cached c on c.key = k.key""", ("keyed", "cached"))
def _(spark, d):
    return m.plan_calls(keyed(spark, d), cached(spark, d))


def stored(spark, d) -> StoredCache:
    """The cache as a stored table: stale entries first, then the current ones, then compacted."""
    entries = cached(spark, d)
    store = StoredCache(f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}", entries.schema, buckets=16)
    stale = entries.withColumns({"created_at": F.col("created_at") - F.expr("interval '1' day"), "document": F.lit("stale")})
    store.store(stale)
    store.store(entries)
    store.compact(spark)
    return store


@query("m5_plan_calls_from_store", """
select k.doc_id, k.key, case when c.key is not null then 'hit' when k.doc_id = min(k.doc_id) over (partition by k.key) then 'call' else 'share' end as action
from keyed k left join cached c on c.key = k.key""", ("keyed", "cached"))
def _(spark, d):
    return m.plan_calls(keyed(spark, d), stored(spark, d).read(spark))


@query("m5_stored_entries", "select key, created_at, document from cached", ("cached",))
def _(spark, d):
    return stored(spark, d).read(spark).select("key", "created_at", "document")


@query("d2_pending_calls", """
select key, min(doc_id) as leader, count(*) as copies from keyed where key not in (select key from cached) group by key""", ("keyed", "cached"))
def _(spark, d):
    return m.pending_calls(keyed(spark, d), cached(spark, d))


@query("d2_bypass_calls", """
select doc_id, key, doc_id as leader, cast(1 as bigint) as copies, cast(1 as bigint) as n_calls from keyed""", ("keyed",))
def _(spark, d):
    docs = keyed(spark, d)
    calls = m.pending_calls(docs, cached(spark, d), bypass=True)
    answers = calls.groupBy("key").agg(F.min("leader").alias("leader"), F.max("copies").alias("copies"), F.count("*").alias("n_calls"))
    return m.fan_out(docs.select("doc_id", "key"), answers, bypass=True).select("doc_id", "key", "leader", "copies", "n_calls")


@query("d3_cache_get_valid", """
select concat('1:v5:qwen:', md5(cast(d.doc_id as varchar))) as key from fx_docs d
where d.doc_id % 9 not in (0, 1) and d.doc_id not in (select doc_id from sound_errors)""", ("fx_docs", "sound_errors"))
def _(spark, d):
    docs = views.documents(spark, d)
    names = [c for c in docs.columns if c not in ("doc_id", "tenant_id", "status", "created_at")]
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    entries = once(docs, t=text).select("doc_id", "t").selectExpr(
        "md5(cast(doc_id as string)) as content_hash", "'v5' as prompt_version", "'qwen' as model",
        "concat('1:v5:', case when doc_id % 9 = 0 then 'other' else 'qwen' end, ':', md5(cast(doc_id as string))) as key",
        "case when doc_id % 9 = 1 then substr(t, 3) else t end as document")
    return m.cache_get_valid(entries).select("key")


STORED = """
select key, 'v5' as prompt_version, 'qwen' as model, content_hash, timestamp '2024-02-01 00:00:00' + interval '1' minute * min(doc_id) as created_at,
  cast(9 as bigint) as hits, 'new' as document from {keyed} where doc_id % 4 = 0 group by key, content_hash"""
view("stored", ("keyed",), STORED.replace("{keyed}", "keyed"))


@query("d4_cache_store", """
select coalesce(s.key, c.key) as key, coalesce(s.created_at, c.created_at) as created_at,
  case when s.key is null then c.hits else 0 end as hits, coalesce(s.document, c.document) as document
from cached c full join stored s on s.key = c.key""", ("cached", "stored"))
def _(spark, d):
    fresh = spark.sql(STORED, keyed=keyed(spark, d))
    return m.cache_store(cached(spark, d), fresh).select("key", "created_at", "hits", "document")


@query("d4_cache_touch", """
select c.key, c.hits + coalesce(n, 0) as hits from cached c left join (select key, count(*) as n from keyed group by key) k on k.key = c.key""",
       ("cached", "keyed"))
def _(spark, d):
    return m.cache_touch(cached(spark, d), keyed(spark, d)).select("key", "hits")


@query("d5_cache_evict", "select key, created_at from cached order by created_at desc, sha256(key) desc limit 100", ("cached",))
def _(spark, d):
    return m.cache_evict(cached(spark, d), 100).select("key", "created_at")


@query("d6_cache_stats", """
select (select count(*) from cached) as entries, (select count(*) from keyed where key in (select key from cached)) as hits,
  (select count(*) from keyed where key not in (select key from cached)) as misses""", ("keyed", "cached"))
def _(spark, d):
    return m.cache_stats(keyed(spark, d), cached(spark, d))


# --- attempts ------------------------------------------------------------------------
ATTEMPTS = """
select cast(floor(event_id / 2) as bigint) as key, cast(event_id % 2 + 1 as int) as attempt,
  case when event_type = 'error' then null else concat('answer ', event_type, ' ', cast(event_id as string)) end as content,
  case when event_id % 10 = 0 or event_type = 'error' then null else cast(regexp_extract(props, '([0-9]+)', 1) as bigint) end as input_tokens,
  case when event_type = 'error' then null else event_id % 500 end as output_tokens,
  cast(floor(value) as bigint) as response_ms,
  case when event_type = 'error' then 'timeout' end as provider_error,
  case when event_type in ('view', 'click') then '[{"path":"/number","code":"missing_source"}]' end as validation_error
from {events}"""
view("attempts", (), ATTEMPTS.replace("{events}", "events"))


@query("d8_summarize_attempts", """
select key, count(*) as n_attempts, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens, sum(response_ms) as response_ms,
  max_by(content, attempt) filter (provider_error is null) as raw_response,
  case when max_by(coalesce(provider_error, ''), attempt) <> '' then 'provider_error'
    when max_by(coalesce(validation_error, ''), attempt) <> '' then 'schema_validation_failed' end as error_code,
  case when max_by(coalesce(provider_error, ''), attempt) <> '' or max_by(coalesce(validation_error, ''), attempt) <> '' then 'failed' else 'succeeded' end as status
from attempts group by key""", ("attempts",))
def _(spark, d):
    text = ATTEMPTS.replace('[{"path"', '[{{"path"').replace('source"}]', 'source"}}]')
    return m.summarize_attempts(spark.sql(text, events=table(spark, d, "events"))).drop("attempts_json")


@query("d9_next_attempt_no", """
select user_id as doc_id, event_id as extraction_id, cast(row_number() over (partition by user_id order by ts, event_id)
  + coalesce((select max(o_orderkey % 4) from orders where o_custkey = user_id), 0) as int) as attempt_no from events""")
def _(spark, d):
    new = table(spark, d, "events").selectExpr("user_id as doc_id", "event_id as extraction_id", "ts as created_at")
    old = table(spark, d, "orders").selectExpr("o_custkey as doc_id", "o_orderkey % 4 as attempt_no")
    return m.next_attempt_no(old, new)


@query("d10_confidence_summary", """
select doc_id, cast(round_even(cast(sum(cast(confidence as decimal(18,6))) / count(*) as decimal(18,10)), 4) as decimal(5,4)) as overall_confidence,
  bool_or(confidence < 0.8) as requires_review from fx_fields group by doc_id""", ("fx_fields",))
def _(spark, d):
    return m.confidence_summary(views.documents(spark, d))


CALLS = """
select event_id, event_type as model, case when event_id % 10 = 0 then null else cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 1000 end as input_tokens,
  case when event_id % 7 = 0 then null else event_id % 500 end as output_tokens from {events}"""
PROFILES = """
select event_id as position, case when event_type in ('view', 'error') then '' else event_type end as model,
  cast(case when event_type = 'click' then 0 else (event_id % 7) + 0.25 end as decimal(12,6)) as input_price,
  cast(case when event_type = 'click' then 0 else (event_id % 11) + 0.5 end as decimal(12,6)) as output_price from {events}"""
view("calls", (), CALLS.replace("{events}", "events"))
view("prices", (), "select model, max_by(input_price, position) as input_price, max_by(output_price, position) as output_price from ("
     + PROFILES.replace("{events}", "events") + ") where model <> '' group by model")
COMPONENT = ("case when {p} = 0 then cast(0 as decimal(32,12)) else cast(cast({t} as decimal(12,0)) * cast({p} as decimal(12,6)) "
             "* cast(0.000001 as decimal(6,6)) as decimal(32,12)) end")
COST = f"cast({COMPONENT.format(t='input_tokens', p='input_price')} + {COMPONENT.format(t='output_tokens', p='output_price')} as decimal(32,12))"


def calls(spark, d) -> DataFrame:
    return spark.sql(CALLS, events=table(spark, d, "events"))


def prices(spark, d) -> DataFrame:
    return m.price_table(spark.sql(PROFILES, events=table(spark, d, "events")))


@query("d11_price_calls", f"select event_id, c.model, {COST} as cost_usd from calls c left join prices p on p.model = c.model", ("calls", "prices"))
def _(spark, d):
    return m.price_calls(calls(spark, d), prices(spark, d)).select("event_id", "model", "cost_usd")


FIXED_PRICES = {"click": (Decimal("0"), Decimal("0")), "purchase": (Decimal("2"), Decimal("4")), "signup": (Decimal("2.5"), Decimal("10"))}


@query("d11_price_calls_configured", f"""
select event_id, c.model, {COST} as cost_usd from calls c left join (values ('click', 0, 0), ('purchase', 2, 4), ('signup', 2.5, 10))
  p(model, input_price, output_price) on p.model = c.model""", ("calls",))
def _(spark, d):
    return m.price_calls(calls(spark, d), FIXED_PRICES).select("event_id", "model", "cost_usd")


@query("d12_require_prices", "select model, count(*) as n_calls from calls where model not in (select model from prices) group by model", ("calls", "prices"))
def _(spark, d):
    return m.require_prices(calls(spark, d), prices(spark, d))


@query("d13_price_table", "select * from prices", ("prices",))
def _(spark, d):
    return prices(spark, d)


STEPS = """
select cast(floor(event_id / 4) as bigint) as doc_id, cast(cast(ts as date) as string) as run_id, ts as started_at,
  case event_id % 3 when 0 then 'text_extraction' when 1 then 'llm_extraction' else case when event_id % 41 = 0 then ' ' else 'metrics' end end as step,
  case when event_id % 97 = 0 then -value else value end as seconds from {events}"""
view("steps", (), STEPS.replace("{events}", "events"))
SECONDS = "cast(round_even(sum(cast(greatest(seconds, 0) as decimal(18,9))), 6) as decimal(18,6))"
view("run_steps", ("steps",), f"select run_id, step, {SECONDS} as seconds, min(started_at) as first_started_at from steps where trim(step) <> '' group by run_id, step")


def steps(spark, d) -> DataFrame:
    return spark.sql(STEPS, events=table(spark, d, "events"))


@query("d14_finalize_extractions", f"""
select p.doc_id, coalesce(w.attempt_no, 7) as attempt_no, coalesce(w.model, 'cheap') as model, coalesce(w.prompt_version, 'v1') as prompt_version,
  w.doc_id is null as cache_hit, s.llm as llm_seconds, cost_usd from
  (select distinct doc_id from steps) p left join
  (select distinct doc_id, 3 as attempt_no, 'm2' as model, 'v5' as prompt_version from steps where doc_id % 3 = 0) w on w.doc_id = p.doc_id left join
  (select doc_id, {SECONDS} as llm from steps where step = 'llm_extraction' group by doc_id) s on s.doc_id = p.doc_id left join
  (select distinct doc_id, cast(doc_id * cast(0.000001 as decimal(6,6)) as decimal(32,12)) as cost_usd from steps where doc_id % 2 = 0) c on c.doc_id = p.doc_id""",
       ("steps",))
def _(spark, d):
    log = steps(spark, d)
    ids = log.select("doc_id").distinct()
    written = ids.where("doc_id % 3 = 0").selectExpr("doc_id", "3 as attempt_no", "'m2' as model", "'v5' as prompt_version")
    costs = ids.where("doc_id % 2 = 0").selectExpr("doc_id", "cast(doc_id * cast(0.000001 as decimal(6,6)) as decimal(32,12)) as cost_usd")
    done = m.finalize_extractions(ids.selectExpr("doc_id", "7 as next_attempt_no"), written, m.step_maps(m.step_durations(log)), costs,
                                  {"model": "cheap", "prompt_version": "v1"})
    return done.select("doc_id", "attempt_no", "model", "prompt_version", "cache_hit",
                       F.try_element_at("step_durations", F.lit("llm_extraction")).alias("llm_seconds"), "cost_usd")


@query("d15_record_failures", """
select doc_id, 'failed' as status, substr(case source when 'src1' then 'provider_error' when 'src2' then 'schema_validation_failed'
  when 'src3' then 'text_extraction_failed' else concat(source, repeat('x', 70)) end, 1, 64) as error_code, text as error_message from documents""")
def _(spark, d):
    errors = table(spark, d, "documents").selectExpr("doc_id", "text as message", """
      case source when 'src1' then 'provider' when 'src2' then 'schema' when 'src3' then 'text' else concat(source, repeat('x', 70)) end as stage""")
    return m.record_failures(errors, code_width=64)


@query("d16_step_durations", f"""
select doc_id, step, {SECONDS} as seconds, min(started_at) as first_started_at from steps where trim(step) <> '' group by doc_id, step""", ("steps",))
def _(spark, d):
    return m.step_durations(steps(spark, d))


@query("d17_merge_step_durations", "select * from run_steps", ("run_steps",))
def _(spark, d):
    return m.merge_step_durations(steps(spark, d))


RUN_TIMES = """
select cast(cast(ts as date) as string) as run_id, cast(case when day(min(ts)) % 9 = 0 then 0 else sum(cast(abs(value) as decimal(18,6))) + day(min(ts)) % 3 end as decimal(18,6)) as run_seconds
from {events} group by cast(ts as date)"""
view("run_times", (), RUN_TIMES.replace("{events}", "events"))


@query("d18_step_shares", """
select t.run_id, step, seconds, cast(seconds as double) / cast(nullif(run_seconds, 0) as double) as share from (
  select run_id, step, seconds from run_steps union all
  select s.run_id, 'other', cast(max(run_seconds) - sum(seconds) as decimal(18,6)) from run_steps s join run_times r on r.run_id = s.run_id
  group by s.run_id having max(run_seconds) > 0 and max(run_seconds) - sum(seconds) > 0.0005) t join run_times r on r.run_id = t.run_id""",
       ("run_steps", "run_times"))
def _(spark, d):
    runs = spark.sql(RUN_TIMES, events=table(spark, d, "events"))
    return m.step_shares(m.merge_step_durations(steps(spark, d)), runs)


@query("d19_step_waterfall", """
select run_id, ord, step, seconds,
  case when total > 0 then round(cast(coalesce(before, 0) as double) / cast(total as double) * 100, 3) else 0 end as offset_percent,
  case when total > 0 then round(cast(seconds as double) / cast(total as double) * 100, 3) else 0 end as width_percent from (
  select *, row_number() over w - 1 as ord, sum(seconds) over (partition by run_id) as total,
    sum(seconds) over (w rows between unbounded preceding and 1 preceding) as before
  from run_steps window w as (partition by run_id order by first_started_at, step))""", ("run_steps",))
def _(spark, d):
    return m.step_waterfall(m.merge_step_durations(steps(spark, d)))


@query("d20_call_throughput", """
select event_id as label, event_type <> 'error' as ok, cast(event_id as double) / 1e9 as load_s, coalesce(try_cast(case when event_id % 5 = 0 then 'n/a'
  else cast(event_id * 7 as varchar) end as double) / 1e9, 0) as prompt_s, cast(event_id % 3 * 1000 as double) / 1e9 as eval_s,
  case when event_type <> 'error' then case when event_id % 3 = 0 then 0 else (event_id % 100) / (cast(event_id % 3 * 1000 as double) / 1e9) end end as tokens_per_s
from events""")
def _(spark, d):
    return m.call_throughput(table(spark, d, "events").selectExpr(
        "event_id as label", "event_type <> 'error' as ok", "event_id as load_ns",
        "case when event_id % 5 = 0 then 'n/a' else cast(event_id * 7 as string) end as prompt_ns",
        "event_id % 3 * 1000 as eval_ns", "event_id % 100 as eval_count"))


@query("d21_estimate_prompt_size", "select conv_id as request_id, sum(length(text)) as n_chars from conversations group by conv_id")
def _(spark, d):
    return m.estimate_prompt_size(table(spark, d, "conversations").selectExpr("conv_id as request_id", "role", "text as content"))
