"""Model stage: call planning, content cache, audit, cost and timing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.functions.identifiers import cache_key
from vouchsafe.functions.numbers import dec
from vouchsafe.operators.fields import field_array, fields_of
from vouchsafe.operators.rows import cut, lookup_join, newest_rows, rank_within
from vouchsafe.operators.validation import document_errors, parse_results, validate_fields
from vouchsafe.session import settle
from vouchsafe.settings import MAX_MODEL_ATTEMPTS, SCHEMA_VERSION

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


# --- planning and cache --------------------------------------------------------
def with_cache_key(layouts: DataFrame, prompt_version: str, model: str) -> DataFrame:
    key = cache_key(F.col("content_hash"), F.lit(prompt_version), F.lit(model))
    return layouts.withColumn("key", key).withColumn("key_digest", F.sha2(key, 256))


def plan_keys(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per distinct content: its leading document, copies, and the cached answer if any."""
    keys = docs.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("copies"))
    entries = cache.select("key", F.col("document").alias("cached_document"), F.lit(True).alias("cached"))
    return keys.join(entries, "key", "left")


def call_id(bypass: bool) -> Column:
    """What identifies a call: the content key, or the key and the document when the cache is bypassed."""
    return F.concat_ws("#", "key", F.col("doc_id").cast("string")) if bypass else F.col("key")


def pending_calls(docs: DataFrame, cache: DataFrame, *, bypass: bool = False) -> DataFrame:
    """The calls to make, unique by ``key``: each unknown content once, or every document when the cache is bypassed.

    A bypassed call's ``key`` is its own ``call_id``, so copies of a content have attempts of their own.
    """
    if bypass:
        return docs.select(call_id(True).alias("key"), F.col("doc_id").alias("leader"), F.lit(1).cast("bigint").alias("copies"))
    return plan_keys(docs, cache).where("cached IS NULL").select("key", "leader", "copies")


def plan_calls(docs: DataFrame, cache: DataFrame, *, bypass: bool = False) -> DataFrame:
    """Per document: ``hit`` (answer known), ``call`` (asks the model) or ``share`` (copy of a call)."""
    if bypass:
        return docs.select("doc_id", call_id(True).alias("key"), F.lit("call").alias("action"))
    planned = lookup_join(docs.select("doc_id", "key"), plan_keys(docs, cache), "key", copies="copies", spread=["doc_id"])
    action = F.when(F.col("cached"), "hit").when(F.col("doc_id") == F.col("leader"), "call").otherwise("share")
    return planned.select("doc_id", "key", action.alias("action"))


def fan_out(docs: DataFrame, answers: DataFrame, *, bypass: bool = False) -> DataFrame:
    """Give the answer of a call (unique by key, with ``copies``) to all of its documents."""
    if bypass:
        own = docs.withColumn("_call", call_id(True))
        return own.join(answers.withColumnRenamed("key", "_call"), "_call", "left").drop("_call")
    return lookup_join(docs, answers, "key", copies="copies", spread=["doc_id"])


def cache_get_valid(cache: DataFrame) -> DataFrame:
    """Entries whose stored key matches their parts and whose document still validates."""
    expected = cache_key(F.col("content_hash"), F.col("prompt_version"), F.col("model"))
    matching = cache.where(F.col("key") == expected)
    parsed = parse_results(matching.withColumnRenamed("document", "content")).where("error IS NULL")
    sound = parsed.where(F.size(document_errors("document.")) == 0)
    return sound.drop("document", "error").withColumnRenamed("content", "document").select(*cache.columns)


def cache_store(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Last write per key wins; a write starts with zero hits."""
    columns = cache.columns
    fresh = results.select(*[F.lit(0).cast("bigint").alias("hits") if c == "hits" else F.col(c) for c in columns])
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "created_at", "document")
    latest = both.groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("entry"))
    return latest.select("entry.*")


def cache_touch(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """Raise the hit counters by the lookups of each key."""
    counted = lookups.groupBy("key").agg(F.count("*").alias("_n"))
    return (
        cache.join(counted, "key", "left")
        .withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0)))
        .select(*cache.columns)
    )


def cache_evict(cache: DataFrame, max_entries: int) -> DataFrame:
    """Keep the newest entries; entries of the same instant are ordered by the digest of their key."""
    digest = F.sha2("key", 256)
    levels = [F.date_trunc("HOUR", "created_at"), F.col("created_at"), F.substring(digest, 1, 4), digest]
    return newest_rows(cache, max_entries, levels).select(*cache.columns)


def cache_stats(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries, hits and misses in one row; lookups are counted per key before they meet the cache."""
    asked = lookups.groupBy("key").agg(F.count("*").alias("asked"))
    entries = cache.select("key", F.lit(1).alias("stored"))
    both = entries.join(asked, "key", "full_outer")
    return both.agg(
        F.count("stored").alias("entries"),
        F.coalesce(F.sum(F.when(F.col("stored") == 1, F.col("asked"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("stored").isNull(), F.col("asked"))), F.lit(0)).alias("misses"),
    )


# --- calls ------------------------------------------------------------------------
MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
]))
RESPONSE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("response_ms", T.LongType()), T.StructField("provider_error", T.StringType()),
])
RETRY_TEXT = "Проверка нашла ошибки. Пришли весь JSON заново, в нём только то, что есть в тексте. Что найдено:\n"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def judge_responses(answered: DataFrame, link: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers (doc_id, content, provider_error, …) plus the reason why one is refused, null for a good one.

    Parsing and validation stay in the answer's row. ``link`` may add evidence to ``fields`` before.
    """
    parsed = parse_results(answered)
    nested = parsed.withColumn("fields", fields_of("document")).drop("document")
    checked = validate_fields(nested if link is None else link(nested))
    reason = (
        F.when(F.col("provider_error").isNull(), F.coalesce(
            F.col("error"), F.when(F.size("errors") > 0, F.to_json(F.col("errors"))),
        ))
    )
    return checked.withColumn("validation_error", reason).select(*answered.columns, "validation_error")


def run_model(
    pending: DataFrame, model_fn: ModelFn, *, max_attempts: int = MAX_MODEL_ATTEMPTS,
    concurrency: int | None = None, link: Callable[[DataFrame], DataFrame] | None = None, retry_text: str = RETRY_TEXT,
) -> DataFrame:
    """Ask the model for every pending (key, messages); refused answers are asked again with the errors.

    ``retry_text`` stands before the errors of a refused answer. ``model_fn`` maps batches of (key, messages) to batches of the response columns. ``concurrency``
    is the number of tasks that call at the same time. Each round is written to reliable storage
    before it is used, so neither a lost executor nor a later action repeats a finished round.
    """
    ask, rounds = pending.select("key", "messages"), []
    for attempt in range(1, max_attempts + 1):
        spread = ask.repartition(concurrency, "key") if concurrency else ask.repartition("key")
        answered = settle(spread.mapInPandas(model_fn, RESPONSE))
        judged = judge_responses(answered.withColumnRenamed("key", "doc_id"), link).withColumnRenamed("doc_id", "key")
        judged = settle(judged.select(F.lit(attempt).alias("attempt"), *RESPONSE.names, "validation_error"))
        rounds.append(judged)
        if attempt < max_attempts:
            refused = judged.where("provider_error IS NULL AND validation_error IS NOT NULL")
            ask = ask.join(refused.select("key", "content", "validation_error"), "key").select(
                "key",
                F.concat("messages", F.array(
                    _message("assistant", F.col("content")),
                    _message("user", F.concat(F.lit(retry_text), F.col("validation_error"))),
                )).cast(MESSAGES).alias("messages"),
            )
    result = rounds[0]
    for later in rounds[1:]:
        result = result.unionByName(later)
    return result


# --- audit ------------------------------------------------------------------------
def summarize_attempts(attempts: DataFrame, key: str = "key") -> DataFrame:
    """One audit row per extraction; the attempt list is bounded by the attempt limit."""
    last = F.struct("attempt")
    record = F.struct("attempt", "content", "input_tokens", "output_tokens", "provider_error", "validation_error")
    code = F.when(F.col("last_provider_error").isNotNull(), "provider_error").when(
        F.col("last_validation_error").isNotNull(), "schema_validation_failed")
    return (
        attempts.groupBy(key).agg(
            F.count("*").alias("n_attempts"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("response_ms").alias("response_ms"),
            F.max_by("content", F.when(F.col("provider_error").isNull(), F.col("attempt"))).alias("raw_response"),
            F.max_by("provider_error", last).alias("last_provider_error"),
            F.max_by("validation_error", last).alias("last_validation_error"),
            F.to_json(F.sort_array(F.collect_list(record))).alias("attempts_json"),
        )
        .withColumn("error_code", code)
        .withColumn("status", F.when(F.col("error_code").isNull(), "succeeded").otherwise("failed"))
        .drop("last_provider_error", "last_validation_error")
    )


def next_attempt_no(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Number new extractions of a document after its existing ones, in time order."""
    ranked = rank_within(
        new, ["doc_id"], F.date_trunc("HOUR", "created_at"), [F.col("created_at"), F.col("extraction_id")], "_rank")
    last = existing.groupBy("doc_id").agg(F.max("attempt_no").alias("_last"))
    number = F.coalesce("_last", F.lit(0)) + F.col("_rank")
    return ranked.join(last, "doc_id", "left").select("doc_id", "extraction_id", number.cast("int").alias("attempt_no"))


def confidence_summary(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mean confidence over all fields (missing ones count as 0), and whether any is weak."""
    scores = F.transform(field_array(), lambda f: f["confidence"])
    total = F.aggregate(scores, F.lit(0).cast("decimal(28,12)"),
                        lambda acc, c: (acc + c.cast("decimal(18,12)")).cast("decimal(28,12)"))
    mean = F.bround((total.cast("decimal(20,12)") / F.size(scores)).cast("decimal(20,12)"), 4).cast("decimal(5,4)")
    return docs.select(
        "doc_id",
        F.when(F.size(scores) > 0, mean).alias("overall_confidence"),
        (F.exists(scores, lambda c: c < threshold) | (F.size(scores) == 0)).alias("requires_review"),
    )


# --- cost -------------------------------------------------------------------------
def price_table(profiles: DataFrame) -> DataFrame:
    """(position, model, in, out) profiles -> one price per model; blanks skipped, the later wins."""
    named = profiles.where(F.trim("model") != "")
    return named.groupBy("model").agg(
        F.max_by("input_price", "position").alias("input_price"),
        F.max_by("output_price", "position").alias("output_price"),
    )


def _component(tokens: Column, price: Column) -> Column:
    paid = (tokens.cast("decimal(12,0)") * price.cast("decimal(12,6)") * dec("0.000001", 6, 6)).cast("decimal(32,12)")
    return F.when(price == 0, dec("0", 32, 12)).otherwise(paid)


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price per million tokens; a free model costs 0 even without counts, else unknown stays null."""
    return (_component(tokens_in, price_in) + _component(tokens_out, price_out)).cast("decimal(32,12)")


def _price_column(prices: Mapping[str, tuple[Decimal, Decimal]], side: int) -> Column:
    entries = [x for model, pair in prices.items() for x in (F.lit(model), F.lit(pair[side]).cast("decimal(12,6)"))]
    return F.try_element_at(F.create_map(*entries), F.col("model"))


def price_calls(calls: DataFrame, prices: DataFrame | Mapping[str, tuple[Decimal, Decimal]]) -> DataFrame:
    """Add ``cost_usd``; a model without a price has an unknown cost.

    A price mapping is configuration and becomes a literal, so no model name is ever a join key.
    """
    if isinstance(prices, Mapping):
        cost = call_cost(F.col("input_tokens"), F.col("output_tokens"), _price_column(prices, 0), _price_column(prices, 1))
        return calls.withColumn("cost_usd", cost)
    # few models make most calls: their rows are counted first and spread over tasks
    plain = [f.name for f in calls.schema.fields if "map<" not in f.dataType.simpleString()]
    counted = calls.groupBy("model").agg(F.count("*").alias("_copies"))
    lookup = counted.join(prices.select("model", "input_price", "output_price"), "model", "left")
    joined = lookup_join(calls, lookup, "model", copies="_copies", spread=plain).drop("_copies")
    cost = call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price"))
    return joined.withColumn("cost_usd", cost).drop("input_price", "output_price")


def require_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that are called but have no price, with the number of their calls."""
    used = calls.groupBy("model").agg(F.count("*").alias("n_calls"))
    return used.join(prices, "model", "left_anti")


# --- closing an extraction --------------------------------------------------------
def finalize_extractions(
    docs: DataFrame, extractions: DataFrame, step_maps: DataFrame, costs: DataFrame, defaults: Mapping[str, str],
) -> DataFrame:
    """Exactly one extraction row per processed document.

    ``docs`` (doc_id, next_attempt_no) are the processed ones, ``extractions`` (doc_id, attempt_no,
    model, prompt_version) those a model call wrote; the rest came from the cache.
    """
    written = extractions.select("doc_id", "attempt_no", "model", "prompt_version", F.lit(True).alias("_written"))
    joined = docs.join(written, "doc_id", "left").join(step_maps, "doc_id", "left").join(costs, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce("attempt_no", "next_attempt_no").alias("attempt_no"),
        F.lit("succeeded").alias("status"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce("model", F.lit(defaults["model"])).alias("model"),
        F.coalesce("prompt_version", F.lit(defaults["prompt_version"])).alias("prompt_version"),
        F.col("_written").isNull().alias("cache_hit"),
        F.col("step_durations"),
        F.col("cost_usd"),
    )


def record_failures(errors: DataFrame, *, code_width: int | None = None, message_width: int | None = None) -> DataFrame:
    """(doc_id, stage, message) -> failed status with a stable code; a store with fixed columns names their widths.

    Stages: ``provider`` and ``schema`` of the model, ``text`` for reading; others keep their name.
    """
    code = (
        F.when(F.col("stage") == "provider", "provider_error")
        .when(F.col("stage") == "schema", "schema_validation_failed")
        .when(F.col("stage") == "text", "text_extraction_failed")
        .otherwise(F.col("stage"))
    )
    return errors.select(
        "doc_id", F.lit("failed").alias("status"),
        cut(code, code_width).alias("error_code"),
        cut(F.col("message"), message_width).alias("error_message"),
    )


# --- timing -----------------------------------------------------------------------
SECONDS = "decimal(18,6)"


def _measured(log: DataFrame) -> DataFrame:
    return log.where(F.trim("step") != "").withColumn(
        "_s", F.greatest(F.col("seconds"), F.lit(0)).cast("decimal(18,9)"))


def blank_steps(log: DataFrame) -> DataFrame:
    """Measurements that are refused because their step has no name."""
    return log.where(F.coalesce(F.trim("step"), F.lit("")) == "")


def step_durations(log: DataFrame) -> DataFrame:
    """Seconds per document and step, in order of the first start; failed steps count."""
    return _measured(log).groupBy("doc_id", "step").agg(
        F.bround(F.sum("_s"), 6).cast(SECONDS).alias("seconds"),
        F.min("started_at").alias("first_started_at"),
    )


def step_maps(durations: DataFrame) -> DataFrame:
    """Steps of a document as one map; there are as many entries as step names."""
    entry = F.struct("first_started_at", "step", "seconds")
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["step"], e["seconds"]))
    return durations.groupBy("doc_id").agg(F.map_from_entries(ordered).alias("step_durations"))


def merge_step_durations(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Run totals per step."""
    return _measured(log).groupBy(run, "step").agg(
        F.bround(F.sum("_s"), 6).cast(SECONDS).alias("seconds"),
        F.min("started_at").alias("first_started_at"),
    )


def step_shares(totals: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Share of each step in the run time, and a rest row for what nobody measured."""
    both = totals.select(run, "step", "seconds").join(runs.select(run, "run_seconds"), run)
    rest = (
        both.groupBy(run).agg(F.sum("seconds").alias("_sum"), F.max("run_seconds").alias("run_seconds"))
        .withColumn("seconds", (F.col("run_seconds") - F.col("_sum")).cast(SECONDS))
        .where((F.col("run_seconds") > 0) & (F.col("seconds") > dec("0.0005", 5, 4)))
        .select(run, F.lit("other").alias("step"), "seconds", "run_seconds")
    )
    share = F.try_divide(F.col("seconds").cast("double"), F.col("run_seconds").cast("double"))
    return both.unionByName(rest).select(run, "step", "seconds", share.alias("share"))


def step_waterfall(totals: DataFrame, run: str = "run_id") -> DataFrame:
    """Width and running offset of each step in percent; all zero when nothing took time.

    Totals hold one row per run and step name, so a run is a short list.
    """
    entry = F.struct("first_started_at", "step", "seconds")
    lists = totals.groupBy(run).agg(
        F.sort_array(F.collect_list(entry)).alias("steps"), F.sum("seconds").cast("double").alias("total"))

    def width(s: Column) -> Column:
        return F.when(F.col("total") > 0, s["seconds"].cast("double") / F.col("total") * 100).otherwise(F.lit(0.0))

    def bar(s: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("steps", F.lit(1), i), F.lit(0).cast("decimal(28,6)"),
                             lambda acc, x: (acc + x["seconds"]).cast("decimal(28,6)")).cast("double")
        offset = F.when(F.col("total") > 0, before / F.col("total") * 100).otherwise(F.lit(0.0))
        return F.struct(
            i.alias("ord"), s["step"].alias("step"), s["seconds"].alias("seconds"),
            F.round(offset, 3).alias("offset_percent"), F.round(width(s), 3).alias("width_percent"),
        )

    return lists.select(run, F.inline(F.transform("steps", bar)))


def call_throughput(calls: DataFrame) -> DataFrame:
    """Seconds and token rate per call from nanosecond counters; failed calls stay in the list."""
    seconds = lambda c: F.coalesce(F.col(c).try_cast("double") / 1e9, F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.col("eval_count").cast("double"), seconds("eval_ns")), F.lit(0.0))
    return calls.select(
        "label", "ok",
        seconds("load_ns").alias("load_s"), seconds("prompt_ns").alias("prompt_s"), seconds("eval_ns").alias("eval_s"),
        F.when(F.col("ok"), rate).alias("tokens_per_s"),
    )


def estimate_prompt_size(messages: DataFrame, request: str = "request_id") -> DataFrame:
    """Characters per request over all of its messages."""
    return messages.groupBy(request).agg(F.sum(F.char_length("content")).alias("n_chars"))
