"""Extraction quality against expected values.

Expected and actual documents meet in one join on the sample; everything after that, including the
line matching, happens inside the joined row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.functions.assignment import PAIRS, assign_lines
from vouchsafe.functions.compare import Comparator, default_comparators, exact_equal, name_similarity
from vouchsafe.functions.text import has_name, normalize_name
from vouchsafe.operators.rows import cut, let, once, rows_of
from vouchsafe.settings import LINE_THRESHOLD, NAME_THRESHOLD

COUNTS = ("matches", "misses", "hallucinations", "mismatches")
_OUTCOME_OF = dict(zip(("match", "miss", "hallucination", "mismatch"), COUNTS))

LINE_TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in fv.EVAL_LINE_FIELDS])


def bare_form(docs: DataFrame, sample: str = "sample_id", *, wrapped: bool) -> DataFrame:
    """(sample, one text column per scalar path, lines of text values).

    ``wrapped`` documents hold value/confidence/evidence structs, gold documents bare values.
    """
    tail = ".value" if wrapped else ""
    scalars = [F.col(p + tail).cast("string").alias(p.replace(".", "_")) for p in fv.EVAL_SCALARS]
    line = lambda x: F.struct(*[
        (x[n]["value"] if wrapped else x[n]).cast("string").alias(n) for n in fv.EVAL_LINE_FIELDS])
    return docs.select(sample, *scalars, F.transform("line_items", line).alias("lines"))


def outcome(expected: Column, actual: Column, equal: Column) -> Column:
    return (
        F.when(expected.isNull() & actual.isNull(), "none")
        .when(actual.isNull(), "miss")
        .when(expected.isNull(), "hallucination")
        .when(equal, "match")
        .otherwise("mismatch")
    )


def _entry(field: str, result: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), result.alias("outcome"))


def pair_samples(expected: DataFrame, actual: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Both sides of each sample in one row; a sample missing on one side counts as empty there."""
    e = expected.select(sample, F.struct(*[c for c in expected.columns if c != sample]).alias("e"))
    a = actual.select(sample, F.struct(*[c for c in actual.columns if c != sample]).alias("a"))
    return e.join(a, sample, "full_outer")


def scalar_outcomes(pairs: DataFrame, comparators: Mapping[str, Comparator] | None = None) -> DataFrame:
    """Add ``scalars``, the outcome of each of the twelve scalar paths."""
    table = default_comparators() if comparators is None else comparators
    entries = []
    for path in fv.EVAL_SCALARS:
        column = path.replace(".", "_")
        left, right = F.col("e")[column], F.col("a")[column]
        entries.append(_entry(path, outcome(left, right, table.get(path, exact_equal)(left, right))))
    return pairs.withColumn("scalars", F.array(*entries))


def field_outcomes(
    expected: DataFrame, actual: DataFrame, sample: str = "sample_id",
    comparators: Mapping[str, Comparator] | None = None,
) -> DataFrame:
    """One row per sample and scalar path; lines stay out of the join."""
    pairs = pair_samples(expected.drop("lines"), actual.drop("lines"), sample)
    return rows_of(scalar_outcomes(pairs, comparators), [sample], "scalars")


def _comparable(line: Column) -> Column:
    """Line values in the form the scorer compares: normalized name, canonical decimals, plain unit."""
    number = lambda c: F.when(c.isNotNull(), F.coalesce(c.try_cast("decimal(38,10)").cast("string"), F.lit("")))
    return F.struct(
        normalize_name(line["name"]).alias("name"), number(line["amount"]).alias("amount"),
        number(line["quantity"]).alias("quantity"), number(line["unit_price"]).alias("unit_price"),
        line["unit"].alias("unit"), number(line["vat_rate"]).alias("vat_rate"),
    )


def line_similarity(expected: Column, actual: Column) -> Column:
    """Weighted agreement of two lines: the name by its ratio, the rest by equality; only what is expected counts."""
    left, right = _comparable(expected), _comparable(actual)
    weight = score = F.lit(0.0)
    for name, value in fv.LINE_WEIGHTS.items():
        there = left[name].isNotNull()
        if name == "name":
            part = F.coalesce(name_similarity(expected["name"], actual["name"]), F.lit(0.0))
        else:
            part = F.coalesce((left[name] == right[name]) & ((left[name] != "") | F.lit(name == "unit")), F.lit(False)).cast("double")
        weight = weight + F.when(there, value).otherwise(0.0)
        score = score + F.when(there, part * value).otherwise(0.0)
    return F.when(weight > 0, score / weight).otherwise(0.0)


def _own_score(line: Column) -> Column:
    """What a line scores against an equal one, the most that it can score against any."""
    weight = score = F.lit(0.0)
    for name, value in fv.LINE_WEIGHTS.items():
        there = line[name].isNotNull()
        equals = there if name in ("name", "unit") else there & (line[name] != "")
        weight = weight + F.when(there, value).otherwise(0.0)
        score = score + F.when(equals, value).otherwise(0.0)
    return F.when(weight > 0, score / weight).otherwise(0.0)


def _spelled(line: Column) -> Column:
    """One text per comparable line, another one for any other line: only the unit, which stands last, may hold any character."""
    plain = [line[n] for n in ("name", "amount", "quantity", "unit_price", "vat_rate")]
    return F.array_join(F.array(*plain, F.concat(F.lit("="), line["unit"])), "\x00", "\x01")


def _equal_pair(line: Column, expected_no: Column, actual_no: Column) -> Column:
    return F.struct(
        expected_no.alias("e"), actual_no.alias("a"), _own_score(line).alias("score"),
        F.when(line["name"].isNotNull(), F.lit(1.0)).alias("name_ratio"))


def settled_pairs(expected: Column, actual: Column) -> Column:
    """The best pairs where equal lines alone give them, else null; both lists are in comparable form.

    Equal lines are paired in order. No assignment is better when each line of the shorter side has a partner and
    scores the most that is possible: an expected line never scores more than against an equal one, and no line
    scores more than 1. Documents without a line on either side have no pairs.
    """

    def numbered(texts: Column) -> Column:  # each line's text with the number of equal ones before it
        return F.transform(texts, lambda x, i: F.concat(x, F.size(F.filter(F.slice(texts, 1, i), lambda y: y == x)).cast("string")))

    def pairs(e: Column, a: Column) -> Column:
        found = F.transform(expected, lambda x, i: _equal_pair(x, i, (F.array_position(a, F.get(e, i)) - 1).cast("int")))
        return F.filter(found, lambda p: p["a"] >= 0)

    def judged(found: Column) -> Column:
        full = F.forall(found, lambda p: p["score"] == 1.0)
        all_expected = F.size(found) == F.size(expected)
        all_actual = (F.size(found) == F.size(actual)) & full
        return F.when(all_expected | all_actual, found)

    both = (F.coalesce(F.size(expected), F.lit(0)) > 0) & (F.coalesce(F.size(actual), F.lit(0)) > 0)
    texts = lambda lines: let(F.transform(lines, _spelled), numbered)
    paired = let(texts(expected), lambda e: let(texts(actual), lambda a: pairs(e, a)))
    return F.when(both, let(paired, judged)).otherwise(F.array().cast(PAIRS))


def match_lines(pairs: DataFrame, threshold: float = LINE_THRESHOLD) -> DataFrame:
    """Add ``matched``: the best one-to-one line pairs that reach the threshold.

    Documents that equal lines settle get their pairs here; the lines of the others go to the solver. Lists that are
    equal as they stand are paired line by line.
    """
    lines_e, lines_a = F.col("e")["lines"], F.col("a")["lines"]
    judged = once(pairs, _same=F.coalesce(lines_e == lines_a, F.lit(False)))
    lines = once(
        judged, _le=F.transform(lines_e, _comparable), _la=F.when(~F.col("_same"), F.transform(lines_a, _comparable)))
    in_order = F.transform("_le", lambda x, i: _equal_pair(x, i, i))
    settled = once(lines, _settled=F.when(F.col("_same"), in_order).otherwise(settled_pairs(F.col("_le"), F.col("_la"))))
    open_ = F.col("_settled").isNull()
    solved = assign_lines(F.when(open_, F.col("_le")), F.when(open_, F.col("_la")))
    return settled.withColumn("_solved", solved).withColumn(
        "matched", F.filter(F.coalesce("_settled", "_solved"), lambda p: p["score"] >= threshold),
    ).drop("_same", "_le", "_la", "_settled", "_solved")


def matched_pairs(matched: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The accepted pairs as rows: expected index, actual index, score."""
    return rows_of(matched, [sample], "matched").select(
        sample, F.col("e").alias("expected_no"), F.col("a").alias("actual_no"), "score")


def _line_entries(left: Column, right: Column, name_ratio: Column, name_threshold: float, table: Mapping[str, Comparator]) -> Column:
    """Outcomes of the fields of two lines side by side; a line that isn't there has no values."""
    entries = []
    for name in fv.EVAL_LINE_FIELDS:
        path = f"line_items[].{name}"
        if name == "name":
            filled = has_name(left["name"]) & has_name(right["name"])
            equal = F.coalesce(filled & (name_ratio >= name_threshold), F.lit(False))
        else:
            equal = table.get(path, exact_equal)(left[name], right[name])
        entries.append(_entry(path, outcome(left[name], right[name], equal)))
    return F.array(*entries)


def _line_pairs() -> Column:
    """The lines of a document side by side: matched ones with their name ratio, lost and invented ones with nothing."""
    lines_e, lines_a, line = F.col("e")["lines"], F.col("a")["lines"], LINE_TEXTS.simpleString()
    nothing = F.lit(None).cast(line)

    def side_by_side(left: Column, right: Column, ratio: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"), ratio.cast("double").alias("name_ratio"))

    def alone(lines: Column, side: str, pair: Callable[[Column], Column]) -> Column:
        taken = F.transform("matched", lambda p: p[side])
        free = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(taken, s["i"]))
        return F.transform(free, lambda s: pair(s["x"]))

    none = F.array().cast(f"array<struct<left:{line},right:{line},name_ratio:double>>")
    parts = [
        F.transform("matched", lambda p: side_by_side(F.get(lines_e, p["e"]), F.get(lines_a, p["a"]), p["name_ratio"])),
        alone(lines_e, "e", lambda x: side_by_side(x, nothing, F.lit(None))), alone(lines_a, "a", lambda x: side_by_side(nothing, x, F.lit(None))),
    ]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def line_outcomes(
    matched: DataFrame, name_threshold: float = NAME_THRESHOLD,
    comparators: Mapping[str, Comparator] | None = None,
) -> DataFrame:
    """Add ``line_fields``: outcomes of matched lines, misses of lost and hallucinations of invented ones.

    ``matched`` entries hold e, a and name_ratio; pairs from elsewhere may be given as well.
    """
    table = default_comparators(name_threshold) if comparators is None else comparators
    return matched.withColumn("line_fields", F.flatten(F.transform(
        _line_pairs(), lambda p: _line_entries(p["left"], p["right"], p["name_ratio"], name_threshold, table))))


def all_outcomes(
    matched: DataFrame, sample: str = "sample_id", name_threshold: float = NAME_THRESHOLD,
    comparators: Mapping[str, Comparator] | None = None,
) -> DataFrame:
    """One row per field of documents with ``scalars`` and ``matched``: those of the document, then those of its lines.

    The lines become rows before their fields are compared: expressions on rows are compiled, lambdas over lists are not.
    """
    table = default_comparators(name_threshold) if comparators is None else comparators
    places = let(_line_pairs(), lambda pairs: F.concat(F.array(F.get(pairs, F.lit(-1))), pairs))
    rows = matched.select(sample, "scalars", F.posexplode(places).alias("_at", "_pair"))
    pair = F.col("_pair")
    of_line = _line_entries(pair["left"], pair["right"], pair["name_ratio"], name_threshold, table)
    return rows_of(rows, [sample], F.when(F.col("_at") == 0, F.col("scalars")).otherwise(of_line))


def evaluate_documents(
    expected: DataFrame, actual: DataFrame, sample: str = "sample_id", *,
    name_threshold: float = NAME_THRESHOLD, line_threshold: float = LINE_THRESHOLD,
    comparators: Mapping[str, Comparator] | None = None, lines: bool = True,
) -> DataFrame:
    """Counts per sample and field; line fields appear only where a document has lines.

    Without ``lines`` the scalar fields alone are judged, and no line is read or matched.
    """
    table = default_comparators(name_threshold) if comparators is None else comparators
    if not lines:
        return count_outcomes(field_outcomes(expected, actual, sample, table), sample, "field")
    pairs = match_lines(scalar_outcomes(pair_samples(expected, actual, sample), table), line_threshold)
    return count_outcomes(all_outcomes(pairs, sample, name_threshold, table), sample, "field")


def count_outcomes(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Exploded outcomes -> counts per key; entries of nothing leave a zero row."""
    return outcomes.groupBy(*keys).agg(*[
        F.count_if(F.col("outcome") == verdict).alias(name) for verdict, name in _OUTCOME_OF.items()])


def merge_metrics(metrics: DataFrame, *keys: str) -> DataFrame:
    """Totals per key (for example run and field)."""
    return metrics.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


# --- ratios -------------------------------------------------------------------------
def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_columns(prefix: str = "") -> dict[str, Column]:
    m, miss, hall, mis = (F.col(prefix + c) for c in COUNTS)
    recall = _share(m, m + miss + mis)
    return {"accuracy": recall, "precision": _share(m, m + hall + mis), "recall": recall}


def field_ratios(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(ratio_columns())


def f1_column(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, precision * 2 * recall / (precision + recall))


def field_f1(metrics: DataFrame) -> DataFrame:
    """Harmonic mean of precision and recall; null unless their sum is positive."""
    return field_ratios(metrics).withColumn("f1", f1_column(F.col("precision"), F.col("recall")))


def micro_accuracy(metrics: DataFrame, *keys: str) -> DataFrame:
    total = F.sum(F.col("matches") + F.col("misses") + F.col("mismatches"))
    return metrics.groupBy(*keys).agg(_share(F.sum("matches"), total).alias("micro_accuracy"))


def macro_accuracy(metrics: DataFrame, *keys: str) -> DataFrame:
    """Mean of the field accuracies that exist; fields are few, so each run is a short list."""
    scored = field_ratios(metrics).where("accuracy IS NOT NULL")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("field", "accuracy"))), lambda s: s["accuracy"])
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, a: acc + a)
    return scored.groupBy(*keys).agg((total / F.count("*")).alias("macro_accuracy"))


def weakest_fields(metrics: DataFrame, k: int = 5) -> DataFrame:
    return field_f1(metrics).orderBy(F.asc_nulls_first("f1"), F.asc("field")).limit(k)


# --- runs ---------------------------------------------------------------------------
def _all_or_nothing(column: str) -> Column:
    return F.when(F.count(column) == F.count("*"), F.sum(column))


def run_report(samples: DataFrame, run: str = "run_id", steps: DataFrame | None = None) -> DataFrame:
    """Totals per run; token and cost sums are unknown as soon as one sample's is.

    A sample that made no call (``called`` false) used 0 tokens and cost 0. ``steps`` (run, step, seconds,
    first_started_at: a row a step of a run) adds ``step_duration_totals``, a map in order of the steps' first
    start; a run without measurements has an empty one.
    """
    quiet = ~F.col("called")
    counted = samples.select(
        run, "status", "duration_seconds",
        F.when(quiet, 0).otherwise(F.col("input_tokens")).alias("input_tokens"),
        F.when(quiet, 0).otherwise(F.col("output_tokens")).alias("output_tokens"),
        F.when(quiet, F.lit(0).cast("decimal(32,12)")).otherwise(F.col("cost_usd")).alias("cost_usd"),
    )
    report = counted.groupBy(run).agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        _all_or_nothing("input_tokens").alias("input_tokens"),
        _all_or_nothing("output_tokens").alias("output_tokens"),
        _all_or_nothing("cost_usd").cast("decimal(32,12)").alias("cost_usd"),
        F.sum("duration_seconds").cast("decimal(28,6)").alias("total_duration_seconds"),
        _share(F.sum("duration_seconds"), F.count("*")).alias("average_duration_seconds"),
    )
    if steps is None:
        return report
    ordered = F.sort_array(F.collect_list(F.struct("first_started_at", "step", "seconds")))
    totals = steps.groupBy(run).agg(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["step"], e["seconds"]))).alias("step_duration_totals"))
    return report.join(totals, run, "left").withColumn(
        "step_duration_totals", F.coalesce("step_duration_totals", F.create_map().cast("map<string,decimal(18,6)>")))


def sample_results(samples: DataFrame, metrics: DataFrame, run: str = "run_id", *, message_width: int | None = None) -> DataFrame:
    """List form of the samples with their pooled accuracy."""
    accuracy = micro_accuracy(metrics, run, "sample_id").withColumnRenamed("micro_accuracy", "accuracy")
    return samples.join(accuracy, [run, "sample_id"], "left").select(
        run, "sample_id", "status", "duration_seconds", "input_tokens", "output_tokens", "cost_usd",
        "error_type", cut(F.col("error_message"), message_width).alias("error_message"), "accuracy",
    )


def run_errors(runs: DataFrame, samples: DataFrame, run: str = "run_id") -> DataFrame:
    """The run's own error and one line per failed sample."""
    own = runs.where("error_message IS NOT NULL").select(run, F.col("error_message").alias("error"))
    text = F.concat(
        F.col("sample_id").cast("string"), F.lit(": "), F.coalesce("error_type", F.lit("")), F.lit(" "),
        F.coalesce("error_message", F.lit("")))
    failed = samples.where(F.col("status") == "failed").select(run, F.trim(text).alias("error"))
    return own.unionByName(failed)


def first_samples(samples: DataFrame, limit: int, order: str = "sample_id") -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return samples.orderBy(order).limit(limit)


def run_verdict(runs: DataFrame) -> DataFrame:
    accuracy = F.col("accuracy")
    return runs.withColumn("verdict", (
        F.when(accuracy.isNull(), "none").when(accuracy >= 0.95, "stable").when(accuracy >= 0.85, "workable").otherwise("weak")
    ))


def list_runs(runs: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of the runs, newest first, each row with the ``total`` of all runs."""
    ordered = runs.orderBy(F.desc("started_at"), F.asc("run_id"))
    total = runs.agg(F.count("*").alias("total")).scalar()
    return ordered.offset(max(0, (page - 1) * per_page)).limit(per_page).withColumn("total", total)


def get_runs(runs: DataFrame, ids: list[str]) -> DataFrame:
    return runs.where(F.col("run_id").isin(ids))
