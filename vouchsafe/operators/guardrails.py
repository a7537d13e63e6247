"""Consistency rules over extracted documents.

A rule is an expression on the document row that yields a list of violations, so the whole rule
set runs in one scan without any exchange, however many lines or documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.functions.identifiers import inn_valid
from vouchsafe.functions.numbers import dec, half_even, rate_percent, rounding_tolerance
from vouchsafe.functions.text import party_key
from vouchsafe.operators.fields import scalar_pointer
from vouchsafe.operators.rows import cut, once, rows_of
from vouchsafe.schemas import LINE_TYPES, PARTIES, SCALAR_TYPES, VIOLATION
from vouchsafe.settings import GuardrailSettings

Rule = Callable[[GuardrailSettings], Column]
VIOLATIONS = T.ArrayType(VIOLATION)
_SUM = "decimal(28,2)"


def _violation(rule: str, path: Column, message: Column, expected: Column, actual: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        path.alias("field_path"),
        message.alias("message"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
    )


def _only_if(condition: Column, violation: Column) -> Column:
    """List of one violation, or an empty list (also when the condition is unknown)."""
    return F.when(condition, F.array(violation)).otherwise(F.array().cast(VIOLATIONS))


def _total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast(_SUM), lambda acc, x: (acc + x).cast(_SUM))


def total_rule(settings: GuardrailSettings) -> Column:
    """Total against line amounts plus VAT; skipped when any of them is missing."""
    total, vat, lines = F.col("total_amount.value"), F.col("vat_amount.value"), F.col("line_items")
    amounts = F.transform(lines, lambda x: x["amount"]["value"])
    known = (F.size(lines) > 0) & ~F.exists(amounts, lambda a: a.isNull())
    expected = _total_of(amounts)
    if settings.amount_basis == "net":
        expected = (expected + vat).cast(_SUM)
    tolerance = rounding_tolerance(F.size(lines) + 2)
    return _only_if(
        known & vat.isNotNull() & (F.abs(total - expected) > tolerance),
        _violation(
            "total_mismatch", F.lit("/total_amount"),
            F.concat(F.lit(fv.MESSAGE_TOTAL), tolerance.cast("string")), expected, total,
        ),
    )


def _line_rate(item: Column) -> tuple[Column, Column]:
    rate = rate_percent(item["vat_rate"]["value"])
    return rate, F.coalesce(rate.isin(0, 10, 20), F.lit(False))


def _rate_violation(item: Column, index: Column) -> Column:
    path = F.concat(F.lit("/line_items/"), index.cast("string"), F.lit("/vat_rate"))
    return _violation(
        "vat_rate_mismatch", path, F.lit(fv.MESSAGE_RATE), F.lit(fv.EXPECTED_RATES), item["vat_rate"]["value"],
    )


def _line_vat_expected(item: Column) -> Column:
    rate, _ = _line_rate(item)
    return half_even(item["amount"]["value"] * rate * dec("0.01", 3, 2), 2).cast("decimal(18,2)")


def _line_violation(item: Column, index: Column) -> Column:
    path = F.concat(F.lit("/line_items/"), index.cast("string"), F.lit("/vat_amount"))
    return _violation(
        "vat_rate_mismatch", path, F.lit(fv.MESSAGE_LINE_VAT), _line_vat_expected(item), item["vat_amount"]["value"],
    )


def _rate_is_illegal(item: Column) -> Column:
    return item["vat_rate"]["value"].isNotNull() & ~_line_rate(item)[1]


def _line_is_checked(item: Column) -> Column:
    return _line_rate(item)[1] & item["amount"]["value"].isNotNull() & item["vat_amount"]["value"].isNotNull()


def _line_is_off(item: Column) -> Column:
    off = F.abs(item["vat_amount"]["value"] - _line_vat_expected(item)) > dec("0.01", 3, 2)
    return F.coalesce(_line_is_checked(item) & off, F.lit(False))


def _per_line(pick: Callable[[Column, Column], Column]) -> Column:
    found = F.array_compact(F.transform("line_items", pick))
    return F.coalesce(found, F.array().cast(VIOLATIONS))


def vat_rate_rule(settings: GuardrailSettings) -> Column:
    return _per_line(lambda x, i: F.when(_rate_is_illegal(x), _rate_violation(x, i)))


def vat_line_rule(settings: GuardrailSettings) -> Column:
    return _per_line(lambda x, i: F.when(_line_is_off(x), _line_violation(x, i)))


def vat_total_rule(settings: GuardrailSettings) -> Column:
    """Document VAT against the lines with legal rate, amount and VAT (wrong ones included)."""
    checked = F.filter("line_items", _line_is_checked)
    expected = _total_of(F.transform(checked, lambda x: x["vat_amount"]["value"]))
    actual = F.col("vat_amount.value")
    return _only_if(
        (F.size(checked) > 0) & (F.abs(actual - expected) > rounding_tolerance(F.size(checked) + 1)),
        _violation("vat_rate_mismatch", F.lit("/vat_amount"), F.lit(fv.MESSAGE_DOCUMENT_VAT), expected, actual),
    )


def vat_rule(settings: GuardrailSettings) -> Column:
    """Rate and line checks interleaved in line order, then the document VAT."""
    lines = _per_line(
        lambda x, i: F.when(_rate_is_illegal(x), _rate_violation(x, i)).when(_line_is_off(x), _line_violation(x, i))
    )
    return F.concat(lines, vat_total_rule(settings))


def inn_rule(settings: GuardrailSettings) -> Column:
    checks = [
        _only_if(
            ~inn_valid(f"{party}.inn.value"),
            _violation("invalid_inn", F.lit(f"/{party}/inn"), F.lit(fv.MESSAGE_INN), F.lit(None), F.col(f"{party}.inn.value")),
        )
        for party in PARTIES
    ]
    return F.concat(*checks)


def parties_rule(settings: GuardrailSettings) -> Column:
    same_inn = F.coalesce(F.col("supplier.inn.value") == F.col("buyer.inn.value"), F.lit(False))
    same_name = F.coalesce(
        party_key(F.col("supplier.name.value")) == party_key(F.col("buyer.name.value")), F.lit(False),
    )
    return _only_if(
        same_inn | same_name,
        _violation(
            "same_parties", F.lit("/buyer"), F.lit(fv.MESSAGE_PARTIES), F.lit(fv.EXPECTED_PARTIES),
            F.when(same_inn, fv.SAME_INN).otherwise(fv.SAME_NAME),
        ),
    )


def date_rule(settings: GuardrailSettings) -> Column:
    day = F.col("date.value")
    today = F.lit(settings.today)
    first, last = F.date_sub(today, settings.max_age_days), F.date_add(today, settings.future_days)
    return _only_if(
        ~day.between(first, last),
        _violation(
            "document_date_out_of_range", F.lit("/date"), F.lit(fv.MESSAGE_DATE),
            F.concat(first.cast("string"), F.lit(".."), last.cast("string")), day,
        ),
    )


def confidence_rule(settings: GuardrailSettings) -> Column:
    """Filled fields below the threshold; the violation is only built for the few that are."""
    threshold = settings.confidence_threshold

    def weak(field: str, path: str) -> str:
        return (
            f"CASE WHEN {field}.value IS NOT NULL AND {field}.confidence < {threshold}D THEN named_struct("
            f"'rule', 'low_confidence', 'field_path', {path}, 'message', '{fv.MESSAGE_CONFIDENCE}{threshold:.2f}', "
            f"'expected', CAST({threshold}D AS STRING), 'actual', CAST({field}.confidence AS STRING)) END"
        )

    scalars = ", ".join(weak(p, f"'{scalar_pointer(p)}'") for p in SCALAR_TYPES)
    members = ", ".join(weak(f"x.{n}", f"concat('/line_items/', i, '/{n}')") for n in LINE_TYPES)
    lines = f"flatten(transform(line_items, (x, i) -> array_compact(array({members}))))"
    return F.expr(
        f"concat(array_compact(array({scalars})), coalesce({lines}, CAST(array() AS {VIOLATIONS.simpleString()})))")


# evaluation order of the built-in set; callers may pass their own
DEFAULT_RULES: dict[str, Rule] = {
    "total": total_rule,
    "vat": vat_rule,
    "inn": inn_rule,
    "parties": parties_rule,
    "date": date_rule,
    "confidence": confidence_rule,
}


def is_blocking(rule: Column) -> Column:
    return rule.isin(*fv.BLOCKING_RULES)


def violations_of(docs: DataFrame, rule: Rule, settings: GuardrailSettings) -> DataFrame:
    """Violations of a single rule, one row each."""
    return mark_blocking(rows_of(docs, ["doc_id"], rule(settings)))


def mark_blocking(violations: DataFrame) -> DataFrame:
    return violations.withColumn("blocking", is_blocking(F.col("rule")))


def _rule_list(rules: Mapping[str, Rule] | Sequence[Rule] | None) -> list[Rule]:
    if rules is None:
        rules = DEFAULT_RULES
    return list(rules.values()) if isinstance(rules, Mapping) else list(rules)


def with_violations(
    docs: DataFrame, settings: GuardrailSettings, rules: Mapping[str, Rule] | Sequence[Rule] | None = None,
) -> DataFrame:
    """Document rows plus their ordered violation list and its summary flags."""
    found = F.concat(*[rule(settings) for rule in _rule_list(rules)])
    blocking = F.exists("violations", lambda v: is_blocking(v["rule"]))
    return (
        once(docs, violations=found)
        .withColumn("requires_review", F.size("violations") > 0)
        .withColumn("has_warnings", (F.size("violations") > 0) & ~blocking)
    )


def evaluate_guardrails(
    docs: DataFrame, settings: GuardrailSettings, rules: Mapping[str, Rule] | Sequence[Rule] | None = None,
) -> DataFrame:
    """All violations of the rule set; ``position`` is their order inside the document."""
    return mark_blocking(rows_of(with_violations(docs, settings, rules), ["doc_id"], "violations", "position"))


def guardrail_summary(
    docs: DataFrame, settings: GuardrailSettings, rules: Mapping[str, Rule] | Sequence[Rule] | None = None,
) -> DataFrame:
    return with_violations(docs, settings, rules).select(
        "doc_id", F.size("violations").alias("n_violations"), "requires_review", "has_warnings",
    )


def make_review_tasks(violations: DataFrame, *, path_width: int | None = None, reason_width: int | None = None) -> DataFrame:
    """One pending task per violation; such tasks carry the message, not the rule code."""
    return violations.select(
        "doc_id",
        cut(F.col("field_path"), path_width).alias("field_path"),
        cut(F.col("message"), reason_width).alias("reason"),
        F.lit("pending").alias("status"),
        F.col("actual").alias("original_value"),
    )


def route_documents(docs: DataFrame, settings: GuardrailSettings) -> DataFrame:
    """Next status and the document type found in the result."""
    return with_violations(docs, settings).select(
        "doc_id",
        F.col("document_type.value").alias("detected_type"),
        F.when(F.col("requires_review"), "review_required").otherwise("completed").alias("status"),
    )


def rule_label(reason: Column, path: Column) -> Column:
    """Label of the first rule code found in the reason, else the field path."""
    label = F.coalesce(F.nullif(path, F.lit("")), F.lit("—"))
    for code, text in reversed(fv.RULE_LABELS.items()):
        label = F.when(reason.contains(code), F.lit(text)).otherwise(label)
    return label


def violation_stats(tasks: DataFrame) -> DataFrame:
    """Tasks per rule label; resolved and rejected ones count as passed."""
    return (
        tasks.groupBy(rule_label(F.coalesce("reason", F.lit("")), F.col("field_path")).alias("label"))
        .agg(
            F.count("*").alias("n_tasks"),
            F.count_if(F.col("status").isin("resolved", "rejected")).alias("n_passed"),
        )
    )
