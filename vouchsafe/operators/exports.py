"""Export tables of completed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.identifiers import literal_map
from vouchsafe.functions.numbers import amount_in_words, dec, russian_date
from vouchsafe.operators.guardrails import rule_label
from vouchsafe.operators.rows import let, rows_of

MONEY = "decimal(18,2)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def completed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status") == "completed")


def _zero(c: Column) -> Column:
    return F.coalesce(c, dec("0", 18, 2))


def line_total(amount: Column, vat: Column, total: Column | None = None) -> Column:
    """Own total of the line, else amount plus VAT, null only when both are missing."""
    summed = F.when(amount.isNotNull() | vat.isNotNull(), (_zero(amount) + _zero(vat)).cast(MONEY))
    return summed if total is None else F.coalesce(total, summed)


def item_value(item: Column, *names: str) -> Column:
    """Value of a loose line (map of text) under the first of its names that is there, even if that is null."""
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(F.map_contains_key(item, name), F.try_element_at(item, F.lit(name))).otherwise(found)
    return found


def loose_line(item: Column) -> Column:
    """A loose line in typed form: other names are understood, text that is no number is none, ``total`` is its own."""
    number = lambda n, kind: item_value(item, *fv.LINE_NAMES[n]).try_cast(kind)
    text = lambda n: item_value(item, *fv.LINE_NAMES[n])
    return F.struct(
        text("name").alias("name"), text("unit").alias("unit"), number("quantity", "decimal(18,6)").alias("quantity"),
        number("unit_price", MONEY).alias("unit_price"), number("amount", MONEY).alias("amount"), text("vat_rate").alias("vat_rate"),
        number("vat_amount", MONEY).alias("vat_amount"), number("total", MONEY).alias("total"),
    )


def loose_positions(docs: DataFrame, items: str = "items") -> DataFrame:
    """As ``export_positions``, for lines that come as maps of text, with their own totals where they have one."""

    def row(x: Column, i: Column) -> Column:
        return let(loose_line(x), lambda v: F.struct(
            (i + 1).alias("no"), *[v[n].alias(n) for n in ("name", "unit", "quantity", "unit_price", "amount")],
            rate_fraction(v["vat_rate"]).alias("vat_fraction"), F.when(v["vat_rate"] == "without_vat", fv.WITHOUT_VAT_LABEL).alias("vat_label"),
            v["vat_amount"].alias("vat_amount"), line_total(v["amount"], v["vat_amount"], v["total"]).alias("total"),
        ))

    return rows_of(completed(docs), ["doc_id"], F.transform(items, row))


def loose_totals(docs: DataFrame, items: str = "items") -> DataFrame:
    """Sums of loose lines: net amounts, VAT, and totals, each line's own before the derived one."""
    return completed(docs).withColumn("_v", F.transform(items, loose_line)).select(
        "doc_id",
        _sum_lines(F.transform("_v", lambda v: v["amount"])).alias("subtotal"),
        _sum_lines(F.transform("_v", lambda v: v["vat_amount"])).alias("vat_total"),
        _sum_lines(F.transform("_v", lambda v: line_total(v["amount"], v["vat_amount"], v["total"]))).alias("grand_total"),
    )


def rate_fraction(rate: Column) -> Column:
    number = rate.try_cast("decimal(9,4)")
    return F.when(number > 1, (number * dec("0.01", 3, 2)).cast("decimal(9,4)")).otherwise(number)


def export_positions(docs: DataFrame) -> DataFrame:
    """Numbered line items with totals; the rate as a fraction or the no-VAT label."""

    def row(x: Column, i: Column) -> Column:
        value = lambda n: x[n]["value"]
        return F.struct(
            (i + 1).alias("no"), value("name").alias("name"), value("unit").alias("unit"),
            value("quantity").alias("quantity"), value("unit_price").alias("unit_price"),
            value("amount").alias("amount"), rate_fraction(value("vat_rate")).alias("vat_fraction"),
            F.when(value("vat_rate") == "without_vat", fv.WITHOUT_VAT_LABEL).alias("vat_label"),
            value("vat_amount").alias("vat_amount"),
            line_total(value("amount"), value("vat_amount")).alias("total"),
        )

    return rows_of(completed(docs), ["doc_id"], F.transform("line_items", row))


def _sum_lines(of: Column) -> Column:
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(of, zero, lambda acc, x: (acc + _zero(x)).cast("decimal(28,2)")).cast(MONEY)


def total_columns() -> dict[str, Column]:
    lines = F.col("line_items")
    amounts = F.transform(lines, lambda x: x["amount"]["value"])
    vats = F.transform(lines, lambda x: x["vat_amount"]["value"])
    totals = F.transform(lines, lambda x: line_total(x["amount"]["value"], x["vat_amount"]["value"]))
    has_lines = F.coalesce(F.size(lines), F.lit(0)) > 0
    total, vat = _zero(F.col("total_amount.value")), _zero(F.col("vat_amount.value"))
    return {
        "subtotal": F.when(has_lines, _sum_lines(amounts)).otherwise((total - vat).cast(MONEY)),
        "vat_total": F.when(has_lines, _sum_lines(vats)).otherwise(vat),
        "grand_total": F.when(has_lines, _sum_lines(totals)).otherwise(total),
    }


def export_totals(docs: DataFrame) -> DataFrame:
    """Sums of the lines; a document without lines shows its own fields."""
    columns = total_columns()
    return completed(docs).select(
        "doc_id", *[c.alias(n) for n, c in columns.items()],
    ).withColumn("in_words", amount_in_words(F.col("grand_total")))


def _party_details(party: str) -> Column:
    inn, kpp = F.nullif(F.col(f"{party}.inn.value"), F.lit("")), F.nullif(F.col(f"{party}.kpp.value"), F.lit(""))
    return F.concat_ws("    ", F.concat(F.lit("ИНН "), inn), F.concat(F.lit("КПП "), kpp))


def export_header(docs: DataFrame, tasks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Title, party lines, number of lines and corrections, and whether every check passed.

    ``tasks`` (doc_id, status) and ``corrections`` (doc_id) are counted per document first.
    """
    checks = tasks.groupBy("doc_id").agg(F.bool_and(F.col("status").isin("resolved", "rejected")).alias("_passed"))
    fixed = corrections.groupBy("doc_id").agg(F.count("*").alias("_fixed"))
    rows = completed(docs).join(checks, "doc_id", "left").join(fixed, "doc_id", "left")
    kind = _lookup(fv.EXPORT_TYPE_LABELS, F.col("document_type.value"))
    number = F.coalesce(F.col("number.value"), F.lit(""))
    date = russian_date(F.col("date.value"))
    title = F.concat(
        F.coalesce(kind, F.lit(fv.EXPORT_DEFAULT_TYPE)),
        F.when(number != "", F.concat(F.lit(" № "), number)).otherwise(""),
        F.when(date != "", F.concat(F.lit(" от "), date)).otherwise(""),
    )
    return rows.select(
        "doc_id", title.alias("title"),
        F.coalesce(F.col("supplier.name.value"), F.lit("")).alias("supplier_name"), _party_details("supplier").alias("supplier_details"),
        F.coalesce(F.col("buyer.name.value"), F.lit("")).alias("buyer_name"), _party_details("buyer").alias("buyer_details"),
        F.size("line_items").alias("n_lines"),
        F.coalesce("_fixed", F.lit(0)).alias("n_corrected"),
        F.coalesce("_passed", F.lit(True)).alias("all_passed"),
    )


def export_review_log(diff: DataFrame) -> DataFrame:
    """Model value, final value and confidence of every scalar field."""
    return diff.select(
        "doc_id", F.col("label").alias("field"), F.coalesce("original_value", F.lit("")).alias("model_value"),
        F.coalesce("value", F.lit("")).alias("final_value"), "confidence",
        F.when(F.col("corrected"), fv.CHANGED_LABEL).otherwise(fv.UNCHANGED_LABEL).alias("state"), "path",
    )


def export_guardrail_log(tasks: DataFrame) -> DataFrame:
    """Distinct checks of each document with outcome, explanation and path."""
    reason = F.coalesce("reason", F.lit(""))
    checks = tasks.select(
        "doc_id", rule_label(reason, F.col("field_path")).alias("rule"),
        F.col("status").isin("resolved", "rejected").alias("passed"),
        F.regexp_replace(F.concat(F.col("field_path"), F.lit(": "), reason), "^[: ]+|[: ]+$", "").alias("message"),
    ).dropDuplicates(["doc_id", "rule", "passed", "message"])
    first = F.split_part("message", F.lit(":"), F.lit(1))
    path = F.when(F.col("rule").startswith("/"), F.col("rule")).when(first.startswith("/"), first).otherwise("")
    after = F.trim(F.regexp_extract("message", "(?s)^[^:]*:(.*)$", 1))
    label = _lookup(fv.EXPORT_FIELD_LABELS, path)
    return checks.select(
        "doc_id",
        F.coalesce(label, F.nullif("rule", F.lit("")), path).alias("check"),
        F.when(F.col("passed"), fv.PASSED_LABEL).otherwise(fv.ATTENTION_LABEL).alias("outcome"),
        F.when(F.col("message").contains(":"), after).otherwise(F.col("message")).alias("explanation"),
        path.alias("path"),
    )
