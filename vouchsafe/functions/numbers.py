"""Money, confidence, differences, and amounts or dates in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.text import strip

CONFIDENCE_SLACK = 1e-12


def dec(text: str, precision: int, scale: int) -> Column:
    return F.lit(text).cast(f"decimal({precision},{scale})")


def rounding_tolerance(components: Column) -> Column:
    """Half a cent per independently rounded component, rounded up to a whole cent."""
    cents = F.floor((F.greatest(components, F.lit(1)) + 1) / 2).cast("decimal(16,0)")
    return (cents * dec("0.01", 3, 2)).cast("decimal(18,2)")


def half_even(c: Column, scale: int) -> Column:
    return F.bround(c, scale)


def rate_percent(c: Column) -> Column:
    """Text VAT rate as a percentage; the no-VAT marker counts as zero."""
    return F.when(c == "without_vat", dec("0", 5, 2)).otherwise(c.try_cast("decimal(5,2)"))


def snap_confidence(c: Column) -> Column:
    """Undo float noise at the borders of [0, 1]; anything further out is left as it is."""
    return (
        F.when((c > 1.0) & (c <= 1.0 + CONFIDENCE_SLACK), F.lit(1.0))
        .when((c < 0.0) & (c >= -CONFIDENCE_SLACK), F.lit(0.0))
        .otherwise(c)
    )


def confidence_bucket(c: Column) -> Column:
    return (
        F.when(c.isNull(), "none").when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")
    )


def delta(current: Column, previous: Column, *, kind: str = "percent", higher_is_better: bool = True) -> Column:
    """Struct of difference, ratio to the previous size and tone; null-safe."""
    missing = current.isNull() | previous.isNull()
    ratio = F.when(previous != 0, F.try_divide(current - previous, F.abs(previous)))
    diff = ratio if kind == "relative" else current - previous
    better = diff > 0 if higher_is_better else diff < 0
    tone = (
        F.when(diff.isNull() | (F.abs(diff) < 1e-9), "neutral").when(better, "success").otherwise("danger")
    )
    return F.struct(
        F.when(~missing, diff).alias("diff"),
        F.when(~missing & ~(F.lit(kind == "relative") & (previous == 0)), ratio).alias("ratio"),
        F.when(missing, "neutral").otherwise(tone).alias("tone"),
    )


def _word(words: Sequence[str], index: Column) -> Column:
    return F.nullif(F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int")), F.lit(""))


def _plural(value: Column, forms: Sequence[str]) -> Column:
    tail, last = value % 100, value % 10
    return (
        F.when(tail.between(11, 19), forms[2])
        .when(last == 1, forms[0])
        .when(last.between(2, 4), forms[1])
        .otherwise(forms[2])
    )


def _below_thousand(value: Column, ones: Sequence[str]) -> list[Column]:
    rest = value % 100
    teen = rest.between(10, 19)
    return [
        _word(fv.HUNDREDS, F.floor(value / 100)),
        F.when(teen, _word(fv.TEENS, F.greatest(rest - 10, F.lit(0)) % 10)),
        F.when(~teen, _word(fv.TENS, F.floor(rest / 10))),
        F.when(~teen, _word(ones, rest % 10)),
    ]


def integer_in_words(c: Column) -> Column:
    """Cardinal of a non-negative whole number below 10^12; null beyond."""
    pieces: list[Column] = []
    for power, forms in reversed(list(enumerate(fv.SCALES, start=1))):
        group = F.floor(c / 10 ** (3 * power)) % 1000
        ones = fv.UNITS_FEMININE if power == 1 else fv.UNITS_MASCULINE
        pieces += [F.when(group > 0, p) for p in [*_below_thousand(group, ones), _plural(group, forms)]]
    pieces += _below_thousand(c % 1000, fv.UNITS_MASCULINE)
    return F.when(c == 0, fv.ZERO_WORD).when((c > 0) & (c < 10**12), F.concat_ws(" ", *pieces))


def amount_in_words(c: Column) -> Column:
    """Roubles in words and kopeks in two digits."""
    amount = F.bround(c.cast("decimal(18,2)"), 2)
    size = F.abs(amount)
    roubles = F.floor(size).cast("bigint")
    kopeks = ((size - roubles) * 100).cast("int")
    words = integer_in_words(roubles)
    capital = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    return F.concat(
        F.when(amount < 0, "минус ").otherwise(""), capital, F.lit(" рублей "),
        F.lpad(kopeks.cast("string"), 2, "0"), F.lit(" копеек"),
    )


def russian_date(c: Column) -> Column:
    """``«d» month yyyy г.``; text that is no ISO date is returned as it is, null as ''."""
    text = strip(c.cast("string"))
    day = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"),
                 F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    months = F.array(*[F.lit(m) for m in fv.MONTHS_GENITIVE])
    written = F.concat(
        F.lit("«"), F.day(day).cast("string"), F.lit("» "), F.element_at(months, F.month(day)),
        F.lit(" "), F.year(day).cast("string"), F.lit(" г."),
    )
    return F.coalesce(written, c.cast("string"), F.lit(""))
