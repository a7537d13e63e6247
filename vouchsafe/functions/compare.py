"""Equality of expected and actual values, by field path."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.functions.text import has_name, normalize_name
from vouchsafe.settings import NAME_THRESHOLD

Comparator = Callable[[Column, Column], Column]


def similarity_ratio(left: str, right: str, seen: dict[tuple[str, str], float]) -> float:
    """Matching-blocks ratio of two normalized names, each distinct pair computed once."""
    if left == right:
        return 1.0
    known = seen.get((left, right))
    if known is None:
        known = seen[(left, right)] = SequenceMatcher(None, left, right).ratio()
    return known


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    return pd.Series([
        None if a is None or b is None else similarity_ratio(a, b, seen) for a, b in zip(left, right)
    ], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Ratio of the normalized names; equal names never leave the JVM as text, and names of one spelling need no normal form."""
    left, right = normalize_name(a), normalize_name(b)
    same = (a == b) | (left == right)
    scored = _ratio(F.when(~same, left), F.when(~same, right))
    return F.when(same, F.lit(1.0)).otherwise(scored)


def name_equal(a: Column, b: Column, threshold: float = NAME_THRESHOLD) -> Column:
    filled = has_name(a) & has_name(b)
    return F.coalesce(filled & (name_similarity(a, b) >= threshold), F.lit(False))


def decimal_equal(a: Column, b: Column) -> Column:
    """Numeric equality; text that is no number never equals anything."""
    return F.coalesce(a.try_cast("decimal(38,10)") == b.try_cast("decimal(38,10)"), F.lit(False))


def date_equal(a: Column, b: Column) -> Column:
    def parse(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))

    return F.coalesce(parse(a) == parse(b), F.lit(False))


def exact_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("string") == b.cast("string"), F.lit(False))


def default_comparators(threshold: float = NAME_THRESHOLD) -> dict[str, Comparator]:
    """Field path -> comparator; callers may replace or add entries."""

    def names(a: Column, b: Column) -> Column:
        return name_equal(a, b, threshold)

    return {
        **dict.fromkeys(fv.NAME_PATHS, names),
        **dict.fromkeys(fv.DECIMAL_PATHS, decimal_equal),
        **dict.fromkeys(fv.DATE_PATHS, date_equal),
    }


def compare_field(
    path: Column, a: Column, b: Column, comparators: Mapping[str, Comparator] | None = None,
) -> Column:
    """Pick the comparator by path; paths without an entry are compared exactly.

    Each comparator sees nulls on rows of other paths, so a Python one does no work there.
    """
    table = default_comparators() if comparators is None else comparators
    result = exact_equal(a, b)
    for compare in dict.fromkeys(table.values()):
        mine = path.isin([p for p, fn in table.items() if fn is compare])
        result = F.when(mine, compare(F.when(mine, a), F.when(mine, b))).otherwise(result)
    return result
