import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchsafe.functions import identifiers as ids
from vouchsafe.functions import numbers as nm
from vouchsafe.functions import text as tx
from vouchsafe.functions.assignment import best_assignment
from vouchsafe.functions.compare import decimal_equal, name_similarity


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_evidence_text(spark):
    got = values(spark, tx.normalize_evidence_text(F.col("c")), ["69 564,00", "ООО «Ромашка»", "МИНУС−143", "a b c"])
    assert got == ["69564.00", "оооромашка", "минус-143", "abc"]


def test_value_variants(spark):
    got = values(spark, tx.value_variants(F.col("c")), ["2025-03-02", "69564.00", "10.50", " x ", "", "true"])
    assert got == [["2025-03-02", "02.03.2025", "2.3.2025"], ["69564.00", "69564", "69564"], ["10.50", "10.5", "10"], ["x"], [], []]


def test_inn(spark):
    got = values(spark, ids.inn_valid("c"), ["7707083893", "7707083894", "500100732259", "123", None])
    assert got == [True, False, True, False, None]


def test_currency_and_kpp(spark):
    assert values(spark, ids.normalize_currency(F.col("c")), ["Руб.", " $ ", "gbp"]) == ["RUB", "USD", "GBP"]
    assert values(spark, ids.fix_kpp(F.col("c")), ["1027700132195", "770701001"]) == [None, "770701001"]


def test_sample_key(spark):
    key = ids.sample_key(F.lit("accounting"), F.lit("v1"), F.col("c"))
    assert values(spark, key, ["doc_01"]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "accounting:v1:doc_01"))]


def test_suffix(spark):
    assert values(spark, ids.file_suffix(F.col("c")), ["a/b.PDF", "x.tar.gz", "plain", ".hidden"]) == [".pdf", ".gz", "", ""]


@pytest.mark.parametrize("amount,words", [
    ("0.00", "Ноль рублей 00 копеек"),
    ("69564.00", "Шестьдесят девять тысяч пятьсот шестьдесят четыре рублей 00 копеек"),
    ("2001.05", "Две тысячи один рублей 05 копеек"),
    ("1000000.11", "Один миллион рублей 11 копеек"),
    ("-15.10", "минус Пятнадцать рублей 10 копеек"),
    ("12011000.00", "Двенадцать миллионов одиннадцать тысяч рублей 00 копеек"),
])
def test_amount_in_words(spark, amount, words):
    assert values(spark, nm.amount_in_words(F.col("c")), [amount]) == [words]


def test_dates_in_words(spark):
    assert values(spark, nm.russian_date(F.col("c")), ["2026-07-25", "скоро", None]) == ["«25» июля 2026 г.", "скоро", ""]


def test_confidence(spark):
    got = values(spark, nm.snap_confidence(F.col("c")), [1.0000000000000002, 1.01, -1e-13, 0.5], "double")
    assert got == [1.0, 1.01, 0.0, 0.5]
    assert values(spark, nm.confidence_bucket(F.col("c")), [0.9, 0.7, 0.69, None], "double") == ["high", "medium", "low", "none"]


def test_tolerance(spark):
    got = values(spark, nm.rounding_tolerance(F.col("c")), [0, 1, 2, 3, 4], "int")
    assert [str(v) for v in got] == ["0.01", "0.01", "0.01", "0.02", "0.02"]


def test_names_and_decimals(spark):
    pairs = spark.createDataFrame([("«Ромашка»", "Ромашка"), ("abcd", "bcde"), (None, "x")], "a string, b string")
    got = [r.x for r in pairs.select(name_similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [1.0, 0.75, None]
    assert values(spark, decimal_equal(F.col("c"), F.col("c")), ["1.0", "without_vat"]) == [True, False]


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(120):
        rows, cols = rng.integers(1, 6, 2)
        weights = np.round(rng.random((rows, cols)), 1)
        pairs = best_assignment(weights)
        assert len(pairs) == min(rows, cols) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        wide = weights if rows <= cols else weights.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(weights[i, j] for i, j in pairs) - best) < 1e-9
