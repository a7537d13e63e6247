"""Columns that are called like an operator's own, repeated rows, and counts beyond a part."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import words
from vouchsafe.llm import exact_dedup, ngram_join, packing, pii
from vouchsafe.operators.rows import rank_within

OWN = {
    "exact": (exact_dedup.drop_exact_copies, ["_digest", "_doc_id", "_key", "digest", "row", "keep", "Kept"]),
    "near": (ngram_join.drop_near_copies, ["_text_key", "_doc_id", "_kept_key", "cls", "node", "_root", "token"]),
    "pii": (lambda d: pii.pseudonymise(d, "k"), ["_matches", "_marked", "_Marked2", "kind", "value"]),
}


@pytest.mark.parametrize("name", OWN)
def test_all_columns_come_back(spark, name):
    operator, names = OWN[name]
    rows = [(i, words(40, i % 3), *(f"{n}{i}" for n in names)) for i in range(6)] + [(None, None, *names)]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    done = operator(table)
    assert done.columns == table.columns
    found = [tuple(r) for r in done.collect()]
    assert set(found) <= set(rows) and len(found) == (7 if name == "pii" else 4)


@pytest.mark.parametrize("name", ["exact", "near"])
def test_which_of_repeated_rows_stays(spark, name):
    rows = [(1, words(30, 1), f"s{k}") for k in range(8)] + [(2, words(30, 2), "one")]
    kept = {
        tuple(tuple(r) for r in sorted(OWN[name][0](spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n)).collect()))
        for order, n in ((rows, 1), (rows[::-1], 4), (rows[3:] + rows[:3], 3))
    }
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_parts_follow_the_counts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    monkeypatch.setattr(packing, "PARTS", 1)
    pieces = spark.createDataFrame([(i, 0, 5) for i in range(40)] + [(i, 1, 3) for i in range(9)], "doc_id long, piece int, length long")
    found = packing.pack_pieces(pieces, 8).collect()
    assert Counter((r.doc_id, r.piece) for r in found) == Counter((r.doc_id, r.piece) for r in pieces.collect())
    places = Counter((r.sequence_id, r.offset) for r in found)
    assert max(places.values()) == 1 and len({r.sequence_id for r in found}) == 40


def test_ranks_are_long(spark):
    ranked = rank_within(spark.range(3), ["id"], F.lit(0), [F.col("id")], "rank")
    assert dict(ranked.dtypes)["rank"] == "bigint"
