"""The stages of the pipeline, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm import cases
from vouchsafe.llm.tables import table, written

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), name)
        found[name] = before.collect(), docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS

    before, after = found["good_documents"]
    kept = {r.doc_id for r in after}
    right = [(k in kept) == bool(q) for k, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    before, after = found["without_exact_copies"]
    last = {}
    for r in before:
        last[r.text.translate(cases.UPPER)] = max(r.doc_id, last.get(r.text.translate(cases.UPPER), -1))
    assert Counter(r.doc_id for r in after) == Counter(last.values())

    before, after = found["without_near_copies"]
    rows = sorted(before, key=lambda r: r.doc_id)
    sets = [cases.plain_shingles(r.text, 5) for r in rows]
    roots = cases.plain_components(sets, 80, 100)
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for k, r in enumerate(rows) if roots[k] == k)

    before, after = found["with_pseudonyms"]
    texts = {r.doc_id: r.text for r in before}
    assert Counter(r.doc_id for r in after) == Counter(list(texts))
    for r in after:
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id] or any(c.isdigit() or c == "@" for c in texts[r.doc_id]))

    before, after = found["packed_sequences"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert Counter(corpus_pipeline.run(spark, FOLDER).agg({"length": "sum"}).first()) == Counter([sum(r.length for r in after)])
