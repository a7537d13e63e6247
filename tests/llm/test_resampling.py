"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import UPPER, corpus, frame, words
from vouchsafe.llm import resampling


def plain(rows, target, longest, buckets, share, least, seed):
    def feats(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return ws, [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in rows for f in feats(t)[1])
    t = Counter(bucket(f) for x in target for f in feats(x)[1])
    s_all, t_all = s.total(), t.total()
    scored = []
    for n, (i, text) in enumerate(rows):
        ws, fs = feats(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(ws)])
    able = sorted((r for r in scored if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: len(able) * share[0] // share[1]]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in scored)


@pytest.mark.parametrize("longest,buckets,share", [(1, 10_000, (10, 100)), (3, 97, (1, 2)), (2, 1, (1, 1))])
def test_resample(spark, longest, buckets, share):
    rows = [*corpus(), (300, "..."), (301, "ÀÉ-x9\0y"), (302, " lead and tail ")]
    target = [words(200, 1), None, "", "w1 w2 Ünder"]
    found = resampling.resample(
        frame(spark, rows).withColumns({"score": F.lit(1), "rank": F.lit("r"), "_row": F.lit(2)}),
        spark.createDataFrame([(t,) for t in target], "text string"),
        longest=longest, buckets=buckets, share=share,
    )
    got = Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == plain(rows, target, longest, buckets, share, 20, 2024)


@pytest.mark.parametrize("most", [1, 500, 1 << 20])
def test_slices_change_nothing(most):
    import pyarrow as pa

    texts = pa.array([t or "" for _, t in corpus()] * 2)
    whole, cut = Counter(), Counter()
    for size, into in ((1 << 30, whole), (most, cut)):
        for first, part in resampling.slices(texts.slice(3), size):
            before, found = resampling.features(part, 2, 1000)
            for k, (at, starts) in enumerate(found):
                owner = [d for d in range(len(part)) for _ in range(before[d + 1] - before[d])]
                into.update((first + d, k, b) for d, b, ok in zip(owner, at.tolist(), starts.tolist()) if ok)
    assert whole == cut


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).count() == 0
    found = resampling.resample(frame(spark, [(1, words(30, 1)), (2, None)]), target, share=(1, 1)).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in found} == {(1, 30, 1), (2, 0, None)}
