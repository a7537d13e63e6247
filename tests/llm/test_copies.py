"""Exact copies, near copies and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.cases import corpus, frame
from vouchsafe.llm import exact_dedup, ngram_join, suffix_dedup
from vouchsafe.llm.graph import components
from vouchsafe.llm.tables import kept_rows


def expected_copies(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(cases.UPPER), []).append(key)
    out = Counter()
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        for k in keys:
            out[k, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup(spark, counters):
    rows = corpus()
    found = exact_dedup.exact_dedup(frame(spark, rows), counters).collect()
    expected, groups = expected_copies(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0)).count() == 0
    twice = frame(spark, [(1, "a"), (1, "A"), (1, "b"), (2, "b")])
    found = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(twice).collect())
    assert found == Counter({(1, 1, True): 1, (1, 1, False): 1, (1, 2, False): 1, (2, 2, True): 1})
    docs = frame(spark, corpus())
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == expected_copies(corpus())[1]


def test_heavy_digests_are_those_above_the_share(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    slim = exact_dedup.exact_dedup(frame(spark, rows), 8).where("group_size > 75").select("text_sha256").distinct()
    assert slim.count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_components(spark, n, num, den):
    rows = [r for r in corpus() if r[0] is not None]
    rng = random.Random(n)
    base = cases.words(120, 20).split(" ")
    for k in range(60):  # a chain of near copies around the limit
        base[rng.randrange(120)] = f"v{k}"
        rows.append((1000 + k, " ".join(base)))
    rows.sort(key=lambda r: r[0])
    sets = [cases.plain_shingles(t, n) for _, t in rows]
    roots = cases.plain_components(sets, num, den)
    found = ngram_join.ngram_components(frame(spark, rows), n, num, den).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(
        (i, len(s), rows[root][0]) for (i, _), s, root in zip(rows, sets, roots)
    )
    kept = Counter(r.component_id for r in found if r.kept and r.n_shingles)
    assert kept == Counter(rows[root][0] for root in {r for r, s in zip(roots, sets) if s})


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(frame(spark, []).limit(0)).count() == 0
    found = ngram_join.ngram_components(frame(spark, corpus())).collect()  # null doc_ids and repeated doc_ids
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in corpus())
    assert [r.component_id for r in found if r.doc_id == 17] == [16]
    docs = frame(spark, corpus())
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    sets = [cases.plain_shingles(t, 5) for t in texts]
    assert len(set(cases.plain_components(sets, 80, 100))) == len(sets)
    assert Counter(r.doc_id for r in left.collect())[16] == 2


def test_group_of_near_copies_is_not_paired(spark, monkeypatch):
    rng = random.Random(11)
    base, rows = cases.words(150, 40).split(" "), []
    for k in range(240):  # one to six changes; most reach the middle of the group, few each other directly
        text = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            text[at] = rng.choice(["", f"new{rng.randrange(40)}"])
        rows.append((k, " ".join(text)))
    paired, written = [], ngram_join.written

    def counted(df, label):
        out = written(df, label)
        if label == "ngram-across":
            paired.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    found = ngram_join.ngram_components(frame(spark, rows), 5, 80, 100).collect()
    roots = cases.plain_components([cases.plain_shingles(t, 5) for _, t in rows], 80, 100)
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(roots))
    assert 5 < len(set(roots)) < 120 and paired[0] < 2 * len(rows)


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for size in (5, 100, 3000):
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, n, dtype=np.uint64)]) for n in (size // 5, size // 7))
        flipped = np.unpackbits((ngram_join._sketch_of(a) ^ ngram_join._sketch_of(b)).view(np.uint8)).sum()
        assert 0 < flipped <= size // 5 + size // 7 or size == 5


def check_cover(rows, found, least):
    covers = cases.plain_cover([(t or "").encode() for _, t in rows], least)
    expected = Counter()
    for (key, text), hit in zip(rows, covers):
        raw = (text or "").encode()
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        expected[key, len(raw), sum(hit), spans, kept] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == expected


@pytest.mark.parametrize("least, large", [(400, 2048), (100, 2048), (100, 1), (9, 3)])
def test_every_repeated_string(spark, monkeypatch, least, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    rows = [r for r in corpus() if r[0] not in (None, 13)]
    rows += [(300 + k, cases.words(20, 30 + k) + " " + cases.words(60, 99) + " " + cases.words(20, 60 + k)) for k in range(12)]
    check_cover(rows, suffix_dedup.remove_repeats(frame(spark, rows), least, keep_first=False).collect(), least)


def test_groups_of_many_bytes_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_BYTES", 3000)
    counted, taken = suffix_dedup._counted, []

    def seen(pieces, *rest):
        taken.append({r.h: (r.n, r.size) for r in pieces.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("size")).collect()})
        return counted(pieces, *rest)

    monkeypatch.setattr(suffix_dedup, "_counted", seen)
    rows = [(k, cases.words(20, 30 + k) + " " + cases.words(90, 99) + " " + cases.words(20, 60 + k)) for k in range(12)]
    rows += [(20, cases.words(200, 7)), (21, "x" + cases.words(200, 7)), (22, "ab" * 700)]
    check_cover(rows, suffix_dedup.remove_repeats(frame(spark, rows), 200, keep_first=False).collect(), 200)
    assert taken[0] and all(size > 3000 and n < suffix_dedup.LARGE_GROUP for n, size in taken[0].values())


def test_counted_strings_in_a_row_are_one_range(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", 1)
    same = cases.words(300, 99)
    rows = [(k, cases.words(20, 30 + k) + " " + same) for k in range(6)] + [(None, "x " + same), (6, same), (6, same)]
    found = suffix_dedup.repeated_ranges(frame(spark, rows), 200, keep_first=False).groupBy("doc_id").count().collect()
    assert len(found) == 8 and all(r["count"] < len(same) // 20 for r in found)
    check_cover(rows, suffix_dedup.remove_repeats(frame(spark, rows), 200, keep_first=False).collect(), 200)
    firsts = suffix_dedup.remove_repeats(frame(spark, [r for r in rows if r[0] is not None]), 200).collect()
    assert {r.doc_id for r in firsts if not r.n_removed} == {0} and all(r.n_removed >= len(same) for r in firsts if r.doc_id)


def peak_mb(run) -> float:
    """MB that Python and numpy hold at most while the batches of ``run()`` are taken and dropped."""
    tracemalloc.start()
    try:
        for _ in run():
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_sorts_is_bounded():
    rng = np.random.default_rng(4)
    letters = rng.integers(97, 123, 9_000_000, dtype=np.uint8).tobytes()
    rows = [(k // 2, k, k, 5, letters[k * 3000 : k * 3000 + 2500] if k % 2 == 0 else b"Y" + letters[k * 3000 - 2000 : k * 3000]) for k in range(3000)]
    names = ["h", "doc_id", "text_key", "start", "data"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    found = []

    def run():
        for out in suffix_dedup._sort_bundles(400, False)(batch.slice(k, 100) for k in range(0, 3000, 100)):
            found.extend(zip(*(c.to_pylist() for c in out.columns)))
            yield

    assert peak_mb(run) < 120
    # the even row's bytes 1000 to 2500 stand in the odd one from its second byte on
    assert found == [(k, k, 1005, 2505) if k % 2 == 0 else (k, k, 6, 1506) for k in range(3000)]


def test_memory_of_texts_is_bounded():
    text = np.random.default_rng(5).integers(97, 123, 4_000_000, dtype=np.uint8)
    assert peak_mb(lambda: suffix_dedup.contexts(text, 400)) < 60
    raw = text.tobytes().decode()
    texts = [raw[k : k + 40_000] for k in range(0, 4_000_000, 40_000)] * 3 + [""]
    asked = [[{"h": 1, "start": s, "starts": 200, "large": False} for s in range(0, len(t) - 600, 200)] for t in texts]
    ids = pa.array(range(len(texts)))
    wanted = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts), pa.array(asked)], names=["doc_id", "text_key", "text", "wanted"])
    found = []

    def run():
        for out in suffix_dedup._slices(400)(iter([wanted])):
            found.append(out.num_rows)
            yield

    assert peak_mb(run) < 20
    assert sum(found) == sum(map(len, asked))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_chunks_keep_equal_strings_in_a_group(monkeypatch, chunk):
    rng, least = random.Random(6), 20
    text = "".join(rng.choice(["abc", "abd", "xyzxyz", "q" * 30]) for _ in range(150)).encode()
    data = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    found = suffix_dedup.contexts(data, least)
    group = [g for g, start, n, _ in found for _ in range(n)]
    assert [s for _, start, n, _ in found for s in range(start, start + n)] == list(range(len(text) - least + 1))
    of = {}
    for s, g in enumerate(group):
        assert of.setdefault(text[s : s + least], g) == g
    for g, start, n, twice in found:
        strings = [text[s : s + least] for s in range(start, start + n)]
        assert twice or len(set(strings)) == n
    assert suffix_dedup.contexts(data[: least - 1], least) == []


def test_first_copy_stays(spark):
    a, b = cases.words(150, 1), cases.words(150, 2)
    rows = [(1, a), (2, a), (3, "x " + a), (4, b + " y"), (5, "z " + b), (6, None), (7, "ab" * 500)]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows), 200).collect()}
    assert [found[k].n_removed for k in (1, 4, 6)] == [0, 0, 0]
    assert bytes(found[2].kept) == b"" and bytes(found[3].kept) == b"x " and bytes(found[5].kept) == b"z "
    assert found[7].n_removed == 998  # the first period starts only once
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_longest_previous_is_the_suffix_order():
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    ends = np.array([150, 400])
    for least in (1, 3, 8, 11, 16):
        earlier, later = suffix_dedup.longest_previous(data, ends, least)
        text = data.tobytes()
        start = {i: text[i : i + least] for i in range(400) if i + least <= (150 if i < 150 else 400)}
        for i in range(400):
            same = [j for j, s in start.items() if i in start and s == start[i]]
            assert earlier[i] == any(j < i for j in same) and later[i] == any(j > i for j in same)


def test_whole_rows_move_once(spark):
    # one exchange of the texts serves the join and the choice among repeated rows
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs.select("doc_id", F.xxhash64("text").alias("key")).hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = kept_rows(docs.hint("merge"), F.xxhash64("text"), kept)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(") == 2 and found.count() == docs.dropDuplicates(["doc_id", "text"]).count()


def test_null_ids_equal_each_other_in_kept_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (0, "a"), (1, "a"), (None, "b"), (None, "a"), (1, "b")], "doc_id long, text string")
    key = F.col("text")
    found = lambda *rows: sorted(map(tuple, kept_rows(docs, key, spark.createDataFrame(rows, "doc_id long, key string")).collect()), key=str)
    assert found((None, "a"), (1, "b")) == [(1, "b"), (None, "a")]
    assert found((0, "a")) == [(0, "a")]
