"""Jaccard self-join of documents on word n-grams.

Documents with the same set of n-grams are one class and take part once. A class's n-grams are ordered rare
first (by a million hashed counters over the whole corpus, then by hash); two sets that are similar enough
share an n-gram in a short prefix of that order. Prefix n-grams that occur twice give candidates, which
must pass the length filter, the positional filter (what can still match behind the shared n-gram) and the
suffix filter (lower bounds of the symmetric difference from the sets' spread over fixed parts of the hash
space: by the parts with an odd number of n-grams, and by the counts). Each pair that is left is verified once
on the whole sets.

Candidates come in steps, so that a large group of near copies isn't tried pair by pair. First every member
of a prefix list is tried against the member with the most exact copies (of several the one with the least that
others lack), then what is still apart against a few members drawn by hash. Then only members that are in different
components are paired. Links inside a component change no component, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.graph import components
from vouchsafe.llm.tables import kept_rows, spread, whole_text, written

#: Saturating counters of the corpus counts that make the order rare first. Any order gives right results; with
#: fewer counters than a fraction of the n-grams, those of middling count mix with the rare ones and make lists longer.
BUCKETS = 1 << 20
#: Counters in a row while the tasks' counts are summed, and such rows that are summed together.
CHUNK, TOGETHER = 1 << 16, 64
MOST = np.iinfo(np.uint16).max
#: Parts of the hash space of the suffix filter: a short form beside each candidate, a longer one for each pair.
OUTLINE, PARTS = 64, 256
#: Parts of the hash space whose odd counts are marked by a bit each.
SKETCH = 512
#: Members, drawn by hash, that what is still apart is tried against before it is paired.
MORE_HUBS = 3
#: Rows of a batch whose texts are Python strings at a time.
GROUP = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; a shorter text is one n-gram, no words give none."""
    found = text.encode().lower().split()  # lower-cases A-Z alone, splits at space and tab to carriage return
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(each))
    out = np.full(len(each) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = out * _BASE + each[k : len(each) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]  # np.unique takes three times as long on short arrays


def _class_of(hashes: np.ndarray) -> tuple[int, bytes]:
    """A short and a safe key of a set. Equal short keys only add candidates; classes go by both."""
    key = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), key


def _outline_of(hashes: np.ndarray) -> np.ndarray:
    """Counts in OUTLINE parts of the hash space, held at 127: differences of held counts are never too large."""
    return np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=OUTLINE), 127).astype(np.int8)


def _sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of SKETCH parts that holds an odd number: an n-gram that only one set has flips one bit."""
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def _parts_of(hashes: np.ndarray) -> bytes:
    return np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=PARTS).astype("<u4").tobytes()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of GROUP rows at most: of a larger one, all texts and sets would be held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def _sets(words: int):
    """Rows of kind 0: a document's key, size and parts. Rows of kind 1: a task's counters, in chunks."""
    names = ["kind", "row", "doc_id", "text_key", "n", "cls", "key", "parts", "outline", "sketch", "chunk", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        row = TaskContext.get().partitionId() << 40
        for batch in _groups(batches):
            size, cls, keys, parts, outline, sketch = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                np.add.at(counts, (found & np.uint64(BUCKETS - 1)).astype(np.int64), 1)  # distinct n-grams of a text
                short, key = _class_of(found)
                size.append(len(found))
                cls.append(short)
                keys.append(key)
                parts.append(_parts_of(found))
                outline.append(_outline_of(found))
                sketch.append(_sketch_of(found))
            m = len(size)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(m, np.int32)), pa.array(np.arange(row, row + m)), batch.column(0),
                batch.column(2), pa.array(size, pa.int32()),
                pa.array(cls, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.binary()),
                pa.array(outline, pa.list_(pa.int8())), pa.array(sketch, pa.list_(pa.int64())),
                pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
            ], names=names)
            row += m
        for c in range(BUCKETS // CHUNK):  # a batch each, so that no large one is held
            own = counts[c * CHUNK : (c + 1) * CHUNK]
            if own.any():
                yield pa.RecordBatch.from_arrays([
                    pa.array([1], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()),
                    pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int8())), pa.nulls(1, pa.list_(pa.int64())),
                    pa.array([c], pa.int32()), pa.array([np.minimum(own, MOST).astype("<u2").tobytes()], pa.binary()),
                ], names=names)

    return run


_SETS = "kind int, row long, doc_id long, text_key long, n int, cls long, key binary, parts binary, outline array<tinyint>, sketch array<bigint>, chunk int, times binary"


def _sum_chunks(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint32)
    for raw in table.column("times"):
        total += np.frombuffer(raw.as_buffer(), "<u2")
        np.minimum(total, MOST, out=total)
    part, chunk = table.column("part")[0], table.column("chunk")[0]
    return pa.table({"part": [part.as_py()], "chunk": pa.array([chunk.as_py()], pa.int32()), "times": pa.array([total.astype("<u2").tobytes()], pa.binary())})


def _all_counts(counted: DataFrame, tasks: int) -> np.ndarray:
    """Sums of the tasks' chunks (part, chunk, times), in rounds of TOGETHER parts; BUCKETS counters come to the driver."""
    while tasks > 1:
        counted = counted.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("long")).groupBy("part", "chunk").applyInArrow(
            _sum_chunks, "part long, chunk int, times binary")
        tasks = -(-tasks // TOGETHER)
        if tasks > 1:
            counted = written(counted, "ngram-counts")
    times = np.zeros(BUCKETS, np.uint16)
    for r in counted.collect():
        times[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["times"], "<u2")
    return times


def _prefixes(words: int, num: int, den: int, counts):
    """Prefix n-grams of each set; ``own`` is the sum of 100 / count over the set, small where others have all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = counts.value
        seen: set[bytes] = set()
        for batch in _groups(batches):
            tokens, owner, size, place, own = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                n = len(found)
                if not n:
                    continue
                short, key = _class_of(found)
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()  # a copy that is met again adds equal rows, nothing else
                seen.add(key)
                prefix = n + num * n // -den + 1
                often = times[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[:prefix]  # the n-grams are sorted, so ties go by hash
                tokens.append(found[order].view(np.int64))
                owner.append(np.full(prefix, short, np.int64))
                size.append(np.full(prefix, n, np.int32))
                place.append(np.arange(prefix, dtype=np.int32))
                own.append(np.full(prefix, int((100 / np.maximum(often, 1)).sum()), np.int32))
            if tokens:
                columns = [pa.array(np.concatenate(c)) for c in (tokens, owner, size, place, own)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "cls", "n", "at", "own"])

    return run


def _may_match(an: Column, aat: Column, bn: Column, bat: Column, num: int, den: int) -> Column:
    """Length filter and positional filter of two sets at an n-gram that they share."""
    small, large = F.least(an, bn).cast("long"), F.greatest(an, bn).cast("long")
    need = F.ceil((an.cast("long") + bn) * num / (num + den) - 1e-9)
    rest = F.least(an - aat, bn - bat)
    return (small * den >= large * num) & (rest >= need)


def _most_apart(num: int, den: int) -> Column:
    """Size of the largest symmetric difference that two similar sets of n and _n n-grams can have."""
    both = F.col("n").cast("long") + F.col("_n")
    return both - 2 * F.ceil(both * num / (num + den) - 1e-9)


def _sketches_close(num: int, den: int) -> Column:
    """Suffix filter on the odd parts; near the limit it tells small sets apart that the counts don't."""
    apart = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("_sketch")[k])) for k in range(SKETCH // 64)), F.lit(0))
    return apart <= _most_apart(num, den)


def _outlines_close(num: int, den: int) -> Column:
    """Suffix filter on the short forms, inside the join: far sets never become rows."""
    apart = F.aggregate(
        F.zip_with("outline", "_outline", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda a, x: a + x,
    )
    return apart <= _most_apart(num, den)


def _suffix_filter(num: int, den: int):
    """Pairs whose sets can't differ too much, judged by how many n-grams each has in each part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64)
                for c in ("aparts", "bparts")
            )
            both = (batch.column("an").to_numpy().astype(np.int64) + batch.column("bn").to_numpy())
            need = -(-both * num // (num + den))
            keep = np.abs(a - b).sum(axis=1) <= both - 2 * need
            yield batch.select(["a", "b", "adoc", "bdoc"]).filter(pa.array(keep))

    return run


def _own_texts(words: int):
    """Leaves out the other texts of a repeated doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            own = [_class_of(shingles(t, words))[0] == c for c, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select(["node", "text"]).filter(pa.array(own, pa.bool_()))

    return run


def _verify(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                keep = []
                columns = (part.column(c).to_pylist() for c in ("a", "atext", "btext"))
                for a, atext, btext in zip(*columns):
                    if a != last:
                        last, left = a, shingles(atext, words)
                    right = shingles(btext, words)
                    common = np.intersect1d(left, right, assume_unique=True).size
                    keep.append(common * den >= num * (left.size + right.size - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    The set of a text: its distinct ``words``-grams of words after lower-casing A-Z, words being runs of
    characters other than space, tab, line feed, vertical tab, form feed and carriage return. A text with
    fewer words is one n-gram; without words, or null, the set is empty and linked with nothing. Two rows
    link when den * intersection >= num * union. ``component_id`` is the smallest doc_id in reach, its own
    included. Of each component one row is ``kept``: one with that doc_id. Rows that repeat a doc_id are rows
    of their own; null doc_ids link but name no component where there are others. Other columns are not read.
    """
    return _components(docs, words, num, den).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever these are called; texts without words all stay.

    Rows that repeat both doc_id and text are one row of the result, the one with the smallest hash of its columns.
    """
    kept = _components(docs, words, num, den).where("kept").select("doc_id", F.col("text_key").alias("key"))
    return kept_rows(docs, F.xxhash64(whole_text("text")), kept)


def _components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    text = whole_text("text")
    texts = spread(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key")))
    passed = written(texts.mapInArrow(_sets(words), _SETS), "ngram-sets")
    sets = passed.where("kind = 0")
    times = _all_counts(
        passed.where("kind = 1").select(F.col("row").alias("part"), "chunk", "times"), texts.rdd.getNumPartitions(),
    )
    classes = written(
        sets.where("n > 0").groupBy("cls", "key").agg(
            F.min("row").alias("node"), F.min(_place()).alias("place"), F.min_by("doc_id", "row").alias("text_of"),
            F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("outline").alias("outline"),
            F.first("sketch").alias("sketch"), F.count("*").alias("copies"),
        ),
        "ngram-classes",
    )
    postings = texts.select("text").mapInArrow(
        _prefixes(words, num, den, spark.sparkContext.broadcast(times)), "token long, cls long, n int, at int, own int",
    )
    of_token = Window.partitionBy("token")
    shared = postings.withColumns({"least": F.min("cls").over(of_token), "last": F.max("cls").over(of_token)}).where("least < last")
    # the class with the most copies is what most near copies were made from; else the one with the least of its own is in their middle
    best = F.max(F.struct("copies", -F.col("own"), (-F.col("n")).alias("less"), "cls", "at")).over(of_token)
    shared = written(
        shared.select("token", "cls", "n", "at", "own").join(classes.select("cls", "copies"), "cls")
        .withColumn("hub", best).select("token", "cls", "n", "at", F.struct(
            F.col("hub.cls").alias("cls"), (-F.col("hub.less")).alias("n"), F.col("hub.at").alias("at")).alias("hub")),
        "ngram-shared",
    )
    tried = (
        shared.where(F.col("cls") != F.col("hub.cls"))
        .where(_may_match(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), num, den))
        .select(F.least("cls", "hub.cls").alias("x"), F.greatest("cls", "hub.cls").alias("y")).distinct()
    )
    tried = written(tried, "ngram-tried")
    links = _links(docs, classes, tried, words, num, den)
    roots = components(links)

    # what is still apart is tried against a few more members of its lists, drawn by hash
    spread_hub = F.max(F.struct(F.xxhash64(F.pmod("token", F.lit(MORE_HUBS)), "cls").alias("order"), "cls", "n", "at", "root")).over(of_token)
    apart = _placed(shared, classes, roots).withColumn("other", spread_hub).where(F.col("root") != F.col("other.root"))
    again = (
        apart.where(_may_match(F.col("n"), F.col("at"), F.col("other.n"), F.col("other.at"), num, den))
        .select(F.least("cls", "other.cls").alias("x"), F.greatest("cls", "other.cls").alias("y")).distinct()
        .join(tried, ["x", "y"], "left_anti")
    )
    again = written(again, "ngram-tried")
    links = written(links.unionByName(_links(docs, classes, again, words, num, den)), "ngram-links")
    roots = components(links)
    tried = tried.unionByName(again)

    # members of different components that share a prefix n-gram
    left = _placed(shared, classes, roots)
    right = left.select("token", *[F.col(c).alias(f"_{c}") for c in ("cls", "n", "at", "root", "outline", "sketch")])
    across = (
        left.join(right, "token")
        .where((F.col("cls") < F.col("_cls")) & (F.col("root") != F.col("_root")))
        .where(_may_match(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"), num, den))
        .where(_sketches_close(num, den) & _outlines_close(num, den))
        .select(F.col("cls").alias("x"), F.col("_cls").alias("y")).distinct()
        .join(tried, ["x", "y"], "left_anti")
    )
    more = _links(docs, classes, written(across, "ngram-across"), words, num, den)
    roots = components(links.unionByName(more))

    placed = classes.join(roots, "node", "left").select(
        "cls", "key", "place", F.coalesce("root", "node").alias("root"),
    )
    smallest = placed.groupBy("root").agg(F.min("place").alias("smallest"))
    of_class = written(placed.join(smallest, "root").select("cls", "key", "smallest"), "ngram-components")
    linked = sets.where("n > 0").join(of_class, ["cls", "key"]).select(
        "doc_id", "text_key", "n", F.col("smallest.doc_id").alias("component_id"), (F.col("smallest.row") == F.col("row")).alias("kept"),
    )
    alone = sets.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).withColumn("n_shingles", F.col("n").cast("long"))


def _placed(shared: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the prefix lists with the component and the short forms of their class."""
    place = classes.join(roots, "node", "left").select("cls", "outline", "sketch", F.coalesce("root", "node").alias("root"))
    return shared.join(place, "cls").select("token", "cls", "n", "at", "root", "outline", "sketch")


def _place() -> Column:
    """Order of rows: by doc_id, null last, then by place in the input."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs of classes that link; each pair is judged once on the texts of one row of each class."""
    side = lambda s: classes.select(
        F.col("cls").alias("x" if s == "a" else "y"), F.col("node").alias(s), F.col("n").alias(f"{s}n"),
        F.col("parts").alias(f"{s}parts"), F.col("text_of").alias(f"{s}doc"),
    )
    likely = written(
        pairs.join(side("a"), "x").join(side("b"), "y").select("a", "b", "an", "bn", "aparts", "bparts", "adoc", "bdoc")
        .mapInArrow(_suffix_filter(num, den), "a long, b long, adoc long, bdoc long"),
        "ngram-likely",
    )
    nodes = likely.select(F.col("a").alias("node"), F.col("adoc").alias("doc")).unionByName(
        likely.select(F.col("b").alias("node"), F.col("bdoc").alias("doc")),
    ).distinct().join(classes.select("node", "cls"), "node")
    source = docs.select("doc_id", whole_text("text").alias("text"))
    found = source.join(nodes, F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "cls", "text")
    texts = written(found.mapInArrow(_own_texts(words), "node long, text string"), "ngram-texts")
    right = likely.join(texts.select(F.col("node").alias("b"), F.col("text").alias("btext")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("atext")), "a")
    return written(
        both.select("a", "b", "atext", "btext").mapInArrow(_verify(words, num, den), "a long, b long"), "ngram-links",
    )
