"""Importance resampling of documents towards a target distribution over hashed word n-grams.

Texts become features with Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` turn a slice of texts into indices of distinct words; shifted indices form the longer
runs, whose distinct pairs (shorter run, next word) get their CRC once each; ``take`` brings bucket gains to
the positions and a segment reduction sums them per text. A first pass counts buckets in each task, a second
one weighs the texts with the gains. Gumbel noise per document turns the weights into a draw without
replacement: the highest noisy scores stay.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.tables import spread, whole_text, written

#: What stands between words: every ASCII character but digits and small letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are cut into words together; a longer text is a slice of its own.
SLICE = 4 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of whole texts with about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words before each text (one entry more than texts), and for each run length the buckets at all
    positions with a mask of those where a whole run starts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    pieces = pc.list_flatten(lists)
    word = pc.greater(pc.binary_length(pieces), 0)  # a break at either end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    coded = pc.dictionary_encode(pieces.filter(word))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    end = np.repeat(before[1:], np.diff(before))
    position = np.arange(len(index))
    run, crcs, found = index, np.array([zlib.crc32(w) for w in words], dtype=np.int64), []
    for length in range(1, longest + 1):
        if length > 1:
            following = np.concatenate([index[length - 1 :], np.zeros(min(length - 1, len(index)), np.int64)])
            pairs, run = np.unique(run * max(1, len(words)) + following, return_inverse=True)
            crcs = np.array(
                [zlib.crc32(b" " + words[p % len(words)], int(crcs[p // len(words)])) for p in pairs.tolist()], dtype=np.int64,
            )
        found.append(((crcs % buckets).take(run), position + length <= end))
    return before, found


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts (column ``text``, not null): partial counts a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                for at, whole in features(part, longest, buckets)[1]:
                    total += np.bincount(at[whole], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    counted = spread(texts.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most `buckets` rows, whatever the input
        found[row["bucket"]] = row["n"]
    return found


def bucket_gains(source: Sequence[int], target: Sequence[int]) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    buckets, s_all, t_all = len(source), float(sum(map(int, source))), float(sum(map(int, target)))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
            for s, t in zip(map(int, source), map(int, target))
        ],
        dtype=np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of gains over the features) of each row."""
    gains_of = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gains_of.value
        for batch in batches:
            for first, part in slices(batch.column(1)):
                before, found = features(part, longest, len(own))
                number, weight = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for at, whole in found:
                    for total, values in ((number, whole), (weight, own.take(at) * whole)):
                        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                        total += sums[before[1:]] - sums[before[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(np.diff(before)), pa.array(number), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return spread(read).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel draw, rounded down, fixed by seed and doc_id (null: no digits)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, share: tuple[int, int], eligible: Column) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``share`` (part, whole) of the eligible rows that score highest.

    Rows are dealt into ranges of falling score, so no task sorts more than a range; only ranges that begin
    before the cut are sorted. Ties go to the smaller doc_id (null first), equal rows are told apart by place.
    """
    able = scored.where(eligible).withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = written(able.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "score-ranges")
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row a task
    taken = sum(n for _, n in sizes) * share[0] // share[1]
    starts, begin = [], 0
    for number, n in sizes:
        if begin < taken:
            starts.append((number, begin))
        begin += n
    offsets = scored.sparkSession.createDataFrame(starts, "_range int, _before long")
    within = Window.partitionBy("_range").orderBy(*order)
    placed = dealt.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.row_number().over(within))
    last = starts[-1][0] if starts else -1
    none = F.lit(None).cast("long")
    names = [*scored.columns, "rank"]
    return (
        placed.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank"))).select(*names)
        .unionByName(dealt.where(F.col("_range") > last).withColumn("rank", none).select(*names))
        .unionByName(scored.where(~eligible).withColumn("rank", none).select(*names))
    )


def resample(
    docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, share: tuple[int, int] = (10, 100),
    least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text).

    ``rank`` is null for rows that are not drawn. Null and empty texts have no features, weight 0 and are
    never drawn; a null doc_id takes part under an empty name and ranks before others of its score. Rows that
    repeat are weighed, counted and drawn each. Without documents there are no rows; without target texts
    the target is uniform. Columns other than doc_id and text are not read.
    """
    gains = bucket_gains(
        bucket_counts(docs.select(whole_text("text").alias("text")), longest, buckets),
        bucket_counts(target.select(whole_text("text").alias("text")), longest, buckets),
    )
    scored = weigh(docs, gains, longest).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    return draw(written(scored, "scores"), share, F.col("n_words") >= least_words)
