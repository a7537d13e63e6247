"""Exact deduplication with the heavy hitters split off.

A Misra-Gries pass over text digests finds every digest that could fill a large share of the rows. The
candidates are counted exactly, and the verified ones (at most one per counter, so the list has a fixed
bound) are broadcast: their rows get their answer where they are and never meet in one task. All other
digests go through an ordinary partial aggregation and a join on the digest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.tables import kept_rows, lower_ascii, whole_text, written

#: Counters of a summary. A digest with more than rows / COUNTERS rows is certain to be found.
COUNTERS = 1024


def _summaries(counters: int):
    """Misra-Gries summary of a task's digests: at most ``counters`` digests with a lower bound of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            if len(counts) > counters:
                # what the first digest beyond the counters has is taken from all: a batch of single steps at once
                cut = sorted(counts.values(), reverse=True)[counters]
                counts = Counter({d: n - cut for d, n in counts.items() if n > cut})
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(counts), pa.binary()), "at_least": pa.array(list(counts.values()), pa.int64())},
        )

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep, group_size) of each digest that holds at least rows / counters rows and more than one.

    ``digests`` has ``digest``, ``doc_id`` and ``row``. At most ``counters`` rows come out.
    """
    found = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, at_least long")
    candidates = (
        found.groupBy("digest").agg(F.sum("at_least").alias("at_least"))
        .orderBy(F.desc("at_least"), "digest").limit(2 * counters).select("digest")
    )
    total = digests.count()
    exact = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    return (
        exact.where((F.col("group_size") > 1) & (F.col("group_size") * counters >= total))
        .orderBy(F.desc("group_size"), "digest").limit(counters)
        .select("digest", "keep", "group_size")
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest doc_id stays (null is the smallest; of rows that repeat a doc_id with an equal text
    one stays). Other columns of ``docs`` are not read. No rows in, no rows out.
    """
    digests = written(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(lower_ascii(whole_text("text")).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )
    heavy = written(heavy_digests(digests, counters), "heavy-digests")
    decided = digests.join(F.broadcast(heavy), "digest", "left")
    light = decided.where("keep IS NULL").select("digest", "doc_id", "row")
    winners = light.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"),
    )
    rows = decided.where("keep IS NOT NULL").unionByName(light.join(winners, "digest"), allowMissingColumns=False)
    return rows.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Of rows that repeat doc_id and text one stays, the one with the smallest hash of its columns.
    """
    kept = exact_dedup(docs, counters).where("kept").select("doc_id", F.unhex("text_sha256").alias("key"))
    return kept_rows(docs, F.unhex(F.sha2(lower_ascii(whole_text("text")).cast("binary"), 256)), kept)
