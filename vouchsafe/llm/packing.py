"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents of one length are interchangeable, so best-fit decreasing runs over the counts of the
``capacity`` possible lengths on the driver and yields ranges of slots. Documents then take the slots by
their rank within their length; no document passes the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.chunks import ByteChunkEncoder, encoder, model_text
from vouchsafe.llm.tables import spread, whole_text, written
from vouchsafe.operators.rows import rank_within

CAPACITY = 2048
END_ID = 0
#: Documents that are encoded together in a task.
GROUP = 256
#: Parts in which a length is ranked, at least; and pieces in a part, so that one length of very many pieces has more.
PARTS, PART_ROWS = 64, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(model, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteChunkEncoder, model.value).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                doc_id, piece, start, length, crc = [], [], [], [], []
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    raw += end
                    total = len(raw) // 4
                    bounds = [*range(total, 0, -capacity), 0][::-1]  # whole pieces at the end, a shorter one first
                    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
                        doc_id.append(key)
                        piece.append(n)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(raw[4 * low : 4 * high]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: the ids of a text (null: empty), then ``end_id``.

    Only longer documents are cut, and only their first piece may be shorter than ``capacity``.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    texts = spread(docs.select("doc_id", whole_text("text").alias("text")))
    return texts.mapInArrow(_cut(model, capacity, end_id), PIECES)


def plan_slots(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, slots, first sequence, offset).

    A range gives the pieces of a length with ranks from ``first rank`` on a place at ``offset`` in as many
    sequences from ``first sequence`` on. Sequences with the same room are interchangeable, so the state
    is a list of sequence ranges per room, and its size depends on ``capacity`` alone, not on the counts.
    """
    open_with: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    usable = 0  # bit r is set when sequences with room r are open
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")

        def put(first: int, n: int, room: int) -> None:
            nonlocal usable, rank, left
            slots.append((length, rank, n, first, capacity - room))
            rank, left = rank + n, left - n
            open_with[room - length].append((first, n))
            usable |= 1 << (room - length)

        while left:
            fitting = usable >> length
            if not fitting:
                each = capacity // length
                n = max(1, left // each)
                slots += [(length, rank + k * n, n, sequences, k * length) for k in range(min(each, left))]
                taken = min(each, left)
                rank, left = rank + taken * n, left - taken * n
                room = capacity - taken * length
                open_with[room].append((sequences, n))
                usable |= 1 << room
                sequences += n
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            first, n = open_with[room].pop()
            if n > left:
                open_with[room].append((first + left, n - left))
                n = left
            if not open_with[room]:
                usable &= ~(1 << room)
            put(first, n, room)
    return slots


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (unique by doc_id and piece, each with a length) with their sequence_id and offset."""
    spark = pieces.sparkSession
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_slots(counts, capacity), "length long, first_rank long, slots long, first_sequence long, offset long",
    )
    parts = max(PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    ranked = rank_within(
        pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)), [F.col("doc_id"), F.col("piece")], "_rank",
    ).withColumn("_rank", F.col("_rank") - 1)
    plan = F.broadcast(slots.withColumnRenamed("length", "_length"))
    here = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("slots"))
    )
    return ranked.join(plan, here).select(
        *pieces.columns,
        (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is empty and still takes the
    place of its end id. Rows that repeat a doc_id are documents of their own; they get places of their own.
    No documents, no rows. Other columns are not read.
    """
    return pack_pieces(written(document_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
