"""Token id files of patched frame-of-reference blocks.

Documents are put into ascending doc_id order by a range partitioning, so a task holds one shard of the
order. A shard is a row of segments; a segment holds whole documents and packs their ids into blocks of
1,024: the block's minimum is subtracted, the rest is packed at the width that a percentile of its values
needs, and the few wider values stand in an exception list. The byte where each block starts is in the
segment's index, so a block can be unpacked alone. Spark's own writer commits the segments, which
makes a repeated task harmless and works on any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.chunks import WordChunkEncoder, encoder, model_text
from vouchsafe.llm.tables import whole_text, written

BLOCK = 1024
#: Share of a block's values, in percent, that its width must hold.
PERCENTILE = 95
#: Ids after which a segment is closed. A longer document makes a longer segment.
SEGMENT = 1 << 16
END_ID = 1
#: Documents that are encoded together in a task.
GROUP = 256

SEGMENTS = (
    "shard int, segment int, start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "minima binary, widths binary, block_starts binary, payload binary, exception_at binary, exception_value binary"
)


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> dict[str, bytes]:
    """Blocks of unsigned 32-bit ids: minima, widths, start of each block, payload, exceptions."""
    blocks = -(-len(ids) // block)
    padded = np.concatenate([ids, np.full(blocks * block - len(ids), ids[-1] if len(ids) else 0, "<u4")]).astype("<u4")
    rows = padded.reshape(blocks, block)
    minima = rows.min(axis=1) if blocks else np.zeros(0, "<u4")
    above = rows - minima[:, None]
    rank = min(block - 1, int(block * percentile / 100))
    wanted = np.partition(above, rank, axis=1)[:, rank] if blocks else minima
    widths = np.frexp(wanted.astype(np.float64))[1].astype(np.uint8)  # bits of the value
    sizes = (block * widths.astype(np.int64) + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    limit = np.left_shift(np.uint64(1), widths.astype(np.uint64))
    at = np.flatnonzero((above >= limit[:, None]).ravel())
    at = at[at < len(ids)]
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        if width:
            bits = np.unpackbits(
                np.ascontiguousarray(above[chosen]).view(np.uint8).reshape(len(chosen), block, 4), axis=2, bitorder="little",
            )
            packed = np.packbits(bits[:, :, :width].reshape(len(chosen), -1), axis=1, bitorder="little")
            place = starts[chosen][:, None] + np.arange(packed.shape[1])
            payload[place] = packed
    return {
        "minima": minima.astype("<u4").tobytes(), "widths": widths.tobytes(), "block_starts": starts.astype("<u8").tobytes(),
        "payload": payload.tobytes(), "exception_at": at.astype("<u4").tobytes(),
        "exception_value": padded[at].tobytes(),
    }


def unpack_ids(packed: dict[str, bytes], n_tokens: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``pack_ids`` packed."""
    minima = np.frombuffer(packed["minima"], "<u4")
    widths = np.frombuffer(packed["widths"], np.uint8)
    starts = np.frombuffer(packed["block_starts"], "<u8").astype(np.int64)
    payload = np.frombuffer(packed["payload"], np.uint8)
    rows = np.zeros((len(minima), block), "<u4")
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        if width:
            size = (block * int(width) + 7) // 8
            raw = payload[starts[chosen][:, None] + np.arange(size)]
            bits = np.unpackbits(raw, axis=1, count=block * int(width), bitorder="little").reshape(len(chosen), block, width)
            wide = np.zeros((len(chosen), block, 32), np.uint8)
            wide[:, :, :width] = bits
            rows[chosen] = np.packbits(wide, axis=2, bitorder="little").reshape(len(chosen), -1).view("<u4")
    ids = (rows + minima[:, None]).ravel()[:n_tokens].astype("<u4")
    ids[np.frombuffer(packed["exception_at"], "<u4")] = np.frombuffer(packed["exception_value"], "<u4")
    return ids


def _segments(model, end_id: int):
    schema = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
        *[(n, pa.binary()) for n in ("minima", "widths", "block_starts", "payload", "exception_at", "exception_value")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordChunkEncoder, model.value).encode
        end = end_id.to_bytes(4, "little")
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        keys, parts, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, keys, parts, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {
                "shard": shard, "segment": segment, "start": start, "n_tokens": len(ids), "doc_ids": keys,
                "doc_tokens": [len(p) // 4 for p in parts], **pack_ids(ids),
            }
            segment, start = segment + 1, start + len(ids)
            keys, parts, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    keys.append(key)
                    parts.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= SEGMENT:
                        yield close()
        if keys:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts, add ``end_id`` to each and write the segments; returns the written files as a table.

    Null text is empty and still has its end id. Rows that repeat a doc_id stay rows of their own, side by
    side; a null doc_id comes first. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    ordered = (
        docs.select("doc_id", whole_text("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    )
    return written(ordered.mapInArrow(_segments(model, end_id), SEGMENTS), "token-files")


def _unpack(with_ids: bool):
    fields = ("minima", "widths", "block_starts", "payload", "exception_at", "exception_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids({f: row[f] for f in fields}, row["n_tokens"])
                ends = np.cumsum([0, *row["doc_tokens"]])
                pieces = [ids[a:b] for a, b in zip(ends, ends[1:])]
                values = (
                    pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64())) if with_ids
                    else pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(pieces), pa.int32()),
                        pa.array(ends[:-1] + row["start"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), values,
                    ],
                    names=["doc_id", "shard", "start", "n_tokens", "ids" if with_ids else "ids_crc32"],
                )

    return run


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their ids_crc32) of each document in the files.

    ``start`` counts the ids of all documents before it: those of earlier shards, whose totals (one row per
    shard) are summed up, and those before it in its own.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    kind = "ids array<bigint>" if with_ids else "ids_crc32 long"
    read = files.mapInArrow(_unpack(with_ids), f"doc_id long, shard int, start long, n_tokens long, {kind}")
    return read.join(offsets, "shard").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids" if with_ids else "ids_crc32",
    )
