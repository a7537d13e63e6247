"""Removal of long repeated byte strings with suffix order and longest-previous-factor arrays.

A string of ``least`` bytes is assigned to the smallest hash among its short grams, so equal strings fall
into one group wherever they stand. A document is thereby cut into contexts: runs of string starts with the
same smallest hash. Only contexts whose group has another member, or that hold their hash twice, can
contain a repeated string; their distinct forms alone are fetched and sorted.

Within a bundle of groups all contexts are joined and the suffixes that are repeated up to ``least`` bytes are
put into order by doubling. Equal prefixes stand in a row, by position: the previous smaller position in
suffix order is then the neighbour, and it is an earlier match of at least ``least`` bytes exactly when it has
the same prefix. The mirrored neighbour gives the later matches. A group with very many distinct contexts, or
many bytes of them, is not sorted in one place; its strings are counted by hash instead, over all tasks, with
the same result.

A task's memory doesn't follow its input: a sort takes up to some 65 times its bytes, and those are bounded by the larger
of ``BUNDLE`` and ``LARGE_BYTES``; texts become Python objects ``PART`` bytes at a time and are hashed in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.tables import spread, whole_text, written

LEAST = 400
#: Bytes of the grams whose hashes assign the strings.
GRAM = 64
#: String starts of one context at most; a longer run is cut, its parts stay in one group.
RUN = 4096
#: Distinct contexts of a group from which on it is counted by string hash instead of sorted.
LARGE_GROUP = 2048
#: Bytes of a group's distinct contexts above which it is counted as well.
LARGE_BYTES = 2 << 20
#: Bytes that are sorted together, but for a group that alone has more.
BUNDLE = 1 << 20
#: String starts of a text that are hashed at a time.
CHUNK = 1 << 18
#: Bytes of texts that are Python objects at a time, but for a text that alone has more.
PART = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each position on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _BASE
    size = 1

    def join(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = low * _MIX
        out += high
        out ^= out >> np.uint64(32)
        out *= _BASE
        return out

    while size * 2 <= width:
        h = join(h[:-size], h[size:])
        size *= 2
    if size < width:
        rest = width - size
        h = join(h[:-rest], h[rest:])
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def contexts(data: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """(group, first start, starts, holds its hash twice) of each context of a document.

    Chunks cut contexts as ``RUN`` does: the parts stay in one group.
    """
    out = []
    for at in range(0, len(data) - least + 1, CHUNK):
        out += [(group, at + start, n, twice) for group, start, n, twice in _contexts(data[at : at + CHUNK + least - 1], least)]
    return out


def _contexts(data: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    gram = min(GRAM, least)
    width = least - gram + 1
    h = gram_hashes(data, gram)
    smallest = _sliding_min(h, width)
    first = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    ends = np.append(first[1:], len(smallest))
    out = []
    for a, b in zip(first.tolist(), ends.tolist()):
        twice = int(np.count_nonzero(h[a : b + width - 1] == smallest[a])) > 1
        out += [(int(smallest[a].view(np.int64)), s, min(RUN, b - s), twice) for s in range(a, b, RUN)]
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, ``PART`` bytes of text at a time: a whole batch never lives as Python objects."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, done + PART, side="right")))
            yield batch.slice(at, end - at)
            at, done = end, int(size[end - 1])


def _context_rows(least: int):
    names = ["doc_id", "text_key", "h", "form", "start", "starts", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            docs, keys, h, form, start, starts, twice = ([] for _ in names)
            columns = (batch.column(c).to_pylist() for c in range(3))
            for doc, key, text in zip(*columns):
                raw = text.encode()
                found = contexts(np.frombuffer(raw, np.uint8), least)
                docs += [doc] * len(found)
                keys += [key] * len(found)
                for group, at, n, again in found:
                    h.append(group)
                    form.append(xxhash.xxh3_64_intdigest(raw[at : at + n - 1 + least]) - (1 << 63))
                    start.append(at)
                    starts.append(n)
                    twice.append(again)
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(h, pa.int64()), pa.array(form, pa.int64()),
                pa.array(start, pa.int32()), pa.array(starts, pa.int32()), pa.array(twice, pa.bool_()),
            ], names=names)

    return run


_CONTEXTS = "doc_id long, text_key long, h long, form long, start int, starts int, twice boolean"


def repeated_prefixes(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions whose ``least`` bytes occur twice or more, and the class of each.

    ``ends`` are the ends of the joined strings; no match crosses one. Doubling: a position's rank at twice the
    width comes from its rank and that of the position one width on. A position that is alone at some width
    is alone at every larger one and leaves at once. Equal prefixes are in order of position.
    """
    n = len(data)
    whole = np.int32 if n < 1 << 31 else np.int64
    room = np.repeat(ends, np.diff(ends, prepend=0)).astype(whole)
    room -= np.arange(n, dtype=whole)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    width = min(8, least)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    # positions behind the last start still carry ranks for the wider prefixes of those before them
    at = np.flatnonzero(room >= width).astype(whole)
    key = key[at]
    rank = np.full(n, -1, whole)

    def settle(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        keep = ~(new[:-1] & new[1:])
        cls = np.cumsum(new[:-1], dtype=whole)[keep]
        at = at[order[keep]]
        rank.fill(-1)
        rank[at] = cls
        return at, cls

    at, cls = settle(at, key)
    while width < least and len(at):
        step = min(width, least - width)
        at = np.sort(at)
        on = at + step
        good = on < n
        at, on = at[good], on[good]
        good = (rank[on] >= 0) & (room[at] >= width + step)
        at, on = at[good], on[good]
        key = rank[at].astype(np.int64)
        key *= n + 1
        key += rank[on]
        at, cls = settle(at, key)
        width += step
    return at, cls


def longest_previous(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position: has it an earlier match of ``least`` bytes, has it a later one.

    In suffix order with equal prefixes by position, the previous smaller position of an entry is its
    predecessor, the next larger one its successor; both count while the prefix is the same.
    """
    order, cls = repeated_prefixes(data, ends, least)
    earlier, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    same = cls[1:] == cls[:-1]
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier, later


def _spans(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Covered byte ranges of sorted string starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > least)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + least).tolist()))


def _slices(least: int):
    """Bytes of the contexts that a document was asked for."""
    names = ["h", "doc_id", "text_key", "start", "large", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            h, docs, keys, start, large, data = ([] for _ in names)
            for doc, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw = text.encode()
                for w in wanted:
                    h.append(w["h"])
                    docs.append(doc)
                    keys.append(key)
                    start.append(w["start"])
                    large.append(w["large"])
                    data.append(raw[w["start"] : w["start"] + w["starts"] - 1 + least])
            yield pa.RecordBatch.from_arrays([
                pa.array(h, pa.int64()), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(start, pa.int32()),
                pa.array(large, pa.bool_()), pa.array(data, pa.binary()),
            ], names=names)

    return run


_PIECES = "h long, doc_id long, text_key long, start int, large boolean, data binary"
_RANGES = "doc_id long, text_key long, low long, high long"


def _range_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_key", "low", "high"])


def _sort_bundles(least: int, keep_first: bool):
    """Suffix order of whole groups, a bundle at a time. The rows come sorted by group and place."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        ends = np.cumsum([len(r[4]) for r in rows])
        earlier, later = longest_previous(data, ends, least)
        hit = np.flatnonzero(earlier if keep_first else earlier | later)
        of = np.searchsorted(ends, hit, side="right")
        begins = ends - [len(r[4]) for r in rows]
        out = []
        bounds = np.searchsorted(of, np.arange(len(rows) + 1))
        for k in np.unique(of).tolist():
            _, doc, key, start, _ = rows[k]
            mine = hit[bounds[k] : bounds[k + 1]] - begins[k] + start
            out += [(doc, key, low, high) for low, high in _spans(mine, least)]
        return _range_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = more = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "text_key", "start", "data"))):
                if group and row[0] != group[0][0]:
                    held.extend(group)
                    size += more
                    group, more = [], 0
                group.append(row)
                more += len(row[4])
                if held and size + more > BUNDLE:
                    yield solve(held)
                    held, size = [], 0
        if group:
            yield solve(held + group)

    return run


def _strings(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, doc, key, start, data in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "text_key", "start", "data"))):
                found = gram_hashes(np.frombuffer(data, np.uint8), least).view(np.int64)
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, h)), pa.array(found), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()),
                    pa.array(np.arange(start, start + n, dtype=np.int64)),
                ], names=["h", "string", "doc_id", "text_key", "at"])

    return run


def _counted(pieces: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """Ranges in very large groups: each string is counted by its hash, partially in each task first."""
    strings = pieces.mapInArrow(_strings(least), "h long, string long, doc_id long, text_key long, at long")
    counts = strings.groupBy("h", "string").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "at")).alias("first"),
    ).where("times > 1")
    hit = strings.join(counts, ["h", "string"])
    if keep_first:
        hit = hit.where(F.struct("doc_id", "text_key", "at") != F.col("first"))
    # starts in a row make one range; rows that repeat doc_id and text have the same starts
    run = F.col("at") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("at"))
    return hit.withColumn("run", run).groupBy("doc_id", "text_key", "run").agg(
        F.min("at").alias("low"), (F.max("at") + least).alias("high"),
    ).drop("run")


def repeated_ranges(docs: DataFrame, least: int = LEAST, keep_first: bool = True) -> DataFrame:
    """(doc_id, text_key, low, high) byte ranges covered by repeated strings of ``least`` bytes; they may overlap.

    ``text_key`` tells rows apart that repeat a doc_id. With ``keep_first`` the first occurrence of each string,
    in order of doc_id, text_key and position, is not covered by it; rows that repeat doc_id and text are
    then one document. Without, every occurrence is.
    """
    texts = _keyed(docs)
    found = written(spread(texts).mapInArrow(_context_rows(least), _CONTEXTS), "contexts")
    forms = found.groupBy("h", "form").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "start")).alias("first"),
        F.max("starts").alias("starts"), F.bool_or("twice").alias("twice"),
    )
    group = Window.partitionBy("h")
    groups = written(
        forms.select("*", F.count("*").over(group).alias("forms"), F.sum(F.col("starts") + (least - 1)).over(group).alias("bytes"))
        .where("times > 1 OR forms > 1 OR twice")
        .withColumn("large", (F.col("forms") > LARGE_GROUP) | (F.col("bytes") > LARGE_BYTES)).drop("bytes"),
        "context-forms",
    )
    # copies of a whole context
    copies = found.join(groups.where("times > 1").select("h", "form", "first"), ["h", "form"])
    if keep_first:
        copies = copies.where(F.struct("doc_id", "text_key", "start") != F.col("first"))
    whole = copies.select(
        "doc_id", "text_key", F.col("start").cast("long").alias("low"),
        (F.col("start") + F.col("starts") - 1 + least).cast("long").alias("high"),
    )
    wanted = (
        groups.where("forms > 1 OR twice")
        .groupBy(F.col("first.doc_id").alias("_doc_id"), F.col("first.text_key").alias("_text_key"))
        .agg(F.collect_list(F.struct("h", F.col("first.start").alias("start"), "starts", "large")).alias("wanted"))
    )
    fetched = texts.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")),
    )
    pieces = written(fetched.select("doc_id", "text_key", "text", "wanted").mapInArrow(_slices(least), _PIECES), "context-bytes")
    pieces_small = (
        pieces.where("NOT large").dropDuplicates(["h", "doc_id", "text_key", "start"])
        .repartition("h").sortWithinPartitions("h", "doc_id", "text_key", "start")
    )
    sorted_ranges = pieces_small.mapInArrow(_sort_bundles(least, keep_first), _RANGES)
    large = pieces.where("large").dropDuplicates(["h", "doc_id", "text_key", "start"])
    return whole.unionByName(sorted_ranges).unionByName(_counted(large, least, keep_first))


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text("text")
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in _parts(batches):
        docs, size, removed, spans, kept = ([] for _ in names)
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
            raw = text.encode()
            parts, at, runs = [], 0, 0
            low = high = 0
            for r in sorted((r["low"], r["high"]) for r in ranges or ()):
                if runs and r[0] <= high:
                    high = max(high, r[1])
                    continue
                if runs:
                    parts.append(raw[at:low])
                    at = high
                runs += 1
                low, high = r
            if runs:
                parts.append(raw[at:low])
                at = high
            parts.append(raw[at:])
            left = b"".join(parts)
            docs.append(doc)
            size.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append(runs)
            kept.append(left)
        yield pa.RecordBatch.from_arrays([
            pa.array(docs, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.array(kept, pa.binary()),
        ], names=names)


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_first: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of ``docs``.

    Texts are UTF-8 bytes, null is empty; a cut may fall inside a character. Texts under ``least`` bytes
    stay whole. Strings are judged on the input, so what is left may still hold repeats of its own.
    Other columns are not read.
    """
    ranges = repeated_ranges(docs, least, keep_first)
    of_doc = ranges.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(
        F.collect_set(F.struct("low", "high")).alias("ranges"),
    )
    joined = _keyed(docs).join(
        of_doc, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left",
    )
    return joined.select("doc_id", "text", "ranges").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )
