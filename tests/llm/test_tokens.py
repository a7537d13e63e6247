"""Encoding, packing and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import corpus, frame
from vouchsafe.llm import bpe, packing, token_files
from vouchsafe.llm.catalog import tokenizer_path
from vouchsafe.llm.chunks import ByteChunkEncoder, WordChunkEncoder, model_text

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def plain(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def ids(tokenizer: Tokenizer, text: str | None) -> list[int]:
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n: int) -> list[str]:
    rng = random.Random(0)
    parts = [
        "a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "9", "!", "***", "É", "ß", "İ", "Σ", "<|endoftext|>", "<|startoftext|>",
        "́", "日本", "😀", "\x02", "\x1f", "\xa0", " ", ",", ".", "the", "ing", "aaaa", "    ", "====", "\x00",
    ]
    return ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(n)] + ["a" * 3000, "ab" * 2000, " " * 500, "=-" * 300]


@pytest.mark.parametrize("kind, path", [(ByteChunkEncoder, BYTE), (WordChunkEncoder, WORD)])
def test_chunked_ids_equal_the_library(kind, path):
    texts = odd_texts(1500) + [t or "" for _, t in corpus()]
    found = kind(model_text(path)).encode(texts)
    library = plain(path)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [ids(library, t) for t in texts]


def test_prefix_bpe_equals_the_library():
    coder, library = bpe.PrefixBpe(model_text(BYTE)), plain(BYTE)
    texts = odd_texts(1500) + [t or "" for _, t in corpus()]
    for text, found in zip(texts, coder.encode(texts)):
        assert found.tolist() == ids(library, text)
        assert coder.decode_bytes(found.tolist()).decode() == library.decode(found.tolist(), skip_special_tokens=False) == text
    broken = [220, 161, 250, 50256]
    assert coder.decode_bytes(broken).decode() == library.decode(broken, skip_special_tokens=False)


def test_prefix_bpe_table(spark):
    rows = corpus()
    docs = frame(spark, rows)
    library = plain(BYTE)
    encoded = bpe.bpe_encode(docs, BYTE)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(ids(library, t))) for i, t in rows)
    back = bpe.bpe_decode(encoded, BYTE).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = Counter(map(tuple, bpe.bpe_digests(docs, BYTE).collect()))
    assert found == Counter(
        (i, len(ids(library, t)), sha(",".join(map(str, ids(library, t)))), sha(t or "")) for i, t in rows
    )
    assert bpe.bpe_digests(docs.limit(0), BYTE).count() == 0
    assert [r.text for r in bpe.bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTE).collect()] == [""]


def plan_is_gapless(rows, capacity):
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_is_best_fit():
    rng = random.Random(1)
    for capacity in (8, 37, 60):
        counts = {n: rng.choice([0, 1, 2, 7, 40]) for n in range(1, capacity + 1)}
        counts = {n: c for n, c in counts.items() if c}
        rows, ranks = [], {}
        for length, first, n, sequence, offset in packing.plan_slots(counts, capacity):
            ranks.setdefault(length, []).extend(range(first, first + n))
            rows += [(sequence + k, offset, length) for k in range(n)]
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items()}
        used = plan_is_gapless(rows, capacity)
        room: list[int] = []  # one document at a time into the fullest sequence that has room
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fitting = [r for r in room if r >= length]
                if fitting:
                    room.remove(min(fitting))
                    room.append(min(fitting) - length)
                else:
                    room.append(capacity - length)
        assert used == len(room)
    assert packing.plan_slots({}, 8) == []


def test_packing_table(spark):
    rows = [r for r in corpus() if r[0] is not None]
    library = plain(BYTE)
    found = packing.pack_documents(frame(spark, rows), BYTE, capacity=64).collect()
    plan_is_gapless([(r.sequence_id, r.offset, r.length) for r in found], 64)
    expected = Counter()
    for key, text in rows:
        all_ids = ids(library, text) + [0]
        ends = [*range(len(all_ids), 0, -64), 0][::-1]
        for piece, (a, b) in enumerate(zip(ends, ends[1:])):
            expected[key, piece, a, b - a, zlib.crc32(np.array(all_ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert packing.pack_documents(frame(spark, rows).limit(0), BYTE).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for high in (1, 2, 50_000, 2**32 - 1):
            values = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
            values[::97] = high
            packed = token_files.pack_ids(values)
            assert (token_files.unpack_ids(packed, n) == values).all()
    skewed = np.where(np.arange(4096) % 64 == 0, 60_000, np.arange(4096) % 16).astype("<u4")
    packed = token_files.pack_ids(skewed)
    assert set(packed["widths"]) == {4} and len(packed["exception_at"]) == 4 * 64


def test_token_files(spark):
    rows = [r for r in corpus() if r[0] is not None]
    library = plain(WORD)
    files = token_files.write_token_files(frame(spark, rows), WORD)
    found = sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(i for i, _ in rows)
    start = 0
    for doc_id, at, n, got in found:
        assert at == start and n == len(got) and got[-1] == 1
        start += n
    assert Counter((d, tuple(g)) for d, _, _, g in found) == Counter((i, (*ids(library, t), 1)) for i, t in rows)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_token_files(files, with_ids=False).collect()}
    assert crc == {(d, a): zlib.crc32(np.array(g, "<u4").tobytes()) for d, a, _, g in found}
    empty = token_files.write_token_files(frame(spark, rows).limit(0), WORD)
    assert token_files.read_token_files(empty).count() == 0
