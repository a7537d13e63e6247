"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can stand last in its encoding: the vocabulary entry that
ends there and is compatible with the unique last token of the prefix before it. A suffix automaton of
the vocabulary gives the entries that end at a position; a pair is compatible when no merge ever crosses
its border. Back-pointers (the token's own length) then read off the ids. The work is linear in the text,
whatever the piece looks like, and no merge is ever simulated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vouchsafe.llm.chunks import model_text
from vouchsafe.llm.tables import spread, whole_text

# fixed value: the byte-level cut of a text before any merge
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's tables (known words and pieces each, known pairs); a full table is emptied.
KNOWN = 500_000
PAIRS = 1_000_000
#: Documents that are encoded together in a task.
GROUP = 128

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: A word of letters and marks alone; the cut of such a word needs no character classes.
_COMMON = re.compile(rf" ?[{_LETTERS}{_MARKS}]*")
_CUT_COMMON = re.compile(rf" ?[{_LETTERS}]+| ?[{_MARKS}]+")


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class SuffixAutomaton:
    """Automaton of all substrings of the vocabulary; a state knows the entries that end with it."""

    def __init__(self, entries: Sequence[tuple[bytes, int]]):
        step: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        whole: dict[int, int] = {}

        def split(p: int, c: int, q: int) -> int:
            """State for the strings of ``q`` that are one step behind ``p``."""
            if size[q] == size[p] + 1:
                return q
            twin = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = twin
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            return twin

        ends: list[bytes] = []
        for text, _ in entries:
            last = 0
            for c in text:
                if c in step[last]:
                    last = split(last, c, step[last][c])
                    continue
                new = len(step)
                step.append({})
                link.append(0)
                size.append(size[last] + 1)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, c, step[p][c])
                last = new
            ends.append(text)
        self.step = {state << 8 | c: to for state, moves in enumerate(step) for c, to in moves.items()}
        self.link, self.size = link, size
        for text, token in entries:
            state = 0
            for c in text:
                state = step[state][c]
            whole[state] = token
        self.whole = whole
        self._ending: dict[int, tuple[tuple[int, int], ...]] = {-1: (), 0: ()}

    def ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the entries that are suffixes of the state's longest string, longest first."""
        found = self._ending.get(state)
        if found is None:
            found = self.ending(self.link[state])
            if state in self.whole:
                found = ((self.whole[state], self.size[state]), *found)
            self._ending[state] = found
        return found


class PrefixBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, model: str):
        read = json.loads(model)
        names = byte_names()
        spelled = read["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*spelled.values(), *self.special.values()]))
        for text, token in spelled.items():
            self.bytes_of[token] = bytes(names[c] for c in text)
        self.rank_of_pair: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(read["model"]["merges"]):
            left, right, token = spelled[a], spelled[b], spelled[a + b]
            self.rank_of_pair[left << 20 | right] = rank
            if token not in self.born:
                self.halves[token], self.born[token] = (left, right), rank
        made = [(b, t) for t, b in enumerate(self.bytes_of) if t in self.born or len(b) == 1]
        self.automaton = SuffixAutomaton(made)
        for text, token in self.special.items():
            self.bytes_of[token] = text.encode()
        self.decimal = [str(t) for t in range(len(self.bytes_of))]
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """True when the encoding of both tokens' bytes in a row is these two tokens.

        Seen backwards from the end, the tokens at the border fall apart in the reverse order of their
        merges. The border holds unless some pair that met there had a merge that came first; of equal
        merges the left one comes first.
        """
        left_end = right_end = 1 << 60
        born, rank_of_pair = self.born, self.rank_of_pair
        while True:
            rank = rank_of_pair.get(a << 20 | b)
            if rank is not None and rank < left_end and rank <= right_end:
                return False
            left, right = born.get(a, -1), born.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                left_end, a = left, self.halves[a][1]
            else:
                right_end, b = right, self.halves[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of a piece that the cut left whole."""
        automaton = self.automaton
        step, link, size, whole = automaton.step, automaton.link, automaton.size, automaton.whole
        ending, cached, fits = automaton.ending, automaton._ending, self.fits
        last: list[int] = []
        lengths: list[int] = []
        state = matched = 0
        for at, c in enumerate(data):
            to = step.get(state << 8 | c)
            while to is None:
                state = link[state]
                matched = size[state]
                to = step.get(state << 8 | c)
            state, matched = to, matched + 1
            full = state if matched == size[state] else link[state]
            found = cached.get(full)
            for token, length in found if found is not None else ending(full):
                before = at - length
                if before < 0:
                    good = True
                else:
                    pair = last[before] << 20 | token
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        good = fits[pair] = self.compatible(last[before], token)
                if good:
                    last.append(token)
                    lengths.append(length)
                    break
        ids = []
        at = len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= lengths[at]
        return ids[::-1]

    def word(self, text: str) -> bytes:
        """Ids of a text without white space but for a leading blank."""
        pieces = _CUT_COMMON.findall(text) if _COMMON.fullmatch(text) else self.cut.findall(text)
        known = self.pieces
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = known[p] = np.array(self.piece(p.encode()), dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        known = self.known
        line_feed = self.word("\n")
        out = []
        for text in texts:
            if " ".join(text.split()) != text.replace("\n", " ") or "<|" in text:
                out.append(np.frombuffer(self.uncut(text), dtype="<u4"))
                continue
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                words = [first, *[" " + w for w in rest]]
                for w in set(words).difference(known):
                    known[w] = self.word(w)
                lines.append(b"".join(map(known.__getitem__, words)))
            out.append(np.frombuffer(line_feed.join(lines), dtype="<u4"))
            if len(known) > KNOWN:
                known.clear()
            if len(self.pieces) > KNOWN:
                self.pieces.clear()
        return out

    def uncut(self, text: str) -> bytes:
        """Any text: special tokens first, then the cut, then pieces."""
        parts = self.cut_special.split(text) if self.cut_special else [text]
        ids: list[int] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for p in self.cut.findall(part):
                    ids += self.piece(p.encode())
        return np.array(ids, dtype="<u4").tobytes()

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of ``decode(ids, skip_special_tokens=False)``: broken sequences become replacement characters."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", errors="replace").encode()


_CODERS: dict[str, PrefixBpe] = {}


def coder(model: str) -> PrefixBpe:
    """The worker's coder for a vocabulary file's content; it outlives a task."""
    if model not in _CODERS:
        _CODERS.clear()
        _CODERS[model] = PrefixBpe(model)
    return _CODERS[model]


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"],
                )

    return run


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model.value)
        for batch in batches:
            texts = [bpe.decode_bytes(ids or ()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model.value)
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                count, of_ids, of_text = [], [], []
                for ids in bpe.encode(part.column(1).to_pylist()):
                    ids = ids.tolist()
                    count.append(len(ids))
                    of_ids.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(sha(bpe.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select("doc_id", whole_text("text").alias("text")))


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text. Null counts as empty, an empty text has no ids.

    One row per row, repeated rows included; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    return _texts(docs).mapInArrow(_encode(model), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of each list of ids; null ids give an empty text, special tokens their own text."""
    model = encoded.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, ids never leave the task."""
    model = docs.sparkSession.sparkContext.broadcast(model_text(tokenizer))
    return _texts(docs).mapInArrow(
        _digest(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
