"""Token ids of whole texts from a public tokenizer file, with repeated words encoded once per worker.

Both tokenizer kinds cut a text at white space before the merges, so the ids of a text are the ids of
its words in a row. Words repeat: their ids are kept in a bounded table and only unseen words reach the
tokenizer, many in one call. Texts whose white space comes in runs, and texts that spell a special
token, go to the tokenizer in larger pieces or whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

#: Words that go through the tokenizer in one call, joined by a separator with a known single id.
TOGETHER = 256

_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,!*$%&#|;:?"
_BEFORE_WORD = re.compile(r" (?=\S)")


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, equal to ``encode(text, add_special_tokens=False)``.

    ``known[0]`` holds words at the start of a line, ``known[1]`` words behind a blank.
    """

    #: Entries of a table of known words in one worker; a full table is emptied, which costs time only.
    room = 500_000
    #: What stands between joined words, and before each of them, by table.
    between: tuple[str, str]
    before: tuple[str, str]

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line_feed = self.direct(["\n"])[0]
        self.separator = self.direct([self.between[0].strip(" ")])[0]
        if len(self.separator) != 4:
            raise ValueError("the separator must be a single token")

    def direct(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, words: set[str], table: int) -> None:
        known, between, before = self.known[table], self.between[table], self.before[table]
        new = list(words.difference(known))
        if len(known) + len(new) > self.room:
            known.clear()
            new = list(words)
        separator = int.from_bytes(self.separator, "little")
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            text = before + between.join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == separator).tolist()
            if len(ends) != len(part) - 1:  # a word spells the separator
                known.update(zip(part, self.direct([before + w for w in part])))
                continue
            raw, start = ids.tobytes(), 0
            ends.append(len(ids))
            for word, end in zip(part, ends):
                known[word] = raw[4 * start : 4 * end]
                start = end + 1

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        raise NotImplementedError


class ByteChunkEncoder(ChunkEncoder):
    """Byte-level cut: a single blank belongs to the word after it, a single line feed stands alone."""

    between = ("\n", "\n ")
    before = ("", " ")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        lines: list[list[list[str]] | None] = []
        first: set[str] = set()
        later: set[str] = set()
        for text in texts:
            if " ".join(text.split()) != text.replace("\n", " ") or self._spells(text):
                lines.append(None)
                continue
            cut = [line.split(" ") for line in text.split("\n")]
            for line in cut:
                first.add(line[0])
                later.update(line[1:])
            lines.append(cut)
        self.learn(first, 0)
        self.learn(later, 1)
        start, follow = self.known[0].__getitem__, self.known[1].__getitem__
        return [
            self._in_runs(text) if cut is None else self.line_feed.join(
                [start(line[0]) + b"".join(map(follow, line[1:])) for line in cut],
            )
            for text, cut in zip(texts, lines)
        ]

    def _spells(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self.special)

    def _in_runs(self, text: str) -> bytes:
        """White space in runs: the last blank before a word is still a border, the rest goes to the tokenizer."""
        if self._spells(text):
            return self.direct([text])[0]
        head, *words = _BEFORE_WORD.split(text)
        return b"".join(self.direct([head, *[" " + w for w in words]]))


class WordChunkEncoder(ChunkEncoder):
    """White space only separates."""

    room = 1_200_000
    between = (" \x02 ", " \x02 ")
    before = ("", "")

    def learn_words(self, words: set[str]) -> None:
        """Letters with marks behind them are two independent pieces, and only the small letters count."""
        known, parts = self.known[1], self.known[0]
        new = words.difference(known)
        if len(known) + len(new) > self.room:
            known.clear()
            new = words
        split, whole = [], set()
        for word in new:
            letters = word.rstrip(_MARKS)
            if _LATIN.fullmatch(letters):
                split.append((word, letters.lower(), word[len(letters) :]))
            else:
                whole.add(word)
        self.learn({p for _, letters, marks in split for p in (letters, marks)}, 0)
        self.learn(whole, 1)
        for word, letters, marks in split:
            known[word] = parts[letters] + parts[marks]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [
            None if "<|" in t and any(s in t for s in self.special) else t.replace("\n", " ").split(" ") for t in texts
        ]
        self.learn_words(set().union(*[c for c in cut if c is not None]))
        get = self.known[1].__getitem__
        return [self.direct([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


_ENCODERS: dict[tuple[type, str], ChunkEncoder] = {}


def encoder(kind: type[ChunkEncoder], model: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file's content; it outlives a task, until another operator frees it."""
    key = kind, model
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(model)
    return _ENCODERS[key]


def release_encoder() -> None:
    """Free the encoder and its tables of known words (over 100 MB in a worker) when other work begins there."""
    _ENCODERS.clear()


def model_text(path: str) -> str:
    """Content of a tokenizer file, read on the driver and sent to the tasks (a few MB, fixed by the vocabulary)."""
    with open(path, encoding="utf-8") as file:
        return file.read()
