"""Conversation repair against an exhaustive search over edit strings."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vouchsafe.llm import conversations as c

GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out, ids = [], []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        ids.append(conv)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out, ids


def key(row):
    conv, turn, role, text = row
    own = f"{'null' if conv is None else f'={conv}'}:{len(role)}:{role}:{text}"
    return turn is not None, turn or 0, hashlib.sha256(own.encode()).digest()[:16]


def search(turns):
    """Uniform-cost search over (turns read, initials so far), letters as the tie: every edit string in order of cost."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, letters, at, made = heapq.heappop(heap)
        if at == len(turns) and GRAMMAR.fullmatch(made):
            return cost, letters, made
        if (at, made) in seen:
            continue
        seen.add((at, made))
        for r in "ua":
            if made.count("") < 2 * len(turns) + 6:
                heapq.heappush(heap, (cost + 3, letters + "I", at, made + r))
        if at < len(turns):
            initial, go, cut = turns[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, made))
            if not go:
                heapq.heappush(heap, (cost + 3 * cut, letters + "K", at + 1, made + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", at + 1, made + r))


def plain(rows, ids):
    found = Counter()
    for conv in set(ids) | {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        seen, turns, counts = set(), [], Counter()
        for _, _, role, text in own:
            tail = text.rstrip(SPACE)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1] or " ", fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, letters, made = search(turns)
        out, place, waiting = [], 0, iter(own)
        for letter in letters:
            row = next(waiting) if letter != "I" else None
            if letter == "D":
                continue
            word = {"s": "system", "u": "user", "a": "assistant"}.get(made[place])
            out.append(f"{row[2]}:{row[3]}" if letter == "K" else f"{word}:{row[3] if row else ''}")
            place += 1
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found[conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest] += 1
    return found


def made_up(seed, most=6):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "assistant", "tool", "", None, "Usr", "under"])
            text = rng.choice(["Hi.", "Well", "So?", " ", "", None, "a\n.", "Yes! \t", " ", "End. ", "Hi.", f"t{turn}."])
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 3]), role, text))
    return rows


def test_search_knows_the_example():
    assert search([("u", False, False), ("u", False, False)])[:2] == (3, "KR")
    assert search([]) == (0, "", "") and search([("u", True, False)])[:2] == (4, "D")


@pytest.mark.parametrize("seed,block,near", [(1, 10, 6), (2, 1, 1), (3, 0, 2)])
def test_repair(spark, monkeypatch, seed, block, near):
    monkeypatch.setattr(c, "BLOCK_BITS", block)
    monkeypatch.setattr(c, "NEIGHBOUR_BITS", near)
    rows = made_up(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "pos": F.lit("x"), "audit": F.lit(2), "blank": F.lit(3)}).repartition(3)
    damaged, dropped = c.damage(table)
    kept, ids = plain_damage(rows)
    assert Counter(map(tuple, damaged.select("conv_id", "turn", "role", "text").collect())) == Counter(kept)
    got = c.with_digests(damaged, c.repaired_conversations(damaged, dropped))
    assert Counter(map(tuple, got.collect())) == plain(kept, ids)


def test_turns_and_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", 3)
    monkeypatch.setattr(c, "NEIGHBOUR_BITS", 2)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"t{t}.", f"t{t}"])) for t in range(700)]
    rows += [(8, 5, "user", "x" * 300_000 + "?"), (9, 1, "user", "ok."), (9, 1, "user", "ok."), (9, 2, "assistant", "ok.")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r for r in c.repaired_conversations(table).collect()}
    monkeypatch.setattr(c, "BLOCK_BITS", 20)
    again = {r.conv_id: r for r in c.repaired_conversations(table).collect()}
    assert found == again and found[9].audit == "KDK" and found[8].audit == "KI"
    turns = sorted((r.conv_id, r.place, r.edit, r.role, len(r.text)) for r in c.repaired_turns(table).collect())
    assert [t for t in turns if t[0] == 9] == [(9, 0, "K", "user", 3), (9, 1, "K", "assistant", 3)]
    seven = [t for t in turns if t[0] == 7]
    assert [t[1] for t in seven] == list(range(len(seven))) and "".join(t[2] for t in seven) == found[7].audit.replace("D", "")
    assert GRAMMAR.fullmatch("".join(t[3][0] for t in seven))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    damaged, dropped = c.damage(none)
    assert c.with_digests(damaged, c.repaired_conversations(damaged, dropped)).count() == 0
    assert c.repaired_turns(none).count() == 0
