"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n int, token long, key string"


def words(n: int, seed: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    base = words(300, 1)
    near = base.split(" ")
    near[150] = "other"
    passage = words(120, 2)
    rows = [
        (0, base), (1, base.upper()), (2, " ".join(near)), (3, base + " tail"), (4, None), (5, ""), (6, "  \t\n "),
        (7, "one two"), (8, "One  two"), (9, "one two three four"), (10, words(80, 3) + "\n" + passage), (11, passage + "\n" + words(90, 4)),
        (12, "é日本 😀 <|endoftext|>  don't\n\n x   y " + "Ä" * 30), (13, words(9000, 5)), (14, "same " * 900), (15, "same " * 900),
        (16, words(250, 6)), (16, words(260, 7)), (17, words(250, 6)), (None, words(50, 8)), (None, base),
    ]
    return rows + [(100 + k, base) for k in range(40)] + [(200 + k, " ".join([*near[:k], "x", *near[k + 1 :]])) for k in range(0, 120, 4)]


def frame(spark, rows):
    """A table with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "r", 1, 2, "k") for i, t in rows], SCHEMA,
    ).repartition(4)


def plain_shingles(text: str | None, n: int) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not found:
        return frozenset()
    if len(found) < n:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def plain_components(sets: list[frozenset], num: int, den: int) -> list[int]:
    """Index of the first member of each row's component."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def plain_cover(texts: list[bytes], least: int) -> list[list[bool]]:
    seen: dict[bytes, int] = defaultdict(int)
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] += 1
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                hit[i : i + least] = [True] * least
        out.append(hit)
    return out
