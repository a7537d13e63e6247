"""Licence scan: sparse TF-IDF cosine of sentences and licence files to templates, inherited down directories.

Document frequencies are counted over the whole corpus for the words of the templates; a word outside them
weighs as much as a word that no document has. A sentence whose cosine to a template reaches the threshold
is a licence header. A file named like a licence is compared as a whole with full licence texts; one that is near
none of them is judged by its sentences. It holds for its directory and all below it that have none nearer. All steps are column expressions: a text without one of the few words that
a similar enough sentence must contain is never split.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.operators.rows import let, once

THRESHOLD = 0.6
#: Full texts of different licences reach 0.9 and more among themselves, as their common words weigh as much as others.
FILE_THRESHOLD = 0.95

# fixed values: usual notices, by SPDX identifier
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Full texts, one file for each identifier.
TEXTS = Path(__file__).with_name("license_texts")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

_WORD = "[a-z0-9]+"
_GAP = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def full_texts(folder: Path = TEXTS) -> dict[str, tuple[str, ...]]:
    return {p.stem: (p.read_text(encoding="utf-8"),) for p in sorted(folder.glob("*.txt"))}


def _literal_map(values: Mapping[str, object], value_type: str) -> Column:
    """A constant map; a text that the optimizer folds, as thousands of single literals are slow to plan."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{value_type}>")


def tokens(text: Column) -> Column:
    """Words of letters a-z and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")


def word_counts(texts: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows that hold each of ``words``. At most one row per word comes to the driver."""
    held = texts.select(F.explode(F.array_append(
        F.array_intersect(F.coalesce(F.split(F.lower("text"), _GAP), F.array().cast("array<string>")), F.array(*[F.lit(w) for w in words])),
        F.lit(""),
    )).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


class Templates:
    """Unit TF-IDF vectors of the notices under the corpus's document frequencies."""

    def __init__(self, rows: int, counts: Mapping[str, int], templates: Mapping[str, Sequence[str]], threshold: float):
        self.names, self.vectors = [], []
        self.other = math.log(1 + rows) + 1
        self.idf = {
            w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1 for t in templates.values() for n in t for w in _words(n)
        }
        for name, notices in templates.items():
            for notice in notices:
                weight = {w: n * self.idf[w] for w, n in Counter(_words(notice)).items()}
                length = math.sqrt(sum(x * x for x in weight.values()))
                self.names.append(name)
                self.vectors.append({w: x / length for w, x in weight.items()})
        self.needed = sorted(set().union(*(self._needed(v, threshold) for v in self.vectors)))

    @staticmethod
    def _needed(vector: Mapping[str, float], threshold: float) -> set[str]:
        """Heaviest words; what has none of them reaches at most the length of the rest, which is below the threshold."""
        rest = sorted(vector, key=lambda w: (vector[w], w))
        while rest and math.sqrt(sum(vector[w] ** 2 for w in rest)) >= threshold:
            rest.pop()
        return set(vector) - set(rest)

    def best(self, words: Column) -> Column:
        """struct(score, license) of the most similar notice; of equal ones the first in order of the templates."""
        idf = _literal_map(self.idf, "double")
        weights = _literal_map({w: [float(v.get(w, 0.0)) for v in self.vectors] for w in self.idf}, "array<double>")
        names = F.array(*[F.lit(n) for n in self.names])

        def score(list_of: Column) -> Column:
            ordered = F.array_sort(list_of)
            start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("times"), F.lit(0.0).alias("total"))
            weight = lambda w: F.coalesce(F.try_element_at(idf, w), F.lit(self.other))
            closed = lambda s: s["total"] + F.pow(s["times"] * weight(s["word"]), F.lit(2.0))
            length = F.sqrt(F.aggregate(ordered, start, lambda s, w: F.when(
                s["word"] == w, F.struct(w.alias("word"), (s["times"] + 1).alias("times"), s["total"].alias("total")),
            ).otherwise(F.struct(w.alias("word"), F.lit(1.0).alias("times"), closed(s).alias("total"))), closed))
            zero = F.array(*[F.lit(0.0)] * len(self.names))
            known = F.filter(list_of, lambda w: F.map_contains_key(idf, w))
            dots = F.aggregate(known, zero, lambda a, w: F.zip_with(
                a, F.transform(F.element_at(weights, w), lambda x: x * F.element_at(idf, w)), lambda x, y: x + y,
            ))
            top = let(dots, lambda d: F.struct(F.array_max(d).alias("score"), F.element_at(
                names, F.array_position(d, F.array_max(d)).cast("int")).alias("license")))
            return let(length, lambda n: F.struct(
                F.when(n > 0, F.round(top["score"] / n, 6)).otherwise(0.0).alias("score"), top["license"].alias("license"),
            ))

        return let(words, score)


def scan(
    files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD,
    texts: Mapping[str, Sequence[str]] | None = None, file_threshold: float = FILE_THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``path``, license, score, origin, licenses, inherited_from of every row of ``files`` (doc_id, path, text).

    ``origin``: "header" where a sentence of the text reaches the threshold (the best one counts, ``licenses`` has
    all), "file" for a file named like a licence (its whole text against ``texts``, by default the full licence texts;
    below ``file_threshold`` its whole text and its sentences against ``templates``), "inherited" where the nearest directory above holds such a
    file (of several in one directory the most similar, then the first path), null otherwise, with null
    license and score 0. Null text counts as empty, a null path has no directory. Repeated rows are rows of
    their own. Other columns are not read.
    """
    read = files.select("doc_id", "path", "text")
    words = sorted({w for t in templates.values() for n in t for w in _words(n)})
    rows, counts = word_counts(read.select("text"), words)
    notices = Templates(rows, counts, templates, threshold)
    # words of the full texts outside the notices weigh like a word that no document has
    wholes = Templates(rows, counts, full_texts() if texts is None else texts, file_threshold)
    any_needed = r"(?i)(?<![a-z0-9])(?:" + "|".join(notices.needed) + r")(?![a-z0-9])"
    none = F.array().cast("array<struct<score:double,license:string>>")
    text = F.coalesce("text", F.lit(""))
    is_file = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))
    sentences = F.filter(F.split(text, r"\n|(?<=[.!?])\s"), lambda s: s.rlike(any_needed))
    units = F.when(is_file, F.concat(F.array(text), sentences)).otherwise(sentences)
    whole = F.when(is_file, F.filter(F.array(wholes.best(tokens(text))), lambda b: b["score"] >= file_threshold)).otherwise(none)
    by_notice = F.when(text.rlike(any_needed), F.filter(
        F.transform(units, lambda u: notices.best(tokens(u))), lambda b: b["score"] >= threshold,
    )).otherwise(none)
    hits = F.when(F.size("_whole") > 0, F.col("_whole")).otherwise(by_notice)
    scored = once(once(read, _whole=whole), _hits=hits).withColumn(
        "_best", F.get(F.array_sort("_hits", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                                    .when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)), F.lit(0)),
    ).select(
        "doc_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("_dir"), is_file.alias("_file"),
        F.col("_best.license").alias("_license"), F.coalesce("_best.score", F.lit(0.0)).alias("_score"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["license"]))).alias("licenses"),
    )
    of_dir = inherited(scored)
    joined = scored.join(of_dir, F.col("_dir") == F.col("_of"), "left")
    own = F.col("_license").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.coalesce("_license", "_given").alias("license"),
        F.when(own, F.col("_score")).otherwise(F.coalesce("_given_score", F.lit(0.0))).alias("score"),
        F.when(own & F.col("_file"), "file").when(own, "header").when(F.col("_given").isNotNull(), "inherited").alias("origin"),
        "licenses",
        F.when(~own, F.col("_from")).alias("inherited_from"),
    )


def inherited(scored: DataFrame) -> DataFrame:
    """The licence that each directory has or gets from the nearest directory above it.

    Directories are made distinct first, so a directory with very many files is one row here. A directory has
    as many rows as it has parts.
    """
    held = scored.where("_file AND _license IS NOT NULL").groupBy(F.col("_dir").alias("_above")).agg(
        F.min_by(F.struct("_license", "_score", "path"), F.struct(-F.col("_score"), F.col("path"))).alias("_held"),
    )
    dirs = scored.where("_dir IS NOT NULL").select(F.col("_dir").alias("_of")).distinct()
    parts = F.split("_of", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = dirs.select("_of", F.posexplode(F.array_distinct(above)).alias("_depth", "_above"))
    return steps.join(held, "_above").groupBy("_of").agg(F.max_by("_held", "_depth").alias("_held")).select(
        "_of", F.col("_held._license").alias("_given"), F.col("_held._score").alias("_given_score"), F.col("_held.path").alias("_from"),
    )
