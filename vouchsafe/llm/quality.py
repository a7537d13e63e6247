"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of smoothed log shares (capital letters, marks, rules, repeated words,
lengths). Each class is a normal distribution whose covariance is shrunk towards the pooled covariance and
towards a multiple of the identity. The score is the logistic of the difference of the two log densities;
each is a Mahalanobis distance through the inverse of the class's Cholesky factor, which is computed once
and sent to the tasks. Labels, language, source and doc_id are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.chunks import release_encoder
from vouchsafe.llm.tables import spread, whole_text

#: Texts of a batch that are Python strings at a time.
GROUP = 256
#: Weight of the pooled covariance, and of the mean variance on the diagonal, in each class's covariance.
POOLED, RIDGE = 0.5, 0.1
#: Scores are cut off at the logistic of this many nats; farther differences carry no more meaning.
MOST_NATS = 30.0

NAMES = (
    "words", "capitals", "shouts", "bars", "signs", "other_marks", "digits", "distinct", "neighbours", "word_length",
    "lines", "line_repeats", "stops", "sign_words",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 small letter, 2 capital, 3 '!', 4 '|', 5 sign, 6 mark, 7 digit, 8 white space."""
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 7
    for c in "\"'(),-./:;?[]":
        kind[ord(c)] = 6
    for c in "#$%&*+<=>@\\^_`{}~":
        kind[ord(c)] = 5
    kind[ord("!")], kind[ord("|")] = 3, 4
    kind[[9, 10, 11, 12, 13, 32]] = 8
    return kind


_KIND = _classes()


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty text has the values of the smoothing alone."""
    words = text.split()
    n = len(words)
    counts = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=9)
    letters = int(counts[0] + counts[1] + counts[2])
    share = lambda part, whole, weight, usual: math.log((part + weight * usual) / (whole + weight))
    lines = text.split("\n")
    ends = sum(map(str.isalnum, [w[-1:] for w in words]))
    return [
        math.log1p(n),
        share(counts[2], letters, 60, 0.02),
        share(counts[3], n, 20, 0.005),
        share(counts[4], n, 20, 0.005),
        share(counts[5], n, 20, 0.005),
        share(counts[6], n, 20, 0.1),
        share(counts[7], letters, 60, 0.005),
        share(n - len(set(words)), n, 20, 0.3),
        share(sum(map(eq, words, words[1:])), n, 20, 0.005),
        math.log((letters + 100) / (n + 20)),
        math.log((len(lines) + 1) / (n / 50 + 1)),
        share(len(lines) - len(set(lines)), len(lines), 10, 0.01),
        share(n - ends, n, 20, 0.1),
        share(counts[3] + counts[4] + counts[5], n, 5, 0.002),
    ]


def _statistics_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """One row per text. What an encoder kept in this worker is freed, as workers are shared by the stages of a job."""
    release_encoder()
    texts, found = batch.column(column), np.empty((batch.num_rows, len(NAMES)))
    for at in range(0, batch.num_rows, GROUP):
        found[at : at + GROUP] = [statistics(t) for t in texts.slice(at, GROUP).to_pylist()]
    return found


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, log density constants and class weight; ``fixed`` when a class is missing."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    fixed: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        z = (x - self.centre) / self.scale
        density = [self.constant[k] - 0.5 * (((z - self.means[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        nats = np.clip(density[1] - density[0], -MOST_NATS, MOST_NATS)
        return 1 / (1 + np.exp(-nats))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums per class: row count, sums and products of the texts' statistics."""
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = _statistics_of(batch, 1)
        for k in (0, 1):
            own = x[label == k]
            total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    k, at = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays(
        [pa.array(k.ravel().astype(np.int32)), pa.array(at.ravel().astype(np.int32)), pa.array(total.ravel())],
        names=["label", "at", "value"],
    )


def fit(docs: DataFrame, labels: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Model from the rows of ``labels`` (doc_id, quality 0 or 1) whose doc_id is in ``docs``.

    Rows with another or no label are left out. Sums per class are merged in the cluster; what comes to
    the driver has a fixed size. Without rows of one class every score is that of the other, without
    any rows 0.5.
    """
    marked = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # only texts with a label are looked at
    learned = spread(docs.select("doc_id", whole_text("text").alias("text"))).join(marked, "doc_id").select("quality", "text")
    sums = (
        learned.mapInArrow(_moments, "label int, at int, value double")
        .groupBy("label", "at").agg(F.sum("value").alias("value"))
    )
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for row in sums.collect():  # 2 * (1 + d + d * d) rows
        total[row["label"], row["at"]] = row["value"]
    return _solve(total, pooled, ridge)


def _solve(total: np.ndarray, pooled: float, ridge: float) -> Model:
    d = len(NAMES)
    n = total[:, 0]
    nothing = np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    if not n.all():
        return Model(*nothing, fixed=0.5 if not n.any() else float(n[1] > 0))
    means = total[:, 1 : 1 + d] / n[:, None]
    spread_of = total[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    within = (n[:, None, None] * spread_of).sum(axis=0) / n.sum()
    centre = total[:, 1 : 1 + d].sum(axis=0) / n.sum()
    scale = np.sqrt(np.diag(within).clip(1e-8))
    inverse, constant = [], []
    for k in (0, 1):
        own = spread_of[k] / scale / scale[:, None]
        shared = within / scale / scale[:, None]
        cov = (1 - pooled) * own + pooled * shared
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d)
        root = np.linalg.cholesky(cov + 1e-6 * np.eye(d))
        inverse.append(np.linalg.inv(root))
        constant.append(math.log(n[k] / n.sum()) - np.log(np.diag(root)).sum())
    return Model(centre, scale, (means - centre) / scale, np.array(inverse), np.array(constant))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row; null text counts as empty."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model_of.value.scores(_statistics_of(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return spread(docs.select("doc_id", whole_text("text").alias("text"))).mapInArrow(run, "doc_id long, score double")


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score as a column beside all others of ``docs``."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model_of.value.scores(_statistics_of(pa.RecordBatch.from_arrays([texts], names=["t"]), 0)))

    return scored(whole_text(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row of ``docs``.

    The model learns from the labelled rows that aren't held out. A null doc_id is scored, learned from
    never, and counts as not held out. Repeated rows are scored each.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
