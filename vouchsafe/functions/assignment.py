"""Small per-document helper: line scores and the best one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.functions.compare import similarity_ratio

PAIRS = T.ArrayType(T.StructType([
    T.StructField("e", T.IntegerType()), T.StructField("a", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("name_ratio", T.DoubleType()),
]))


def line_scores(
    expected: list[dict], actual: list[dict], seen: dict[tuple[str, str], float],
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted agreement of every expected line with every actual one, and the name ratios.

    Values arrive in comparable form; '' is a value that equals nothing. Only fields the expected
    line has count, so a line without any scores zero.
    """
    scores = np.zeros((len(expected), len(actual)))
    ratios = np.full(scores.shape, np.nan)
    columns = {
        name: np.array([line[name] for line in actual], dtype=object) for name in fv.LINE_WEIGHTS if name != "name"
    }
    for i, line in enumerate(expected):
        weight = 0.0
        if line["name"] is not None:
            weight += fv.LINE_WEIGHTS["name"]
            for j, other in enumerate(actual):
                if other["name"] is not None:
                    ratios[i, j] = similarity_ratio(line["name"], other["name"], seen)
            scores[i] += np.nan_to_num(ratios[i]) * fv.LINE_WEIGHTS["name"]
        for name, column in columns.items():
            if line[name] is not None:
                weight += fv.LINE_WEIGHTS[name]
                if line[name] != "" or name == "unit":
                    scores[i] += (column == line[name]) * fv.LINE_WEIGHTS[name]
        if weight:
            scores[i] /= weight
    return scores, ratios


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of maximum total weight, as many as the shorter side has members."""
    if weights.size == 0:
        return []
    if weights.shape[0] > weights.shape[1]:
        return sorted((j, i) for i, j in best_assignment(weights.T))
    favourite = weights.argmax(axis=1)
    if len(set(favourite.tolist())) == len(favourite):
        return list(enumerate(favourite.tolist()))
    cost = weights.max() - weights
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        reach = cost[start] - row_price[start] - col_price
        via, closed = np.full(cols, -1), np.zeros(cols, dtype=bool)
        while True:
            here = int(np.where(closed, np.inf, reach).argmin())
            closed[here] = True
            if owner[here] < 0:
                break
            r = owner[here]
            onward = reach[here] + cost[r] - row_price[r] - col_price
            shorter = ~closed & (onward < reach)
            reach[shorter], via[shorter] = onward[shorter], here
        length = reach[here]
        passed = closed & (owner >= 0)
        row_price[start] += length
        row_price[owner[passed]] += length - reach[passed]
        col_price[passed] += reach[passed] - length
        while via[here] >= 0:
            owner[here] = owner[via[here]]
            here = via[here]
        owner[here] = start
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


@F.pandas_udf(PAIRS)
def assign_lines(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Best pairs of a document's expected and actual lines; both lists are members of one row."""
    seen: dict[tuple[str, str], float] = {}
    result = []
    for exp, act in zip(expected, actual):
        exp, act = [] if exp is None else list(exp), [] if act is None else list(act)
        if not exp or not act:
            result.append([])
            continue
        scores, ratios = line_scores(exp, act, seen)
        result.append([
            {"e": i, "a": j, "score": float(scores[i, j]),
             "name_ratio": None if np.isnan(ratios[i, j]) else float(ratios[i, j])}
            for i, j in best_assignment(scores)
        ])
    return pd.Series(result)
