"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors get one more component that brings all of them to the largest norm, queries a zero; the largest
inner products are then the nearest neighbours in the plane sense, and triangle bounds hold. Data and
queries are assigned to the nearest of a few pivots. From summaries alone (the farthest query of a group,
the k + 1 smallest pivot distances of each cell) follows a bound on the k-th distance of any query of a
group, and from it the pivot distance below which a vector of a cell can't matter to the group. Only the
others are copied to the group. Groups and their data are split into blocks of bounded size, each block is
solved by one matrix product, and the blocks' lists are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.tables import spread, written

#: Pivots of the data; vectors from which they are chosen (those with the smallest hashes of their id).
PIVOTS, SAMPLE = 64, 4096
#: Queries and vectors of one block at most, in the mean.
QUERIES, VECTORS = 1024, 16384


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        packed, square = [], []
        for values in batch.column(1).to_pylist():
            v = np.trim_zeros(np.array(values, dtype="<f8"), "b")  # missing components at the end are zero
            packed.append(v.tobytes())
            square.append(float(v @ v))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + n)), batch.column(0), pa.array(packed, pa.binary()), pa.array(square, pa.float64()),
            pa.array([len(p) // 8 for p in packed], pa.int32()), batch.column(2),
        ], names=["row", "vec_id", "v", "square", "size", "asks"])
        row += n


_POINTS = "row long, vec_id long, v binary, square double, size int, asks boolean"


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for k, raw in enumerate(vectors):
        v = np.frombuffer(raw, "<f8")
        out[k, : len(v)] = v
    return out


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component that brings every vector to the largest norm."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other: each next one is the farthest from those before."""
    if not len(x):
        return x
    chosen = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(shape):
    """Cell and pivot distance of each vector as data, group and distance of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, longest, cells, groups = shape.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v").to_pylist(), size)
            data = _distances(_lift(x, longest), cells)
            query = _distances(np.hstack([x, np.zeros((len(x), 1))]), groups)
            cell, group = data.argmin(axis=1), query.argmin(axis=1)
            at = np.arange(len(x))
            columns = [batch.column(c) for c in ("row", "vec_id", "v", "asks")]
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array(cell.astype(np.int32)), pa.array(data[at, cell]), pa.array(group.astype(np.int32)),
                pa.array(query[at, group]),
            ], names=["row", "vec_id", "v", "asks", "cell", "far", "group", "off"])

    return run


_ASSIGNED = "row long, vec_id long, v binary, asks boolean, cell int, far double, group int, off double"


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; floating point where no sum can leave its whole numbers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * x.shape[1] >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        out = whole(q) @ whole(x).T
        if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
            raise OverflowError("an inner product doesn't fit 64 bits")
        return out.astype(np.int64)
    return (q @ x.T).astype(np.int64)


def _solve(k: int, size: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        x = _matrix(data.column("v").to_pylist(), size)
        order = np.lexsort((data.column("row").to_numpy(), data.column("vec_id").to_numpy()))
        x, rows, ids = x[order], data.column("row").to_numpy()[order], data.column("vec_id").to_numpy()[order]
        own, name = queries.column("qrow").to_numpy(), queries.column("query_id").to_numpy()
        out = []
        score = _products(_matrix(queries.column("q").to_pylist(), size), x)
        for n in range(len(own)):
            s = score[n]
            if len(s) > k + 1:
                least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                take = np.flatnonzero(s >= least)  # all that tie with the last
            else:
                take = np.arange(len(s))
            take = take[rows[take] != own[n]]
            take = take[np.argsort(-s[take], kind="stable")[:k]]  # ids ascend, so ties keep the smaller
            out.append((np.full(len(take), name[n]), np.full(len(take), own[n]), ids[take], rows[take], s[take]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def whole_components(embedding: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def usable(embedding: Column) -> Column:
    """Vectors without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(True))


def top_k(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each asking row with the others.

    ``vectors`` has vec_id and ``v`` (array<double> of whole numbers). Rows whose ``v`` is null take no part,
    vectors of different length are filled up with zeros, all are returned where there are fewer than ``k``, ties
    go to the smaller vec_id. Rows that repeat a vec_id are rows of their own: each of them is a
    candidate for the other, and each asks for itself.
    """
    spark = vectors.sparkSession
    ready = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks"))
    points = written(spread(ready).mapInArrow(_points, _POINTS), "points")
    most = points.agg(
        F.max("square").alias("longest"), F.max("size").alias("size"), F.count_if("asks").alias("asking"), F.count("*").alias("n"),
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not most["asking"] or not most["n"]:
        return empty
    size, longest = max(1, most["size"]), float(most["longest"])
    sample = points.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("v").collect()  # SAMPLE rows
    lifted = _lift(_matrix([r["v"] for r in sample], size), longest)
    cells = choose_pivots(lifted, PIVOTS)
    groups = choose_pivots(lifted, min(PIVOTS, -(-most["asking"] // (2 * QUERIES))))
    shape = spark.sparkContext.broadcast((size, longest, cells, groups))
    assigned = written(points.mapInArrow(_assign(shape), _ASSIGNED), "assigned")

    # summaries: one row per group, k + 1 per cell
    asked = {r["group"]: (r["n"], r["reach"]) for r in assigned.where("asks").groupBy("group").agg(
        F.count("*").alias("n"), F.max("off").alias("reach"),
    ).collect()}
    nearest = assigned.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("_n") <= k + 1)
    close = [(r["cell"], r["far"]) for r in nearest.select("cell", "far").collect()]
    between = _distances(groups, cells)
    limits = []
    for group, (_, reach) in asked.items():
        bound = np.sort([reach + between[group, cell] + far for cell, far in close])
        kth = bound[k] if len(bound) > k else np.inf
        slack = 1e-9 * (1 + kth + reach) + 1e-6
        for cell in range(len(cells)):
            limits.append((group, cell, float(between[group, cell] - reach - kth - slack)))
    bounds = spark.createDataFrame(limits, "_group int, _cell int, least double")  # PIVOTS * PIVOTS rows at most

    needed = assigned.join(F.broadcast(bounds), (F.col("cell") == F.col("_cell")) & (F.col("far") >= F.col("least")))
    parts = {group: -(-n // QUERIES) for group, (n, _) in asked.items()}
    blocks = max(1, -(-most["n"] // VECTORS))
    part_of = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    data = needed.select(
        F.col("_group").alias("group"), F.explode(F.sequence(F.lit(0), F.element_at(part_of, F.col("_group")) - 1)).alias("part"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v",
    )
    queries = assigned.where("asks").select(
        "group", F.pmod(F.xxhash64("row"), F.element_at(part_of, F.col("group"))).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "vec_id", "v",
    ).toDF("qgroup", "qpart", "qblock", "qrow", "query_id", "q")
    by_query = queries.groupBy("qgroup", "qpart", "qblock")
    found = by_query.cogroup(data.groupBy("group", "part", "block")).applyInArrow(
        _solve(k, size), "query_id long, query_row long, vec_id long, row long, score long",
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
