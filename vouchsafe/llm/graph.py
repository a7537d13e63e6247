"""Connected components of an edge table, without ever holding a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); nodes of one component share a root.

    Each round points every node at its smallest neighbour, follows the pointers to their ends and replaces
    the edges by those between the ends. Pointers and edges are tables; only their counts reach the driver.
    """
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges",
    )
    found = written(edges.sparkSession.createDataFrame([], "node long, root long"), "roots")
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        while True:
            ahead = point.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
            jumped = point.join(ahead, F.col("to") == F.col("_a")).select("a", "_to", (F.col("to") != F.col("_to")).alias("moved"))
            jumped = written(jumped, "pointers")
            point = jumped.select("a", F.col("_to").alias("to"))
            if jumped.where("moved").isEmpty():
                break
        ends = point.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        if first:
            found, first = ends.select(F.col("_a").alias("node"), F.col("_to").alias("root")), False
        else:
            found = written(
                found.join(ends, F.col("root") == F.col("_a"), "left").select("node", F.coalesce("_to", "root").alias("root")),
                "roots",
            )
        edges = (
            edges.join(ends, F.col("a") == F.col("_a")).select(F.col("_to").alias("a"), "b")
            .join(ends, F.col("b") == F.col("_a")).select("a", F.col("_to").alias("b"))
        )
        edges = written(
            edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges",
        )
    return found
