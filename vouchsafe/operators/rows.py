"""Shared row helpers: cheap explosion, and joins, ranks and cut-offs that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
SALTS = 64


def rows_of(df: DataFrame, keep: Sequence[str], items: Column | str, position: str | None = None) -> DataFrame:
    """One row per list element, struct members as columns.

    The outer form with a filter on top keeps the list from being computed a second time for an
    inferred non-empty filter below.
    """
    out = df.select(*keep, F.posexplode_outer(items).alias("_pos", "_item")).where("_pos IS NOT NULL")
    place = [F.col("_pos").alias(position)] if position else []
    return out.select(*keep, *place, "_item.*")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection is an alias: filters pushed below it and inferred constraints repeat its
    expression at every mention. As the output of a one-row generator it is a value to what follows.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also where it is needed in several branches."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, *, copies: str, spread: Sequence[str],
    hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Left join of ``facts`` with a relation unique by ``key`` that counts its facts in ``copies``.

    Keys with more than ``hot_rows`` facts are spread over ``salts`` tasks by the ``spread`` columns, and so are
    facts without a key, which match nothing.
    The list of hot keys is broadcast: it holds at most rows / hot_rows entries.
    """
    hot = lookup.where(F.col(copies) > hot_rows).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0))
    salted = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    every = F.when(F.col(copies) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread_out = lookup.withColumn("_salt", F.explode(every))
    return salted.join(spread_out, [key, "_salt"], "left").drop("_salt")


def rank_within(
    df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[Column], name: str,
) -> DataFrame:
    """``row_number`` per key (long: a key may have any number of rows) without ever sorting a whole key in one task.

    ``coarse`` grows with the first order column. Rows are ranked inside (key, coarse) and shifted
    by the counts of the earlier coarse values, which are aggregated before they are windowed.
    """
    marked = df.withColumn("_coarse", coarse)
    counts = marked.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_coarse").orderBy(*order)
    return (
        marked.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_coarse"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_coarse", "_local", "_before")
    )


def cut(text: Column, width: int | None) -> Column:
    """The text, or its first ``width`` characters."""
    return text if width is None else F.substring(text, 1, width)


def newest_rows(df: DataFrame, n: int, levels: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in descending order of ``levels``, exactly, whatever ``n`` is.

    Each level must split the previous one into few values (hour, second, key prefix, key). The cut
    is found level by level from counts, one row of which comes to the driver, so the rows themselves are
    filtered once by a plain condition and never sorted.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    marked = df.withColumns(dict(zip(names, levels)))
    newer_kept, at_edge, left = F.lit(False), F.lit(True), n
    for name in names:
        counts = marked.where(at_edge).groupBy(name).agg(F.count("*").alias("_n"))
        newer = Window.orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, -1)
        cut = (
            counts.where(F.col(name).isNotNull()).withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
            .where(F.col("_newer") < left).orderBy(name).select(name, "_newer").head()
        )
        if cut is None:
            at_edge = F.lit(False)
            break
        edge = F.lit(cut[0]).cast(marked.schema[name].dataType)
        newer_kept = newer_kept | (at_edge & (F.col(name) > edge))
        at_edge = at_edge & (F.col(name) == edge)
        left -= cut["_newer"]
    # what is at the edge of every level is equal in order, and unique when the last level is a key
    return marked.where(newer_kept | at_edge).drop(*names)
