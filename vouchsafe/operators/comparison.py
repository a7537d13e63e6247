"""Comparison of runs and of cost/quality strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.functions.numbers import delta
from vouchsafe.operators.evaluation import COUNTS, f1_column, macro_accuracy, ratio_columns

EPSILON = 1e-12
DATASET = ["dataset_name", "dataset_version", "schema_version"]


def same_dataset(headers: DataFrame) -> DataFrame:
    """Dataset keys that differ among the given runs: more than one row means they do not compare."""
    return headers.select(*DATASET).distinct()


def compatible(header_a: DataFrame, header_b: DataFrame) -> DataFrame:
    """One row when both runs belong to the same dataset, version and schema, none otherwise."""
    a = header_a.select(*DATASET, F.col("run_id").alias("run_a_id"))
    return a.join(header_b.select(*DATASET, F.col("run_id").alias("run_b_id")), DATASET)


def _status(deltas: list[Column], one_sided: Column) -> Column:
    known = [F.when(F.abs(d) > EPSILON, d) for d in deltas]
    best, worst = F.greatest(*known), F.least(*known)
    return (
        F.when(one_sided, "mixed")
        .when(best.isNull(), "unchanged")
        .when((best > 0) & (worst < 0), "mixed")
        .when(best > 0, "improved")
        .otherwise("regressed")
    )


def compare_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per field counts, ratios, differences and status of two runs (field, four counts each)."""
    left = a.select("field", *[F.col(c).alias(f"a_{c}") for c in COUNTS], F.lit(True).alias("_in_a"))
    right = b.select("field", *[F.col(c).alias(f"b_{c}") for c in COUNTS], F.lit(True).alias("_in_b"))
    both = left.join(right, "field", "full_outer").fillna(0, [f"{s}_{c}" for s in "ab" for c in COUNTS])
    ratios_a, ratios_b = ratio_columns("a_"), ratio_columns("b_")
    names = ("accuracy", "precision", "recall")
    wide = both.withColumns({
        **{f"{n}_a": ratios_a[n] for n in names}, **{f"{n}_b": ratios_b[n] for n in names},
    }).withColumns({f"delta_{n}": F.col(f"{n}_b") - F.col(f"{n}_a") for n in names})
    one_sided = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return wide.select(
        "field", _status([F.col(f"delta_{n}") for n in names], one_sided).alias("status"),
        *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in COUNTS],
        *[F.col(c) for n in names for c in (f"{n}_a", f"{n}_b", f"delta_{n}")],
    )


def compare_runs(metrics: DataFrame, headers: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Field comparison of two runs of one dataset, sorted by field; empty if they do not compare."""
    of = lambda df, run: df.where(F.col("run_id").cast("string") == run)
    fields = compare_fields(of(metrics, run_a), of(metrics, run_b))
    allowed = compatible(of(headers, run_a), of(headers, run_b)).select(F.lit(True).alias("_ok"))
    return fields.where(F.coalesce(allowed.scalar(), F.lit(False))).orderBy("field")


def moved_fields(metrics: DataFrame, headers: DataFrame, run_a: str, run_b: str, step: float = 0.01) -> DataFrame:
    """(field, f1_a, f1_b, delta, direction) of the fields whose F1 moved by ``step`` or more, in order of the name."""
    f1 = lambda s: f1_column(F.col(f"precision_{s}"), F.col(f"recall_{s}"))
    fields = compare_runs(metrics, headers, run_a, run_b).select("field", f1("a").alias("f1_a"), f1("b").alias("f1_b"))
    moved = fields.withColumn("delta", delta(F.col("f1_b"), F.col("f1_a"))["diff"]).where(F.abs("delta") >= step)
    return moved.withColumn("direction", F.when(F.col("delta") > 0, "improved").otherwise("degraded")).orderBy("field")


def compare_runs_summary(metrics: DataFrame, headers: DataFrame, run_a: str, run_b: str, step: float = 0.01) -> DataFrame:
    """One row: cost, duration and accuracy of A and B, and how many field F1 values moved."""
    moved = moved_fields(metrics, headers, run_a, run_b, step)
    counts = moved.agg(
        F.count_if(F.col("direction") == "improved").alias("n_improved"), F.count_if(F.col("direction") == "degraded").alias("n_degraded"))
    side = lambda run, s: headers.where(F.col("run_id").cast("string") == run).agg(
        F.max("cost_usd").alias(f"cost_{s}"), F.max("duration_seconds").alias(f"duration_{s}"),
        F.max("accuracy").alias(f"accuracy_{s}"))
    a, b = side(run_a, "a"), side(run_b, "b")
    pick = lambda df, c: df.select(c).scalar().alias(c)
    return counts.select(
        "n_improved", "n_degraded",
        *[pick(a, c) for c in a.columns], *[pick(b, c) for c in b.columns],
    )


def cheap_coverage(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of documents the cheap model closed alone: all, none, or the free succeeded samples."""
    done = samples.where(F.col("status") == "succeeded").groupBy("run_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("cost_usd") == 0).alias("_free"))
    measured = F.coalesce(F.try_divide(F.col("_free").cast("double"), F.col("_n").cast("double")), F.lit(0.0))
    coverage = (
        F.when(F.col("strategy") == "cheap_only", F.lit(1.0))
        .when(F.col("strategy") == "expensive_only", F.lit(0.0))
        .otherwise(measured)
    )
    return runs.select("run_id", "strategy").join(done, "run_id", "left").select(
        "run_id", "strategy", coverage.alias("cheap_coverage"))


def compare_strategies(runs: DataFrame, samples: DataFrame, metrics: DataFrame) -> DataFrame:
    """Quality, cost, duration and saving per run of one dataset.

    The baseline is the first run of the costly strategy; without it, or at zero cost, there is
    no saving. Runs of several datasets give no rows.
    """
    per_document = (F.col("cost_usd") / F.nullif(F.col("sample_count"), F.lit(0)).cast("decimal(12,0)")).cast("decimal(32,12)")
    priced = runs.withColumn("average_cost_usd", per_document)
    baseline = priced.where(F.col("strategy") == "expensive_only").agg(
        F.min_by("average_cost_usd", F.struct("started_at", "run_id")).alias("b")).scalar()
    datasets = runs.agg(F.count_distinct(*DATASET).alias("n")).scalar()
    rows = (
        priced.where(datasets == 1)
        .withColumn("_base", baseline)
        .join(macro_accuracy(metrics, "run_id"), "run_id", "left")
        .join(cheap_coverage(runs, samples).drop("strategy"), "run_id", "left")
    )
    saved = (F.col("_base") - F.col("average_cost_usd")).cast("decimal(18,12)") / F.col("_base").cast("decimal(18,12)")
    saving = F.when(F.col("_base") > 0, F.bround(saved.cast("decimal(20,16)") * 100, 2).cast("decimal(12,2)"))
    return rows.select(
        "run_id", "strategy", "model",
        F.col("macro_accuracy").alias("average_accuracy"), "cheap_coverage", "average_cost_usd",
        "average_duration_seconds", saving.alias("savings_pct"),
    )
