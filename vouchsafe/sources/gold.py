"""Gold datasets: a manifest and one expected JSON file next to each source document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.settings import LINE_THRESHOLD, NAME_THRESHOLD
from vouchsafe.sources.files import name_of

_PARTY = T.StructType([T.StructField(f, T.StringType()) for f in ("name", "inn", "kpp")])
GOLD_SCHEMA = T.StructType([
    T.StructField("document_type", T.StringType()), T.StructField("number", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("supplier", _PARTY), T.StructField("buyer", _PARTY),
    T.StructField("total_amount", T.StringType()), T.StructField("vat_amount", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("line_items", T.ArrayType(T.StructType([
        T.StructField(f, T.StringType()) for f in fv.EVAL_LINE_FIELDS]))),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("name_similarity_threshold", T.DoubleType()),
    T.StructField("line_item_match_threshold", T.DoubleType()),
])
_SUFFIX = ".expected.json"


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/manifest.json", multiLine=True)
    return raw.select(
        "name", "version", F.coalesce("schema_version", F.lit("1")).alias("schema_version"),
        F.coalesce("name_similarity_threshold", F.lit(NAME_THRESHOLD)).alias("name_threshold"),
        F.coalesce("line_item_match_threshold", F.lit(LINE_THRESHOLD)).alias("line_threshold"),
    )


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_gold(spark: SparkSession, root: str) -> DataFrame:
    """Every expected file with its sample id, its source document and the reason why it is unusable."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/samples").select("path")
    named = listing.select("path", _folder(F.col("path")).alias("folder"), name_of(F.col("path")).alias("name"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + _SUFFIX).text(
        f"{root}/samples", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    gold = text.select(
        "path", _folder(F.col("path")).alias("folder"),
        F.regexp_replace(name_of(F.col("path")), r"\.expected\.json$", "").alias("sample_id"),
        F.from_json("value", GOLD_SCHEMA).alias("expected"), F.try_parse_json("value").isNotNull().alias("_json"),
    )
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    sources = named.where(suffix.isin(*fv.DOCUMENT_SUFFIXES)).select(
        "folder", F.regexp_replace("name", r"\.[^.]*$", "").alias("sample_id"), F.col("path").alias("document_path"))
    found = sources.groupBy("folder", "sample_id").agg(
        F.count("*").alias("_n"), F.min("document_path").alias("document_path"))
    repeated = gold.groupBy("sample_id").agg(F.count("*").alias("_same"))
    joined = gold.join(found, ["folder", "sample_id"], "left").join(repeated, "sample_id")
    kind = F.col("expected.document_type")
    error = (
        F.when(F.col("_same") > 1, "duplicate_sample_id")
        .when(F.coalesce("_n", F.lit(0)) != 1, "document_file_count")
        .when(~F.col("_json") | (kind.isNotNull() & ~kind.isin(*fv.DOCUMENT_TYPES)), "invalid_expected_json")
    )
    return joined.select("sample_id", F.col("path").alias("expected_path"), "document_path", "expected", error.alias("error"))


def load_gold(spark: SparkSession, root: str) -> DataFrame:
    """Expected documents (sample_id, nested bare values) in path order; a faulty or empty set is refused."""
    scanned = scan_gold(spark, root)
    faults = scanned.groupBy().agg(
        F.count("*").alias("n"), F.count("error").alias("bad"), F.min(F.struct("expected_path", "error")).alias("any"),
    ).first()
    if faults["n"] == 0:
        raise ValueError(f"no expected files under {root}")
    if faults["bad"]:
        first = scanned.where("error IS NOT NULL").orderBy("expected_path").first()
        raise ValueError(f"{first['expected_path']}: {first['error']}")
    return scanned.orderBy("expected_path").select("sample_id", "document_path", "expected.*")
