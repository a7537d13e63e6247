"""Documents to packed training sequences.

The quality classifier rejects documents, exact and near copies go, personal values get pseudonyms, and what is
left is packed. Each stage takes all that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.llm import quality
from vouchsafe.llm.catalog import pii_key, tokenizer_path
from vouchsafe.llm.exact_dedup import drop_exact_copies
from vouchsafe.llm.ngram_join import drop_near_copies
from vouchsafe.llm.packing import pack_documents
from vouchsafe.llm.pii import pseudonymise
from vouchsafe.llm.tables import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; the model learns from the labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    return docs.where(quality.score_column(docs, model) >= 0.5)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on 5-word shingles, the one with the smallest doc_id."""
    return drop_near_copies(docs, words=5, num=80, den=100)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced within their format; n_chars follows the text."""
    done = pseudonymise(docs, pii_key())
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else done


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2,048 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("good_documents", good_documents),
    ("without_exact_copies", without_exact_copies),
    ("without_near_copies", without_near_copies),
    ("with_pseudonyms", with_pseudonyms),
    ("packed_sequences", packed_sequences),
]

#: Scores, similarities and tokenization can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
