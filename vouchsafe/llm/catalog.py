"""Queries of the training-data operators with their checking SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: the folder in VOUCHSAFE_TOKENIZERS, or the installed package."""
    folder = os.environ.get("VOUCHSAFE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key() -> str:
    """Key of the pseudonyms; a deployment names its own in VOUCHSAFE_PII_KEY."""
    return os.environ.get("VOUCHSAFE_PII_KEY", "vouchsafe")
