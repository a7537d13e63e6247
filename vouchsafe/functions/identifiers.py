"""Keys, tax numbers, currencies and file types as native column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv
from vouchsafe.functions.text import strip
from vouchsafe.settings import SCHEMA_VERSION


def _digit(text: str, place: int) -> str:
    return f"(ascii(substr({text}, {place}, 1)) - 48)"


def _weighted(text: str, weights: Sequence[int]) -> str:
    terms = " + ".join(f"{w} * {_digit(text, i)}" for i, w in enumerate(weights, start=1))
    return f"({terms}) % 11 % 10"


def inn_valid(text: str) -> Column:
    """Tax-number checksum for 10 and 12 digits of a column (or SQL text); else false, null stays null."""
    ten = f"{_weighted(text, fv.INN10_WEIGHTS)} = {_digit(text, 10)}"
    twelve = (
        f"{_weighted(text, fv.INN12_FIRST_WEIGHTS)} = {_digit(text, 11)}"
        f" AND {_weighted(text, fv.INN12_SECOND_WEIGHTS)} = {_digit(text, 12)}"
    )
    return F.expr(
        f"CASE WHEN {text} RLIKE '^[0-9]{{10}}$' THEN {ten} WHEN {text} RLIKE '^[0-9]{{12}}$' THEN {twelve} "
        f"WHEN {text} IS NOT NULL THEN false END")


def fix_kpp(c: Column) -> Column:
    """A registration number (13 or 15 digits) in the KPP place means the KPP is missing."""
    return F.when(c.rlike("^([0-9]{13}|[0-9]{15})$"), F.lit(None).cast("string")).otherwise(c)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(entries: Mapping[str, str]) -> Column:
    """A small fixed table as a map literal: looking it up needs no join."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in entries.items()) + ")")


def normalize_currency(c: Column) -> Column:
    aliases = literal_map(fv.CURRENCY_ALIASES)
    return F.upper(F.coalesce(F.try_element_at(aliases, F.lower(strip(c))), c))


def sample_key(name: Column, version: Column, sample: Column) -> Column:
    """Name-based identifier (version 5, URL namespace) of ``name:version:sample``."""
    digest = F.sha1(F.concat(
        F.lit(uuid.NAMESPACE_URL.bytes),
        F.encode(F.concat_ws(":", name, version, sample), "UTF-8"),
    ))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def cache_key(content_hash: Column, prompt_version: Column, model: Column) -> Column:
    return F.concat_ws(":", F.lit(SCHEMA_VERSION), prompt_version, model, content_hash)


def file_suffix(name: Column) -> Column:
    """Lower-case suffix with its dot, or '' (a leading dot does not start a suffix)."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*?(\.[^./\\]+)$", 1))


def object_key(sha256: Column, name: Column) -> Column:
    return F.concat(
        F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), sha256, file_suffix(name),
    )


def content_type_of(name: Column) -> Column:
    return F.try_element_at(literal_map(fv.SUFFIX_TYPES), file_suffix(name))
