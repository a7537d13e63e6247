"""Text column expressions: clean-up for evidence search, names, parties and corrections."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchsafe import fixed_values as fv

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_ANY_SPACE = r"[\s\p{Z}]+"
#: The characters of that class one by one, for ``translate``, which drops them in one pass without a regex.
_SPACES = "\t\n\v\f\r" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def squeeze(c: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(c, _ANY_SPACE, " "))


def has_text(c: Column) -> Column:
    """Whether anything but white space is there; stops at the first such character."""
    return F.rlike(c, F.lit(r"[^\s\p{Z}]"))


def coerce_correction(c: Column) -> Column:
    """Trimmed text, blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def normalize_evidence_text(c: Column) -> Column:
    """Spelling-neutral form: lower case, no quotes or white space, plain dash, dot as decimal mark."""
    source = fv.EVIDENCE_DASHES + "," + fv.EVIDENCE_QUOTES + _SPACES
    target = "-" * len(fv.EVIDENCE_DASHES) + "."
    return F.translate(F.lower(c), source, target)


def value_variants(c: Column) -> Column:
    """Spellings under which a value may stand in the text, strictest first."""
    raw = strip(c)
    iso = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    dotted = F.concat_ws(".", F.substring(raw, 9, 2), F.substring(raw, 6, 2), F.substring(raw, 1, 4))
    short = F.regexp_replace(F.regexp_replace(dotted, r"^0", ""), r"\.0", ".")
    number = raw.rlike(r"^-?[0-9]+\.[0-9]+$")
    trimmed = F.regexp_replace(raw, r"\.?0+$", "")
    found = F.array_compact(F.array(
        raw,
        F.when(iso, dotted),
        F.when(iso, short),
        F.when(number & (trimmed != raw) & (trimmed != ""), trimmed),
        F.when(number, F.split_part(raw, F.lit("."), F.lit(1))),
    ))
    nothing = c.isNull() | (raw == "") | F.lower(raw).isin("true", "false")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(found)


def normalize_name(c: Column) -> Column:
    """Lower case, ё as е, everything but Latin, Cyrillic and digits is a separator."""
    folded = F.translate(F.lower(c), "ё", "е")
    return F.trim(F.regexp_replace(folded, "[^0-9a-zа-я]+", " "))


def has_name(c: Column) -> Column:
    """Whether the normalized name has any character; stops at the first one."""
    return F.rlike(F.lower(c), F.lit("[0-9a-zа-яё]"))


def party_key(c: Column) -> Column:
    """Party name for identity checks; punctuation is kept."""
    return squeeze(F.translate(F.lower(c), "ё", "е"))


def alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def visible_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s\p{Z}]"))


def unreadable_count(c: Column) -> Column:
    """Characters that are neither white space nor printable, and replacement characters."""
    return F.regexp_count(c, F.lit(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\x{FFFD}&&[^\s]]"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s\p{Z}]+"))
