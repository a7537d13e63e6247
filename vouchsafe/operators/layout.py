"""Text layout and evidence.

A layout is one row per document: ``pages`` is a list of pages with their blocks and tables. The
source index and the search for evidence work inside that row, so linking values to text costs one
join on the document key and never enumerates field/block pairs as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.functions import text as tx
from vouchsafe.operators.rows import let
from vouchsafe.schemas import BBOX, SOURCE, SOURCES
from vouchsafe.settings import MAX_IMAGE_MEGAPIXELS, MAX_PAGES, MAX_RENDER_MEGAPIXELS, RENDER_DPI

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
BLOCK = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("bbox", BOX),
    T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()),
])
TABLE = T.StructType([
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("bbox", BOX),
    T.StructField("source", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("number", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("tables", T.ArrayType(TABLE)),
    T.StructField("used_ocr", T.BooleanType()),
])
LAYOUT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("media_type", T.StringType()),
    T.StructField("pages", T.ArrayType(PAGE)),
])


# user-supplied recognition: batches of pages in, batches of recognised words out
OcrFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
OCR_WORDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("page_no", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("conf", T.StringType()), T.StructField("left", T.IntegerType()), T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
])


# --- text layer and routing ---------------------------------------------------
def text_layer_stats(pages: DataFrame, text: str = "text") -> DataFrame:
    """Visible and alphanumeric characters, words and readable share per page."""
    visible = tx.visible_count(F.col(text))
    return (
        pages.withColumn("n_visible", visible)
        .withColumn("n_alnum", tx.alnum_count(F.col(text)))
        .withColumn("n_words", tx.word_count(F.col(text)))
        .withColumn("readable_ratio", F.try_divide(
            (F.col("n_visible") - tx.unreadable_count(F.col(text))).cast("double"), F.col("n_visible").cast("double")))
        .drop(text)
    )


def is_usable() -> Column:
    good = (F.col("n_alnum") >= 50) & (F.col("n_words") >= 10) & (F.col("readable_ratio") >= 0.8)
    return F.coalesce(good, F.lit(False))


def route_pages(stats: DataFrame) -> DataFrame:
    """Page by page: keep the text layer or send to recognition."""
    return stats.withColumn("route", F.when(is_usable(), "text_layer").otherwise("ocr"))


def used_ocr(routed: DataFrame) -> DataFrame:
    return routed.groupBy("doc_id").agg(F.bool_or(F.col("route") == "ocr").alias("used_ocr"))


def check_page_limits(pages: DataFrame, docs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Documents without pages or with too many of them."""
    counted = docs.select("doc_id").join(pages.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    count = F.coalesce("n", F.lit(0))
    return counted.select(
        "doc_id", count.alias("n_pages"),
        F.when(count == 0, "no_pages").when(count > max_pages, "too_many_pages").alias("error"),
    ).where("error IS NOT NULL")


def plan_ocr(pages: DataFrame, dpi: int = RENDER_DPI, max_megapixels: int = MAX_RENDER_MEGAPIXELS) -> DataFrame:
    """Render scale per page (points), shrunk to the pixel limit but never below one to one."""
    limit = float(max_megapixels) * 1_000_000
    full = dpi / 72
    area = F.col("width") * F.col("height")
    shrunk = F.greatest(full * F.sqrt(F.lit(limit) / (area * full * full)), F.lit(1.0))
    scale = F.when(area * full * full > limit, shrunk).otherwise(F.lit(full))
    # the shrunk page meets the limit by construction unless the floor of one applied
    too_large = (scale == 1.0) & (area > limit) if full > 1.0 else area * scale * scale > limit
    return pages.withColumn("scale", scale).withColumn("error", F.when(too_large, "page_too_large"))


def check_images(images: DataFrame, max_megapixels: int = MAX_IMAGE_MEGAPIXELS) -> DataFrame:
    mega = F.col("width") * F.col("height") / 1_000_000
    return images.withColumn("error", F.when(mega > max_megapixels, "image_too_large"))


def text_volume(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages and characters per file, with the scan verdict; ``page_no`` orders the list."""
    sizes = pages.select("doc_id", "page_no", F.char_length(text).alias("n"))
    return sizes.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.sum("n").alias("n_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "n"))), lambda s: s["n"].cast("string")), ", ").alias("per_page"),
    ).withColumn("verdict", F.when(F.col("n_chars") < 200, "scan").otherwise("text_layer"))


# --- boxes, recognised words, tables -----------------------------------------
def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def normalize_bbox(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return F.struct(
        _unit(x0 / width).alias("x0"), _unit(y0 / height).alias("y0"),
        _unit(x1 / width).alias("x1"), _unit(y1 / height).alias("y1"),
    )


def word_blocks(words: Column, width: Column, height: Column, page_text: Column) -> Column:
    """Recognised words of one page (list) -> blocks; a page without any keeps its whole text."""

    def block(w: Column) -> Column:
        score = F.coalesce(w["conf"].try_cast("double"), F.lit(0.0))
        left, top = w["left"].cast("double"), w["top"].cast("double")
        return F.when((tx.strip(w["text"]) != "") & (score >= 0), F.struct(
            tx.strip(w["text"]).alias("text"),
            normalize_bbox(left, top, left + w["width"], top + w["height"], width, height).alias("bbox"),
            _unit(score / 100).alias("confidence"),
            F.lit("ocr").alias("source"),
        ))

    blocks = F.array_compact(F.transform(words, block))
    whole = F.struct(
        tx.strip(page_text).alias("text"),
        F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1")).alias("bbox"),
        F.lit(0.5).alias("confidence"),
        F.lit("ocr").alias("source"),
    )
    fallback = F.when(tx.strip(page_text) != "", F.array(whole)).otherwise(F.array().cast(T.ArrayType(BLOCK)))
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, blocks.cast(T.ArrayType(BLOCK))).otherwise(fallback.cast(T.ArrayType(BLOCK)))


def ocr_words_to_blocks(pages: DataFrame) -> DataFrame:
    """(…, words, width, height, page_text) -> the same page with ``blocks``."""
    return pages.withColumn(
        "blocks", word_blocks(F.col("words"), F.col("width"), F.col("height"), F.col("page_text")),
    ).drop("words", "page_text")


def recognise_pages(pages: DataFrame, ocr_fn: OcrFn, concurrency: int | None = None) -> DataFrame:
    """Words of the pages routed to recognition, from a user function over batches.

    ``ocr_fn`` maps batches of (doc_id, page_no, image reference) to batches of ``OCR_WORDS`` columns.
    """
    waiting = pages.where(F.col("route") == "ocr").select("doc_id", "page_no", "image")
    spread = waiting.repartition(concurrency, "doc_id", "page_no") if concurrency else waiting
    return spread.mapInPandas(ocr_fn, OCR_WORDS)


def clean_rows(rows: Column) -> Column:
    """Null cells become '', cells are trimmed, rows without any text are dropped."""
    filled = F.transform(rows, lambda row: F.transform(row, lambda c: F.coalesce(tx.strip(c), F.lit(""))))
    return F.filter(filled, lambda row: F.exists(row, lambda c: c != ""))


def clean_table_rows(tables: DataFrame) -> DataFrame:
    """Cleaned ``rows`` per table; tables that end up empty are dropped."""
    return tables.withColumn("rows", clean_rows(F.col("rows"))).where(F.size("rows") > 0)


# --- evidence pointers --------------------------------------------------------
def excel_column(number: Column) -> Column:
    """1 -> A, 27 -> AA, and so on for any number."""
    start = F.struct(F.greatest(number.cast("bigint"), F.lit(1).cast("bigint")).alias("left"), F.lit("").alias("letters"))

    def step(state: Column, _: Column) -> Column:
        before = state["left"] - 1
        return F.when(state["left"] > 0, F.struct(
            F.floor(before / 26).alias("left"), F.concat(F.char(before % 26 + 65), state["letters"]).alias("letters"),
        )).otherwise(state)

    # fourteen letters hold every 64-bit number
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["letters"])


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def _half_even4(c: Column) -> Column:
    return F.bround(c, 4)


def page_source_ref(media_type: Column, page: Column, bbox: Column) -> Column:
    """Evidence pointer of a block or table on a page of a layout."""
    sheet_like = media_type.isin(*fv.SPREADSHEET_TYPES)
    cell = F.concat(
        excel_column(F.greatest(_whole(bbox["x0"] * page["width"]) + 1, F.lit(1))),
        F.greatest(_whole(bbox["y0"] * page["height"]) + 1, F.lit(1)).cast("string"),
    )
    whole = F.concat(
        F.lit("A1:"), excel_column(F.greatest(_whole(page["width"]), F.lit(1))),
        F.greatest(_whole(page["height"]), F.lit(1)).cast("string"),
    )
    kind = (
        F.when(sheet_like, "spreadsheet").when(page["used_ocr"], "ocr")
        .when(media_type.startswith("image/"), "image").otherwise("pdf_text")
    )
    solid = (bbox["x1"] > bbox["x0"]) & (bbox["y1"] > bbox["y0"])
    box = F.when(~sheet_like & solid, F.struct(
        _half_even4(bbox["x0"]).alias("x1"), _half_even4(bbox["y0"]).alias("y1"),
        _half_even4(bbox["x1"]).alias("x2"), _half_even4(bbox["y1"]).alias("y2"),
    ))
    return F.struct(
        kind.alias("kind"),
        F.when(~sheet_like, page["number"]).alias("page"),
        box.cast(BBOX).alias("bbox"),
        F.when(sheet_like, F.coalesce(
            F.nullif(page["label"], F.lit("")), F.concat(F.lit("Sheet"), page["number"].cast("string")))).alias("sheet"),
        F.when(sheet_like, F.when(bbox.isNotNull(), cell).otherwise(whole)).alias("cell_range"),
        F.lit(None).cast("string").alias("text"),
    )


def serialize_layout(layouts: DataFrame) -> DataFrame:
    """One JSON text per document, in page and block order, nulls written out."""

    def page_json(p: Column) -> Column:
        return F.struct(
            p["number"].alias("number"),
            p["label"].alias("label"),
            F.transform(p["blocks"], lambda b: F.struct(
                b["text"].alias("text"),
                page_source_ref(F.col("media_type"), p, b["bbox"]).alias("source_ref"),
            )).alias("blocks"),
            F.transform(p["tables"], lambda t: F.struct(
                t["rows"].alias("rows"),
                page_source_ref(F.col("media_type"), p, t["bbox"]).alias("source_ref"),
            )).alias("tables"),
        )

    whole = F.struct(F.col("media_type"), F.transform("pages", page_json).alias("pages"))
    return layouts.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("layout_json"))


def content_fingerprint(layouts: DataFrame) -> DataFrame:
    """Hash of media type, recognition flag and pages; where the file lies plays no part."""
    payload = F.struct(
        F.col("media_type"),
        F.exists("pages", lambda p: p["used_ocr"]).alias("used_ocr"),
        F.col("pages"),
    )
    return layouts.withColumn(
        "content_hash", F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256),
    )


def _evidence_box(bbox: Column) -> Column:
    inside = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        inside = inside & bbox[c].between(0.0, 1.0)
    solid = (bbox["x1"] > bbox["x0"]) & (bbox["y1"] > bbox["y0"])
    return F.when(inside & solid, F.struct(
        _half_even4(bbox["x0"]).alias("x1"), _half_even4(bbox["y0"]).alias("y1"),
        _half_even4(bbox["x1"]).alias("x2"), _half_even4(bbox["y1"]).alias("y2"),
    )).cast(BBOX)


def _index_entry(page: Column, text: Column, bbox: Column) -> Column:
    return F.struct(
        tx.normalize_evidence_text(text).alias("haystack"),
        F.struct(
            F.when(page["used_ocr"], "ocr").otherwise("pdf_text").alias("kind"),
            page["number"].alias("page"),
            _evidence_box(bbox).alias("bbox"),
            F.lit(None).cast("string").alias("sheet"),
            F.lit(None).cast("string").alias("cell_range"),
            F.substring(tx.squeeze(text), 1, 500).alias("text"),
        ).alias("ref"),
    )


def index_entries(pages: Column) -> Column:
    """Ordered evidence entries of a layout: per page its blocks, then each table row."""

    def of_page(p: Column) -> Column:
        blocks = F.transform(
            F.filter(p["blocks"], lambda b: F.coalesce(b["text"], F.lit("")) != ""),
            lambda b: _index_entry(p, b["text"], b["bbox"]),
        )

        def of_table(t: Column) -> Column:
            joined = F.transform(t["rows"], lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
            return F.transform(
                F.filter(joined, tx.has_text), lambda row: _index_entry(p, row, t["bbox"]),
            )

        rows = F.flatten(F.transform(p["tables"], of_table))
        return F.concat(blocks, F.coalesce(rows, F.array().cast("array<struct<haystack:string,ref:%s>>" % SOURCE.simpleString())))

    return F.flatten(F.transform(pages, of_page))


def build_source_index(layouts: DataFrame) -> DataFrame:
    """Searchable form of a layout, one row per document.

    ``haystack`` joins the normalized entries with line feeds, which normalization removes
    everywhere else, so the entry of a hit follows from the line feeds before it. ``fallback``
    points to the first page.
    """
    first = F.get("pages", F.lit(0))
    fallback = F.struct(
        F.when(F.coalesce(first["used_ocr"], F.lit(False)), "ocr").otherwise("pdf_text").alias("kind"),
        F.coalesce(first["number"], F.lit(1)).alias("page"),
        F.lit(None).cast(BBOX).alias("bbox"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(None).cast("string").alias("cell_range"),
        F.lit(None).cast("string").alias("text"),
    )
    return (
        layouts.withColumn("entries", index_entries(F.col("pages")))
        .select(
            "doc_id",
            F.array_join(F.transform("entries", lambda e: e["haystack"]), "\n").alias("haystack"),
            F.transform("entries", lambda e: e["ref"]).alias("refs"),
            fallback.alias("fallback"),
        )
    )


def source_index_rows(layouts: DataFrame) -> DataFrame:
    """The evidence index as rows: position, normalized text and pointer."""
    return layouts.select("doc_id", F.posexplode(index_entries(F.col("pages"))).alias("index_pos", "e")).select(
        "doc_id", "index_pos", "e.haystack", "e.ref",
    )


def _first_hit(value: Column, haystack: Column) -> Column:
    """Position in the haystack of the first spelling that occurs, 0 without one; later spellings aren't searched."""
    needles = F.filter(
        F.transform(tx.value_variants(value), tx.normalize_evidence_text), lambda n: F.char_length(n) >= 2,
    )
    return F.aggregate(needles, F.lit(0), lambda place, n: F.when(place > 0, place).otherwise(F.instr(haystack, n)))


def _lines_before(haystack: Column, place: Column) -> Column:
    """Line feeds before a place: the index of the entry that stands there."""
    return let(
        F.substr(haystack, F.lit(1), place), lambda before: F.char_length(before) - F.char_length(F.translate(before, "\n", "")),
    )


def link_evidence(nested: DataFrame, index: DataFrame) -> DataFrame:
    """Give every filled field without evidence the first entry that contains it.

    Looser spellings are tried only when stricter ones occur nowhere; a value found nowhere points
    to the first page. Missing values and supplied evidence stay as they are.
    """
    joined = nested.join(index, "doc_id", "left")
    default = F.struct(
        F.lit("pdf_text").alias("kind"), F.lit(1).alias("page"), F.lit(None).cast(BBOX).alias("bbox"),
        F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell_range"),
        F.lit(None).cast("string").alias("text"),
    )

    def linked(f: Column) -> Column:
        found = let(
            _first_hit(f["value"], F.col("haystack")),
            lambda place: F.when(place > 0, F.get(F.col("refs"), _lines_before(F.col("haystack"), place))),
        )
        needs = f["value"].isNotNull() & (F.coalesce(F.size(f["sources"]), F.lit(0)) < 1)
        evidence = F.array(F.coalesce(found, F.col("fallback"), default).cast(SOURCE))
        return F.struct(
            f["ord"].alias("ord"), f["path"].alias("path"), f["value"].alias("value"),
            f["confidence"].alias("confidence"),
            F.when(needs, evidence).otherwise(f["sources"]).cast(SOURCES).alias("sources"),
        )

    return joined.withColumn("fields", F.transform("fields", linked)).drop("haystack", "refs", "fallback")
