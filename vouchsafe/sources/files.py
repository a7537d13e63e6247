"""File scans and delimited-text grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.functions.text import strip
from vouchsafe.operators.admission import describe_files
from vouchsafe.operators.layout import BLOCK, BOX, PAGE, TABLE
from vouchsafe.operators.rows import let, once, rows_of
from vouchsafe.settings import MAX_UPLOAD_BYTES

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def name_of(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"([^/]*)$", 1)


def scan_files(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """One described row per file under ``path``.

    Oversized files keep their row but their bytes are never read: the length filter reaches the
    scan of the content branch, and the listing branch prunes the content away.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.load(path)
    small = describe_files(
        files.where(F.col("length") <= max_bytes).select("path", name_of(F.col("path")).alias("name"), "content"))
    large = files.where(F.col("length") > max_bytes).select(
        "path", name_of(F.col("path")).alias("name"), F.col("length").alias("size_bytes"))
    return small.unionByName(large, allowMissingColumns=True)


# --- delimited text ---------------------------------------------------------------
DELIMITERS = (",", ";", "\t")


# the one-byte Cyrillic page differs from Latin-1 in its upper half and leaves one code undefined
_UPPER = bytes(b for b in range(0x80, 0x100) if b != 0x98)
_UNDEFINED = "\x98"


def decode_text(content: Column) -> Column:
    """UTF-8 without its mark, else the one-byte Cyrillic page, else UTF-8 with replacements.

    The Cyrillic page is read as Latin-1 and translated, which needs no session setting.
    """
    utf8 = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    page = F.translate(latin, _UPPER.decode("latin-1"), _UPPER.decode("cp1251"))
    text = F.when(F.is_valid_utf8(utf8), utf8).when(~latin.contains(_UNDEFINED), page).otherwise(F.make_valid_utf8(utf8))
    return F.regexp_replace(text, "^\ufeff", "")


def _records(text: Column, delimiter: str) -> Column:
    """Records of a text: a cell that starts with a quote may hold delimiters, doubled quotes and line breaks."""
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"[^{delimiter}\\r\\n]*+|[^{delimiter}\\r\\n]*+)'
    record = f"({cell}(?:{delimiter}{cell})*+)(?:\\r\\n|\\r|\\n)"
    closed = F.concat(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), F.lit("\n"))
    return F.regexp_extract_all(closed, F.lit(record), F.lit(1))


def sniff_delimiter(text: Column) -> Column:
    """The candidate that cuts the most records of the whole text like the first one, into more than one cell.

    Of equal ones the one with more cells, then the first candidate; comma when none cuts the first record.
    """
    def judged(d: str) -> Column:
        counts = F.transform(_records(text, d), lambda r: F.size(_cells(r, F.lit(d))))
        return let(counts, lambda c: F.struct(
            F.when(F.get(c, F.lit(0)) > 1, F.size(F.filter(c, lambda n: n == F.get(c, F.lit(0))))).otherwise(0).alias("alike"),
            F.coalesce(F.get(c, F.lit(0)), F.lit(0)).alias("cells"), F.lit(-DELIMITERS.index(d)).alias("order"), F.lit(d).alias("delimiter"),
        ))

    best = let(F.array_max(F.array(*[judged(d) for d in DELIMITERS])), lambda b: F.when(b["alike"] > 0, b["delimiter"]))
    return F.coalesce(best, F.lit(DELIMITERS[0]))


def _cells(line: Column, delimiter: Column) -> Column:
    """Cells of one line; a quoted cell may hold delimiters and doubled quotes."""
    # a closing delimiter makes every cell, also an empty last one, end in a delimiter
    raw = F.regexp_extract_all(F.concat(line, delimiter), F.concat(
        F.lit('("[^"]*+(?:""[^"]*+)*+"[^'), delimiter, F.lit(']*|[^'), delimiter, F.lit(']*)'), delimiter), F.lit(1))

    def clean(c: Column) -> Column:
        bare = strip(c)
        quoted = bare.rlike('(?s)^".*"$') & (F.char_length(bare) >= 2)
        inner = F.regexp_replace(F.regexp_replace(bare, '^"|"$', ""), '""', '"')
        return strip(F.when(quoted, inner).otherwise(bare))

    return F.transform(raw, clean)


def text_to_grid(text: Column, delimiter: Column) -> Column:
    records = F.when(delimiter == DELIMITERS[0], _records(text, DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        records = records.when(delimiter == d, _records(text, d))
    kept = F.when(text == "", F.array().cast("array<string>")).otherwise(records)
    return F.transform(kept, lambda record: F.when(
        record == "", F.array().cast("array<string>")).otherwise(_cells(record, delimiter)))


def read_grid(files: DataFrame, text: str | None = None) -> DataFrame:
    """Delimited files (doc_id, name, content or a text column) -> one row with the cell grid."""
    source = once(files, _text=F.col(text) if text else decode_text(F.col("content")))
    column = F.col("_text")
    sniffed = once(source, delimiter=sniff_delimiter(column))
    sheet = F.regexp_replace("name", r"\.[^.]*$", "")
    return sniffed.select(
        "doc_id", sheet.alias("sheet"), "delimiter", text_to_grid(column, F.col("delimiter")).alias("grid"))


def grid_cells(grids: DataFrame) -> DataFrame:
    """Cells as rows: row and column count from zero."""
    cells = F.flatten(F.transform("grid", lambda row, r: F.transform(row, lambda value, c: F.struct(
        r.alias("row_no"), c.alias("col_no"), value.alias("value")))))
    return rows_of(grids, ["doc_id", "sheet"], cells)


def grid_page(number: Column, label: Column, grid: Column, n_rows: Column, n_cols: Column) -> Column:
    """A sheet as a page: one block per filled cell, the whole grid as a table."""
    source = F.concat(F.lit("spreadsheet:"), label)

    def block(value: Column, r: Column, c: Column) -> Column:
        return F.struct(
            value.alias("text"),
            F.struct((c / n_cols).alias("x0"), (r / n_rows).alias("y0"),
                     ((c + 1) / n_cols).alias("x1"), ((r + 1) / n_rows).alias("y1")).alias("bbox"),
            F.lit(1.0).alias("confidence"), source.alias("source"),
        )

    blocks = F.flatten(F.transform(grid, lambda row, r: F.filter(
        F.transform(row, lambda v, c: block(strip(v), r, c)), lambda b: b["text"] != "")))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    table = F.struct(grid.alias("rows"), whole.cast(BOX).alias("bbox"), source.alias("source"))
    tables = F.when(F.size(grid) > 0, F.array(table)).otherwise(F.array().cast(T.ArrayType(TABLE)))
    return F.struct(
        number.cast("int").alias("number"), label.alias("label"), n_cols.alias("width"), n_rows.alias("height"),
        blocks.cast(T.ArrayType(BLOCK)).alias("blocks"), tables.cast(T.ArrayType(TABLE)).alias("tables"),
        F.lit(False).alias("used_ocr"),
    ).cast(PAGE)


def grid_to_layout(grids: DataFrame, media_type: str = "text/csv") -> DataFrame:
    """One sheet per document -> a layout row, without any grouping."""
    widest = F.array_max(F.transform("grid", lambda row: F.size(row)))
    sized = once(
        once(grids.drop("delimiter").withColumnRenamed("grid", "_g"), grid=F.col("_g")).drop("_g"),
        n_rows=F.greatest(F.size("grid"), F.lit(1)).cast("double"),
        n_cols=F.greatest(F.coalesce(widest, F.lit(0)), F.lit(1)).cast("double"),
    )
    page = grid_page(F.lit(1), F.col("sheet"), F.col("grid"), F.col("n_rows"), F.col("n_cols"))
    return sized.select("doc_id", F.lit(media_type).alias("media_type"), F.array(page).alias("pages"))
