"""Documents as field lists and back: flatten, address by path, overlay, rebuild.

All of it is row-local. A document row carries its fields in document order, so the nested form is
rebuilt by position and no grouping is needed unless the caller starts from exploded rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe import fixed_values as fv
from vouchsafe.operators.rows import rows_of
from vouchsafe.schemas import (
    FLAT_FIELD, LINE_TYPES, PARTIES, PARTY_FIELDS, SCALAR_TYPES, SOURCE, SOURCES, SUBTYPE_FIELDS,
)

N_SCALARS = len(SCALAR_TYPES)
N_LINE = len(LINE_TYPES)


# These expressions repeat one shape for every field, so they are written as SQL text: the plan is the
# same as with column objects, but building it takes one call instead of hundreds.
def _flat(order: str, path: str, field: str) -> str:
    return (
        f"named_struct('ord', CAST({order} AS INT), 'path', {path}, 'value', CAST({field}.value AS STRING), "
        f"'confidence', {field}.confidence, 'sources', {field}.sources)"
    )


def scalar_pointer(path: str) -> str:
    return "/" + path.replace(".", "/")


def _field_array(base: str, lines: bool, subtypes: bool) -> str:
    scalars = [_flat(str(i), f"'{scalar_pointer(p)}'", base + p) for i, p in enumerate(SCALAR_TYPES)]
    if subtypes:
        extra = [n for group in SUBTYPE_FIELDS.values() for n in group]
        scalars += [_flat(str(i - len(extra)), f"'/{n}'", base + n) for i, n in enumerate(extra)]
    head = f"array({', '.join(scalars)})"
    if not lines:
        return head
    members = ", ".join(
        _flat(f"{N_SCALARS + k} + i * {N_LINE}", f"concat('/line_items/', i, '/{name}')", f"x.{name}")
        for k, name in enumerate(LINE_TYPES)
    )
    tail = f"flatten(transform({base}line_items, (x, i) -> array({members})))"
    return f"concat({head}, coalesce({tail}, CAST(array() AS ARRAY<{FLAT_FIELD.simpleString()}>)))"


def field_array(*, lines: bool = True, subtypes: bool = False) -> Column:
    """All fields of the document row in document order."""
    return F.expr(_field_array("", lines, subtypes))


def fields_of(document: str, *, subtypes: bool = False) -> Column:
    """The same for a document held in one struct column, which is computed once for all fields."""
    return F.expr(f"get(transform(array({document}), d -> {_field_array('d.', True, subtypes)}), 0)")


def with_fields(docs: DataFrame, **kwargs: bool) -> DataFrame:
    return docs.select("doc_id", field_array(**kwargs).alias("fields"))


def _scalar_places(subtypes: bool) -> list[tuple[int, str]]:
    extra = [n for group in SUBTYPE_FIELDS.values() for n in group] if subtypes else []
    return [*enumerate(SCALAR_TYPES), *((i - len(extra), n) for i, n in enumerate(extra))]


def flatten_fields(docs: DataFrame, *, lines: bool = True, subtypes: bool = False) -> DataFrame:
    """One row per field: doc_id, ord, path, value text, confidence, sources.

    Generators and branches on numbers are compiled, lambdas over lists are not; a member that nobody reads is not made.
    """
    columns = list(dict.fromkeys(p.split(".")[0] for _, p in _scalar_places(subtypes)))
    return read_fields(field_places(docs, ["doc_id", *columns], lines="line_items" if lines else None, subtypes=subtypes), lines=lines, subtypes=subtypes)


def field_places(docs: DataFrame, keep: list[str], *, lines: str | None, subtypes: bool = False) -> DataFrame:
    """``keep`` once per field of a document: ``_at`` is 0 for the document itself and counts its lines from 1, ``_line`` is
    the line there, ``_k`` the field's number within it."""
    n = len(_scalar_places(subtypes))
    if lines:
        rows = docs.select(*keep, F.posexplode(F.expr(
            f"concat(array(get({lines}, -1)), coalesce({lines}, array()))")).alias("_at", "_line"))
    else:
        rows = docs.select(*keep).withColumn("_at", F.lit(0))
    last = f"CASE WHEN _at = 0 THEN {n - 1} ELSE {N_LINE - 1} END" if lines else str(n - 1)
    return rows.select("*", F.explode(F.expr(f"sequence(0, {last})")).alias("_k"))


def read_fields(
    rows: DataFrame, *, lines: bool = True, subtypes: bool = False, wrapped: bool = True, keep: Sequence[str] = (),
) -> DataFrame:
    """The field at each of the ``field_places``, whose ``_line`` and other columns are nested as in a document.

    Documents that aren't ``wrapped`` hold bare values, which have no confidence and evidence.
    """
    scalars, members = _scalar_places(subtypes), list(LINE_TYPES)

    def either(of_scalar: str, of_line: str) -> str:
        return f"CASE WHEN _at = 0 THEN {of_scalar} ELSE {of_line} END" if lines else of_scalar

    def member(tail: str, cast: str = "{}") -> str:
        pick = lambda each: "CASE _k " + " ".join(f"WHEN {i} THEN {cast.format(f)}" for i, f in enumerate(each)) + " END"
        return either(pick([f"{p}{tail}" for _, p in scalars]), pick([f"_line.{n}{tail}" for n in members]))

    names = lambda each: "get(array(" + ", ".join(f"'{n}'" for n in each) + "), _k)"
    order = f"get(array({', '.join(str(i) for i, _ in scalars)}), _k)"
    return rows.selectExpr(
        "doc_id", *keep, f"CAST({either(order, f'{N_SCALARS} + (_at - 1) * {N_LINE} + _k')} AS INT) AS ord",
        either(names([scalar_pointer(p) for _, p in scalars]), f"concat('/line_items/', _at - 1, '/', {names(members)})") + " AS path",
        member(".value" if wrapped else "", "CAST({} AS STRING)") + " AS value",
        *([member(".confidence") + " AS confidence", member(".sources") + " AS sources"] if wrapped else []),
    )


def nest_fields(fields: DataFrame) -> DataFrame:
    """Exploded field rows -> one row per document with the ordered list.

    The list is bounded by the document, which admission limits in bytes and pages.
    """
    rows = F.struct(*FLAT_FIELD.names)
    return fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(rows)).alias("fields"))


def canonical_missing(field: Column) -> Column:
    """A missing value has confidence 0 and no evidence."""
    gone = field["value"].isNull()
    return F.struct(
        field["ord"].alias("ord"),
        field["path"].alias("path"),
        field["value"].alias("value"),
        F.when(gone, F.lit(0.0)).otherwise(field["confidence"]).alias("confidence"),
        F.when(gone, F.array().cast(SOURCES)).otherwise(field["sources"]).alias("sources"),
    )


def canonicalize_missing(fields: DataFrame) -> DataFrame:
    gone = F.col("value").isNull()
    return (
        fields.withColumn("confidence", F.when(gone, F.lit(0.0)).otherwise(F.col("confidence")))
        .withColumn("sources", F.when(gone, F.array().cast(SOURCES)).otherwise(F.col("sources")))
    )


def _typed(field: str, value_type: T.DataType) -> str:
    value = f"{field}.value"
    if not isinstance(value_type, T.StringType):
        value = f"try_cast({value} AS {value_type.simpleString()})"
    return f"named_struct('value', {value}, 'confidence', {field}.confidence, 'sources', {field}.sources)"


def document_columns(fields: str = "fields") -> list[Column]:
    """Nested document columns from the ordered field list (scalars first, seven per line)."""
    place = {p: i for i, p in enumerate(SCALAR_TYPES)}

    def scalar(path: str) -> str:
        return _typed(f"get({fields}, {place[path]})", SCALAR_TYPES[path])

    columns = [F.expr(scalar(name)).alias(name) for name in ("document_type", "number", "date")]
    for party in PARTIES:
        members = ", ".join(f"'{f}', {scalar(f'{party}.{f}')}" for f in PARTY_FIELDS)
        columns.append(F.expr(f"named_struct({members})").alias(party))
    columns += [F.expr(scalar(name)).alias(name) for name in ("total_amount", "vat_amount", "currency")]
    members = ", ".join(
        f"'{n}', " + _typed(f"get({fields}, i * {N_LINE} + {N_SCALARS + k})", t)
        for k, (n, t) in enumerate(LINE_TYPES.items())
    )
    count = f"CAST((size({fields}) - {N_SCALARS}) / {N_LINE} AS INT)"
    # drop the running number past the end instead of branching on empty documents
    numbers = f"filter(sequence(0, greatest({count}, 0)), i -> i < {count})"
    columns.append(F.expr(f"transform({numbers}, i -> named_struct({members}))").alias("line_items"))
    return columns


def rebuild_documents(nested: DataFrame) -> DataFrame:
    """Inverse of ``with_fields``: (doc_id, fields) -> typed nested document."""
    return nested.select("doc_id", *document_columns())


def path_errors(path: Column) -> Column:
    """Reason why a pointer can never resolve, before looking at any document."""
    return F.when(path.rlike(r"(^|/)-+[0-9]+(/|$)"), F.lit("negative_index"))


def canonical_path(path: Column) -> Column:
    """One leading slash, no trailing one, list indexes without leading zeros."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    clean = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.regexp_replace(p, "^0+(?=[0-9])", "")).otherwise(p))
    return F.concat(F.lit("/"), F.array_join(clean, "/"))


def get_path(nested: DataFrame, requests: DataFrame) -> DataFrame:
    """Read requested pointers: value, or the reason why the pointer leads to no field.

    ``nested`` is (doc_id, fields) as of ``with_fields`` or ``nest_fields``. A request is checked against its own
    document's path list, one join on doc_id.
    """
    lists = nested.select("doc_id", F.map_from_arrays(F.expr("fields.path"), F.expr("fields.value")).alias("values"))
    key = canonical_path(F.col("request_path"))
    joined = requests.join(lists, "doc_id", "left")
    known = F.coalesce(F.map_contains_key("values", key), F.lit(False))
    below = F.exists(F.map_keys("values"), lambda p: p.startswith(F.concat(key, F.lit("/"))) | (key == "/"))
    is_line = key.rlike("^/line_items/[0-9]+(/|$)")
    line_root = F.regexp_extract(key, "^(/line_items/[0-9]+)", 1)
    line_known = F.exists(F.map_keys("values"), lambda p: p.startswith(F.concat(line_root, F.lit("/"))))
    error = (
        F.when(F.col("values").isNull(), "unknown_document")
        .when(known, F.lit(None).cast("string"))
        .when(path_errors(F.col("request_path")).isNotNull(), "negative_index")
        .when(is_line & ~line_known, "index_out_of_range")
        .when(below | (key == "/line_items"), "not_a_field")
        .otherwise("unknown_path")
    )
    return joined.select(
        "doc_id", "request_path",
        F.when(known, F.try_element_at("values", key)).alias("value"),
        error.alias("error"),
    )


CORRECTION = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("sources", SOURCES),
])


def correction_maps(corrections: DataFrame) -> DataFrame:
    """(doc_id, path, value, confidence, sources), unique per path -> one map per document."""
    entry = F.struct(F.col("path"), F.struct(*CORRECTION.names).alias("c"))
    return corrections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("corrections"))


def overlay_fields(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace whole fields at corrected paths; paths that do not exist are ignored."""
    joined = nested.join(correction_maps(corrections), "doc_id", "left")

    def replaced(f: Column) -> Column:
        c = F.try_element_at("corrections", f["path"])
        return F.when(
            F.coalesce(F.map_contains_key("corrections", f["path"]), F.lit(False)),
            F.struct(
                f["ord"].alias("ord"), f["path"].alias("path"), c["value"].alias("value"),
                c["confidence"].alias("confidence"), c["sources"].alias("sources"),
            ),
        ).otherwise(f)

    return joined.withColumn("fields", F.transform("fields", replaced)).drop("corrections")


def overlay_values(nested: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewer values over the model's: full confidence, or none for an emptied field.

    ``corrections`` is (doc_id, path, value), unique per path. An emptied field loses its
    evidence, a filled one without evidence gets a marker of the manual check.
    """
    entry = F.struct(F.col("path"), F.struct("value").alias("c"))
    maps = corrections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("corrections"))
    joined = nested.join(maps, "doc_id", "left")
    marker = F.array(F.struct(
        F.lit("pdf_text").alias("kind"), F.lit(1).alias("page"),
        F.lit(None).cast(SOURCE["bbox"].dataType).alias("bbox"),
        F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell_range"),
        F.lit(fv.MANUAL_SOURCE).alias("text"),
    ))

    def replaced(f: Column) -> Column:
        value = F.try_element_at("corrections", f["path"])["value"]
        filled = value.isNotNull() & (value != "")
        has_evidence = F.coalesce(F.size(f["sources"]) > 0, F.lit(False))
        return F.when(
            F.coalesce(F.map_contains_key("corrections", f["path"]), F.lit(False)),
            F.struct(
                f["ord"].alias("ord"), f["path"].alias("path"), value.alias("value"),
                F.when(filled, 1.0).otherwise(0.0).alias("confidence"),
                F.when(~filled | value.isNull(), F.array().cast(SOURCES))
                .when(has_evidence, f["sources"]).otherwise(marker).alias("sources"),
            ),
        ).otherwise(f)

    return joined.withColumn("fields", F.transform("fields", replaced)).drop("corrections")
