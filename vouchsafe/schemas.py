"""Row types. A document is one row: its fields, parties and lines are nested structs."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 6)
COST = T.DecimalType(32, 12)

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
SOURCE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("bbox", BBOX),
    T.StructField("sheet", T.StringType()),
    T.StructField("cell_range", T.StringType()),
    T.StructField("text", T.StringType()),
])
SOURCES = T.ArrayType(SOURCE)


def field_of(value_type: T.DataType) -> T.StructType:
    """A value that can never be detached from its confidence and evidence."""
    return T.StructType([
        T.StructField("value", value_type),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("sources", SOURCES),
    ])


# path -> type, in document order; a dotted path is a party member
SCALAR_TYPES: dict[str, T.DataType] = {
    "document_type": T.StringType(),
    "number": T.StringType(),
    "date": T.DateType(),
    "supplier.name": T.StringType(),
    "supplier.inn": T.StringType(),
    "supplier.kpp": T.StringType(),
    "buyer.name": T.StringType(),
    "buyer.inn": T.StringType(),
    "buyer.kpp": T.StringType(),
    "total_amount": MONEY,
    "vat_amount": MONEY,
    "currency": T.StringType(),
}
LINE_TYPES: dict[str, T.DataType] = {
    "name": T.StringType(),
    "quantity": QUANTITY,
    "unit": T.StringType(),
    "unit_price": QUANTITY,
    "amount": MONEY,
    "vat_rate": T.StringType(),
    "vat_amount": MONEY,
}
# extra fields of one subtype each, nullable everywhere else
SUBTYPE_FIELDS: dict[str, dict[str, T.DataType]] = {
    "payment_invoice": {"payment_due_date": T.DateType()},
    "vat_invoice": {"correction_number": T.StringType(), "correction_date": T.DateType()},
    "universal_transfer_document": {"upd_status": T.StringType(), "operation_name": T.StringType()},
    "consignment_note_torg12": {"shipment_date": T.DateType(), "basis_document": T.StringType()},
    "work_completion_act": {
        "contract_number": T.StringType(),
        "contract_date": T.DateType(),
        "service_period_start": T.DateType(),
        "service_period_end": T.DateType(),
    },
}
PARTIES = ("supplier", "buyer")
PARTY_FIELDS = ("name", "inn", "kpp")
DATE_FIELDS_NOT_FUTURE = (
    "correction_date", "shipment_date", "contract_date", "service_period_start", "service_period_end",
)

LINE = T.StructType([T.StructField(n, field_of(t)) for n, t in LINE_TYPES.items()])
LINES = T.ArrayType(LINE)


def document_type(*, typed: bool = True, subtypes: bool = True) -> T.StructType:
    """Nested document struct; ``typed=False`` keeps every value as text."""

    def leaf(value_type: T.DataType) -> T.StructType:
        return field_of(value_type if typed else T.StringType())

    def party() -> T.StructType:
        return T.StructType([T.StructField(f, leaf(T.StringType())) for f in PARTY_FIELDS])

    members = [
        T.StructField("document_type", leaf(T.StringType())),
        T.StructField("number", leaf(T.StringType())),
        T.StructField("date", leaf(T.DateType())),
        T.StructField("supplier", party()),
        T.StructField("buyer", party()),
        T.StructField("total_amount", leaf(MONEY)),
        T.StructField("vat_amount", leaf(MONEY)),
        T.StructField("currency", leaf(T.StringType())),
        T.StructField("line_items", T.ArrayType(T.StructType(
            [T.StructField(n, leaf(t)) for n, t in LINE_TYPES.items()]
        ))),
    ]
    if subtypes:
        for extra in SUBTYPE_FIELDS.values():
            members += [T.StructField(n, leaf(t)) for n, t in extra.items()]
    return T.StructType(members)


# one element of the flattened view of a document
FLAT_FIELD = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("sources", SOURCES),
])
VIOLATION = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("field_path", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("actual", T.StringType()),
])
CACHE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("hits", T.LongType()),
    T.StructField("document", T.StringType()),
])
SAMPLE_REPORT_SCHEMA = T.StructType([
    T.StructField("report_version", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("dataset_version", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("provider_backend", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("sample_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_seconds", T.DecimalType(18, 6)),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", COST),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("step_durations", T.MapType(T.StringType(), T.DecimalType(18, 6))),
    T.StructField("fields", T.MapType(T.StringType(), T.StructType([
        T.StructField(c, T.LongType()) for c in ("matches", "misses", "hallucinations", "mismatches")
    ]))),
])
