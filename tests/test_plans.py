"""Shapes of plans whose cost grows with the tables, and equal results of the cheaper forms."""

import json

import pytest
from pyspark.sql import functions as F

from vouchsafe.functions.compare import name_equal
from vouchsafe.functions.text import has_name, normalize_name
from vouchsafe.operators import cascade, evaluation
from vouchsafe.operators import fields as fl
from vouchsafe.operators import validation as v
from vouchsafe.operators.rows import rows_of
from vouchsafe.plans import catalog, evaluation_queries, validation_queries, views
from vouchsafe.schemas import LINE_TYPES, SUBTYPE_FIELDS, document_type

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_hash(df):
    return sorted(r[0] for r in df.select(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).collect())


@pytest.mark.parametrize("lines,subtypes", [(True, False), (True, True), (False, False)])
def test_fields_are_taken_apart_without_lambdas(spark, lines, subtypes):
    text = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.concat(F.lit(
        '{"number": {"value": "7", "confidence": 0.5}, "buyer": {"inn": {"value": "1", "sources": [{"kind": "ocr", "page": 2}]}}, "upd_status": {"value": "1"}'),
        F.when(F.col("id") == 1, F.lit(', "line_items": [{"name": {"value": "x"}}, null, {"amount": {"value": "2", "confidence": 1}}]')).otherwise(""), F.lit("}"),
    )).otherwise("{}").alias("t"))
    docs = text.select("doc_id", F.from_json("t", document_type(typed=False)).alias("d")).select("doc_id", "d.*")
    found = fl.flatten_fields(docs, lines=lines, subtypes=subtypes)
    assert "lambda" not in plan_of(found)
    assert by_hash(found) == by_hash(rows_of(docs, ["doc_id"], fl.field_array(lines=lines, subtypes=subtypes)))


def test_lines_are_dealt_by_document_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = views.documents(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert physical.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(doc_id" not in physical


def test_defects_are_seeded_on_rows(spark):
    found = validation_queries.raw_fields(spark, FOLDER)
    assert "lambdafunction(named_struct(ord" not in plan_of(found)
    assert by_hash(found) == by_hash(fl.rows_of(validation_queries.raw_nested(spark, FOLDER), ["doc_id"], "fields"))


def test_evidence_is_checked_without_lambdas_over_fields(spark):
    plan = plan_of(catalog.QUERIES["c5_check_evidence"](spark, FOLDER))
    assert "concat(/line_items/, cast(lambda" not in plan and "Generate explode(sequence" in plan


@pytest.mark.parametrize("kind", ["/total_amount", "/line_items/0/amount", "/line_items/3/quantity", "/line_items/0/unit_price", "/line_items/0/vat_rate"])
def test_sound_numbers_break_no_rule(spark, monkeypatch, kind):
    values = ["0", "0.00", "000", "1", "01.5", "1.500", "1.5000000", "12.345", "12.", ".5", "-1", "+2", "1e3", "1e-9", " 3 ", "3\n", "\u00a04", "99.99", "100", "100.01",
              "120", "999999999999", "1234567890123.5", "0001234567890123", "9999999999999999.99", "12345678901234567", "without_vat", "without_vat\n", "x", "", None, "0.000001"]
    df = spark.createDataFrame([(kind, x) for x in values], "path string, value string")
    judge = lambda: [r[0] for r in df.coalesce(1).select(v.number_error(F.col("path"), F.col("value"))).collect()]
    quick = judge()
    monkeypatch.setattr(v, "SOUND_NUMBERS", {})
    assert quick == judge() and None in quick and "not_a_number" in quick


def test_documents_are_rebuilt_where_they_lie(spark):
    # the lines are gathered into documents; their fields aren't gathered a second time
    assert plan_of(catalog.QUERIES["c15_rebuild_documents"](spark, FOLDER)).count("collect_list(") == 1
    nested = fl.with_fields(views.documents(spark, FOLDER))
    again = fl.nest_fields(fl.flatten_fields(views.documents(spark, FOLDER)))
    assert by_hash(fl.rebuild_documents(nested)) == by_hash(fl.rebuild_documents(again))


def test_pointers_are_read_in_the_document_row(spark):
    assert plan_of(catalog.QUERIES["c14_get_path"](spark, FOLDER)).count("collect_list(") == 1


def test_scalar_counts_match_no_lines(spark):
    plan = plan_of(catalog.QUERIES["j10_scalar_counts"](spark, FOLDER))
    assert "assign_lines" not in plan


def test_escalation_derives_the_documents_once(spark):
    assert plan_of(catalog.QUERIES["f1_escalation_split"](spark, FOLDER)).count("collect_list(") == 1
    docs = views.documents(spark, FOLDER)
    kept, more = cascade.escalation_split(docs, views.SETTINGS)
    flags = dict(cascade.with_escalation(docs, views.SETTINGS).select("doc_id", "escalated").collect())
    assert {r.doc_id for r in more.select("doc_id").collect()} == {k for k, e in flags.items() if e}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, e in flags.items() if not e}


def test_corrections_meet_the_asked_paths_once(spark):
    assert plan_of(catalog.QUERIES["f5_restrict_corrections"](spark, FOLDER)).count("collect_list(") == 1
    found = spark.createDataFrame([(1, "/a", "x"), (1, "/b", "y"), (2, "/a", "z")], "doc_id long, path string, value string")
    asked = spark.createDataFrame([(1, "/a"), (1, "/a"), (3, "/a")], "doc_id long, path string")
    rows = [(r.doc_id, r.path, r.value, r.asked) for r in cascade.with_asked(found, asked).collect()]
    assert sorted(rows) == [(1, "/a", "x", True), (1, "/b", "y", False), (2, "/a", "z", False)]


def test_provenance_derives_the_documents_once(spark):
    assert plan_of(catalog.QUERIES["f7_field_provenance"](spark, FOLDER)).count("collect_list(") == 1
    docs = views.documents(spark, FOLDER)
    joined = cascade.field_provenance(fl.with_fields(docs), cascade.with_disputed(docs, views.SETTINGS), "small", "large")
    assert by_hash(catalog.QUERIES["f7_field_provenance"](spark, FOLDER)) == by_hash(joined)


def test_field_diff_reads_no_line_fields(spark):
    assert "concat(/line_items/" not in plan_of(catalog.QUERIES["g8_field_diff"](spark, FOLDER))


def test_scalar_outcomes_join_no_lines(spark):
    plan = plan_of(catalog.QUERIES["j11_merge_metrics"](spark, FOLDER))
    assert "неожиданная" not in plan and "Join FullOuter" in plan


def test_whole_documents_pass_by_the_plain_spellings(spark):
    plan = plan_of(catalog.QUERIES["c13_valid_documents"](spark, FOLDER))
    assert "[0-9]{1,16}" in plan and "from_json" not in plan.split("Generate")[0]


def test_fields_of_values_alone_make_no_evidence(spark):
    assert "lambdafunction" not in plan_of(catalog.QUERIES["j5_compare_field"](spark, FOLDER))
    assert by_hash(views.fields(spark, FOLDER)) == by_hash(fl.flatten_fields(views.documents(spark, FOLDER)))


def test_evidence_rules_are_evaluated_once(spark):
    assert plan_of(catalog.QUERIES["c5_check_evidence"](spark, FOLDER)).count("confidence_range") == 1


@pytest.mark.parametrize("name", ["j7_line_similarity", "j8_match_lines", "j8_match_totals", "j9_line_outcomes"])
def test_compared_documents_are_bare(spark, name):
    assert "confidence" not in plan_of(catalog.QUERIES[name](spark, FOLDER))
    wrapped = evaluation.bare_form(views.documents(spark, FOLDER), "doc_id", wrapped=True)
    assert by_hash(evaluation.bare_form(views.bare_documents(spark, FOLDER), "doc_id", wrapped=False)) == by_hash(wrapped)


def odd_documents(spark):
    """A sound document, and copies with one odd field each, as rows with an untyped document."""
    page = {"kind": "pdf_text", "page": 1, "bbox": None, "sheet": None, "cell_range": None, "text": None}
    field = lambda value, confidence=0.9, sources=(page,): {"value": value, "confidence": confidence, "sources": list(sources)}
    party = lambda: {"name": field("x"), "inn": field("7707083893"), "kpp": field("770101001")}
    line = lambda: {n: field(x) for n, x in zip(LINE_TYPES, ("x", "1", "шт", "2.5", "2.50", "20", "0.50"))}
    sound = lambda: {
        "document_type": field("vat_invoice"), "number": field("1"), "date": field("2001-01-02"), "supplier": party(), "buyer": party(),
        "total_amount": field("3.00"), "vat_amount": field(None, 0.0, ()), "currency": field("RUB"), "line_items": [line(), line()]}
    odd = [field(x) for x in ("", "abc", "-1", "0", "1e3", "1.2345678", "without_vat", "120", "usd", " руб. ", "руб.", "RUB\n", "1027700132195", "77010100", "2001-13-40",
                              "receipt", "12345678901234567890", "7707083893\n")]
    odd += [field("1", c) for c in (None, 1.5, -0.5, 1 + 1e-13, -1e-13, 1.0, float("1e-12"))] + [field(None, 0.7), field(None, None, ()), field("1", 0.5, ())]
    odd += [field("1", 0.5, [page | change]) for change in ({"kind": None}, {"kind": "fax"}, {"page": None}, {"page": 0}, {"kind": "spreadsheet"}, {"text": "x" * 501},
            {"bbox": {"x1": 0.5, "y1": 0, "x2": 0.1, "y2": 1}}, {"bbox": {"x1": 0.1, "y1": 0, "x2": 0.5, "y2": 1}})] + [field("1", 0.5, [page, page | {"page": 0}])]
    found = [sound(), sound() | {"line_items": None}, sound() | {"line_items": []}]
    for value in odd:
        for name in ("document_type", "date", "total_amount", "currency"):
            found.append(sound() | {name: value})
        found += [sound() | {"supplier": party() | {name: value}} for name in ("name", "inn", "kpp")]
        found += [sound() | {"line_items": [line(), line() | {name: value}]} for name in LINE_TYPES]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(found)], "doc_id long, t string").repartition(4)
    return rows.select("doc_id", F.from_json("t", document_type(typed=False)).alias("document"))


def test_plainly_sound_fields_are_passed_over(spark):
    assert "_raw" not in plan_of(catalog.QUERIES["c13_valid_documents"](spark, FOLDER))
    docs = odd_documents(spark).cache()
    whole = v.validate_fields(docs.select("doc_id", fl.fields_of("document").alias("fields"))).select("doc_id", "fields", F.array_distinct("errors").alias("errors"))
    quick = v.validate_documents(docs.select("doc_id", "document.*"), views.TODAY)
    assert by_hash(quick.select("doc_id", "fields", "errors")) == by_hash(whole)
    assert 0 < quick.where("is_valid").count() < quick.count() and whole.where("size(errors) > 0").count() == quick.where("NOT is_valid").count()


def test_cached_answers_pass_by_the_plain_spellings(spark):
    found = catalog.QUERIES["d3_cache_get_valid"](spark, FOLDER)
    assert "_raw" not in plan_of(found) and plan_of(found).count("to_json") <= 1
    docs = odd_documents(spark).cache()
    whole = v.validate_fields(docs.select("doc_id", fl.fields_of("document").alias("fields")))
    assert by_hash(docs.select("doc_id", v.document_errors("document.").alias("errors"))) == by_hash(whole.select("doc_id", "errors"))


def test_every_field_is_compared(spark):
    found = catalog.QUERIES["j5_compare_field"](spark, FOLDER)
    assert by_hash(found.select("doc_id", "path")) == by_hash(views.fields(spark, FOLDER).select("doc_id", "path"))
    verdicts = {(r.path.endswith("/name"), r.equal) for r in found.select("path", "equal").distinct().collect()}
    assert (True, True) in verdicts and (True, False) in verdicts


def test_names_that_are_empty_in_normal_form_equal_nothing(spark):
    names = ["", " ", "«»", "-", "Ё", "ё", "x", "7", "Ж!", "日本", "İ", None]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rows = df.select("a", "b", has_name(F.col("a")).alias("has"), normalize_name(F.col("a")).alias("left"), normalize_name(F.col("b")).alias("right"),
                     name_equal(F.col("a"), F.col("b"), 1.0).alias("equal")).collect()
    assert all(r.has == (None if r.left is None else r.left != "") for r in rows)
    assert all(r.equal == bool(r.left and r.left == r.right) for r in rows)


def test_field_rows_are_checked_like_lists(spark):
    plan = plan_of(catalog.QUERIES["c13_validate_documents"](spark, FOLDER))
    assert "concat(/line_items/, cast(lambda" not in plan
    # what precedes the close look is compiled: no lambda stands in the filter or below it
    assert "lambdafunction" not in plan[plan.index("Filter (isnotnull(raw"):]
    lists = odd_documents(spark).select("doc_id", fl.fields_of("document").alias("fields")).cache()
    whole = v.validate_fields(lists).select("doc_id", F.array_distinct("errors").alias("errors"))
    assert by_hash(v.field_row_errors(rows_of(lists, ["doc_id"], "fields"))) == by_hash(rows_of(whole, ["doc_id"], "errors"))


@pytest.mark.parametrize("subtypes", [False, True])
def test_texts_written_back_as_they_are_need_no_variant(spark, monkeypatch, subtypes):
    document = F.struct(*[F.col(f"document.{n}") for n in document_type(subtypes=subtypes).names])
    compact = [r.t for r in odd_documents(spark).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("t")).collect()]
    text = compact[0]
    swaps = [('"value":"2.50"', f'"value":{x}') for x in ("2.50", "2.5", "007", "1e3", "-0", "-.5", "2.", "null", "true", '"2.50', "{}", '"\\"value\\":3,"', "2.50 ", "12345678901234567890.123456789")]
    swaps += [('"currency":{', '"currency":null,"was":{'), ('"number":{', '"no":{'), ('"currency":{', '"number":{'), ('{"document_type"', '{"extra":1,"document_type"'), ('"page":1', '"page":"1"'),
              ('"sources":[{', '"sources":null,"then":[{'), ('"confidence":0.9', '"confidence":"NaN"'), ('"confidence":0.9,', ""), ('"line_items":[', '"line_items":null,"more":['),
              ('"line_items":[', '"line_items":[null,'), ('"supplier":{', '"supplier":null,"by":{'), ('"kind":"pdf_text"', '"kind":null'), ('"page":1', '"page":1,"page":1'), ('"bbox":null', '"bbox":{"x1":0.1}')]
    odd = [text.replace(a, b, n) for a, b in swaps for n in (1, -1)] + [text + "}", text + " ", f"[{text}]", "null", "", "{}", text[1:], text.replace(":", ": ")]
    extras = "".join(f',"{n}":null' for group in SUBTYPE_FIELDS.values() for n in group)
    odd += [text[:-1] + extras + "}"] + [text[:-1] + extras.replace("null", '{"value":"x","confidence":1.0,"sources":' + s + "}") + "}" for s in ("[]", "null")]
    rows = spark.createDataFrame(list(enumerate([*compact, *odd])), "doc_id long, content string").repartition(4)
    quick = by_hash(v.parse_results(rows, subtypes=subtypes))
    errors = {r.error for r in v.parse_results(rows, subtypes=subtypes).select("error").distinct().collect()}
    monkeypatch.setattr(v, "_complete", lambda document, extras: F.lit(False))
    assert quick == by_hash(v.parse_results(rows, subtypes=subtypes)) and errors == {None, "json", "schema"}


def test_answers_of_our_own_writing_need_no_variant(spark):
    docs = views.documents(spark, FOLDER).drop("tenant_id", "status", "created_at")
    texts = docs.select("doc_id", F.to_json(F.struct(*docs.columns[1:]), {"ignoreNullFields": "false"}).alias("content"))
    read = texts.withColumn("read", F.from_json("content", document_type(typed=False, subtypes=False)))
    assert read.where(~F.coalesce(v.written_alike("content", "read", []), F.lit(False))).count() == 0


def test_line_fields_are_compared_on_rows(spark):
    plan = plan_of(catalog.QUERIES["j10_evaluate_documents"](spark, FOLDER))
    assert not any("lambda" in node and "hallucination" in node for node in plan.splitlines())
    sides = [evaluation_queries.expected(spark, FOLDER), evaluation_queries.actual(spark, FOLDER).where("sample_id % 50 > 0")]
    matched = evaluation.match_lines(evaluation.scalar_outcomes(evaluation.pair_samples(sides[0].where("sample_id % 51 > 0"), sides[1])))
    listed = rows_of(evaluation.line_outcomes(matched), ["sample_id"], F.concat("scalars", "line_fields"))
    assert by_hash(evaluation.all_outcomes(matched)) == by_hash(listed)


def test_lines_that_are_spelled_alike_are_equal(spark):
    fields = ("name", "amount", "quantity", "unit_price", "vat_rate", "unit")
    values = [None, "", "=", "1", "\x01", "\x00", "=\x00", "1\x00", "\x00="]
    lines = [{"unit": u} for u in values] + [{"unit": u, n: x} for n in fields[:5] for u in values for x in ("", "1")]
    df = spark.createDataFrame([({n: line.get(n) for n in fields},) for line in lines], f"line struct<{', '.join(f'{n}: string' for n in fields)}>")
    assert df.select(evaluation._spelled(F.col("line"))).distinct().count() == df.distinct().count() == len(lines)


def test_equal_lists_are_paired_in_order(spark):
    rows = evaluation_queries.expected(spark, FOLDER)
    found = evaluation.match_lines(evaluation.pair_samples(rows, rows), 0.0)
    lists = [F.transform(F.col(side)["lines"], evaluation._comparable) for side in "ea"]
    assert by_hash(found.select("sample_id", "matched")) == by_hash(found.select("sample_id", evaluation.settled_pairs(*lists).alias("matched")))
