"""Files, grids, layouts and evidence over the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.functions import text as tx
from vouchsafe.operators import admission as ad
from vouchsafe.operators import layout as ly
from vouchsafe.operators.rows import rows_of
from vouchsafe.plans.oracle_views import view
from vouchsafe.plans.registry import query
from vouchsafe.plans.tables import table
from vouchsafe.sources import files as fs

# --- files --------------------------------------------------------------------------
PREFIX = """case doc_id % 9 when 0 then '00' when 1 then '89504E470D0A1A0A' when 2 then 'FFD8FF' when 3 then '49492A00'
  when 4 then '4D4D002A' when 5 then '255044462D' when 6 then '504B0304' when 7 then '524946460000000057454250' else '255044462D' end"""
NAME = """concat('Doc.', cast(doc_id as string), case doc_id % 6 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.jpeg' when 3 then '.tif'
  when 4 then '.TIFF' else '.txt' end)"""
DECLARED = """case doc_id % 7 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg' when 3 then 'image/tiff'
  when 4 then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when 5 then 'image/webp' else 'text/html' end"""
view("a_files", (), f"""
select *, octet_length(body) as size_bytes, sha256(body) as sha256, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) as suffix, hex(body[1:16]) as header_hex from (
  select doc_id, {NAME} as name, {DECLARED} as declared_type, from_hex({PREFIX}) || encode(text) as body from documents)""")
view("a_described", ("a_files",), """
select doc_id, name, size_bytes, sha256, suffix, declared_type, header_hex,
  case suffix when '.pdf' then 'application/pdf' when '.png' then 'image/png' when '.jpeg' then 'image/jpeg' when '.tif' then 'image/tiff' when '.tiff' then 'image/tiff' end as content_type,
  concat(substr(sha256, 1, 2), '/', substr(sha256, 3, 2), '/', sha256, suffix) as object_key from a_files""")


def described(spark, d) -> DataFrame:
    body = F.concat(F.unhex(F.expr(PREFIX)), F.encode("text", "UTF-8"))
    raw = table(spark, d, "documents").select("doc_id", F.expr(NAME).alias("name"), F.expr(DECLARED).alias("declared_type"), body.alias("content"))
    return ad.describe_files(raw)


@query("a1_describe_files", "select * from a_described", ("a_described",))
def _(spark, d):
    return described(spark, d)


@query("a2_admit_files", """
select doc_id, case when size_bytes > 5000 then 'upload_too_large' when content_type is null then 'unsupported_content_type'
  when not ((suffix = '.pdf' and header_hex like '255044462D%') or (suffix = '.png' and header_hex like '89504E470D0A1A0A%') or (suffix = '.jpeg' and header_hex like 'FFD8FF%')
    or (suffix in ('.tif', '.tiff') and (header_hex like '49492A00%' or header_hex like '4D4D002A%'))) then 'unsupported_content_type' end as reason from a_described""", ("a_described",))
def _(spark, d):
    return ad.admit_files(described(spark, d), 5000).select("doc_id", "reason")


@query("a3_admit_declared", """
select doc_id, case when declared_type = 'text/html' or not case declared_type when 'application/pdf' then header_hex like '255044462D%' when 'image/png' then header_hex like '89504E470D0A1A0A%'
    when 'image/jpeg' then header_hex like 'FFD8FF%' when 'image/tiff' then header_hex like '49492A00%' or header_hex like '4D4D002A%'
    when 'image/webp' then header_hex like '52494646________57454250%' else header_hex like '504B0304%' end then 'unsupported_file_type'
  when size_bytes = 0 or size_bytes > 4000 then 'upload_too_large' end as reason from a_described""", ("a_described",))
def _(spark, d):
    return ad.admit_declared(described(spark, d), max_bytes=4000).select("doc_id", "reason")


TEXT_KEY = "concat(substr({sha}, 1, 8), case doc_id % 2 when 0 then '.pdf' else '.png' end)"
view("a_keys", (), f"select doc_id as file_id, {TEXT_KEY.format(sha='sha256(text)')} as object_key from documents")
view("a_known", ("a_keys",), "select object_key, min(file_id) + 1000000 as doc_id, 'completed' as status from a_keys where file_id % 5 = 0 group by object_key")


def keys(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id as file_id", f"{TEXT_KEY.format(sha='sha2(text, 256)')} as object_key")


def known(spark, d) -> DataFrame:
    return keys(spark, d).where("file_id % 5 = 0").groupBy("object_key").agg(F.expr("min(file_id) + 1000000").alias("doc_id")).withColumn("status", F.lit("completed"))


@query("a4_dedupe_content", """
select k.file_id, k.object_key, coalesce(e.doc_id, min(k.file_id) over (partition by k.object_key)) as doc_id, coalesce(e.status, 'uploaded') as status,
  e.doc_id is not null or k.file_id <> min(k.file_id) over (partition by k.object_key) as already_existed from a_keys k left join a_known e on e.object_key = k.object_key""",
       ("a_keys", "a_known"))
def _(spark, d):
    return ad.dedupe_content(keys(spark, d), known(spark, d))


# every line of a text is a record of three cells; one of them quotes its delimiter
CELL = "replace(replace(replace({x}, '\"', ''), ';', ' '), ',', ' ')"
view("a_cells", (), f"""
select doc_id, concat('t', cast(doc_id as varchar)) as sheet, n as row_no, c - 1 as col_no, case c when 1 then trim(line) when 2 then concat('x', sep, 'y') else '' end as value from (
  select doc_id, case when doc_id % 2 = 0 then ';' else ',' end as sep, {CELL.format(x='unnest(ls)')} as line, generate_subscripts(ls, 1) - 1 as n from (
    select doc_id, list_filter(string_split(regexp_replace(text, '[\\x0b\\x0c\\x1c-\\x1f\\x85\\t\\r]', ' ', 'g'), chr(10)), lambda s: trim(s) <> '') as ls from documents)) cross join (values (1), (2), (3)) v(c)""")


def grids(spark, d) -> DataFrame:
    lines = "filter(split(regexp_replace(text, '[\\\\x0b\\\\x0c\\\\x1c-\\\\x1f\\\\x85\\\\t\\\\r]', ' '), '\\n'), s -> trim(s) <> '')"
    sep = "case when doc_id % 2 = 0 then ';' else ',' end"
    body = f"array_join(transform({lines}, s -> concat({CELL.format(x='s')}, {sep}, '\"x', {sep}, 'y\"', {sep})), '\\n')"
    texts = table(spark, d, "documents").selectExpr("doc_id", "concat('t', doc_id, '.csv') as name", f"{body} as body")
    return fs.read_grid(texts, "body")


@query("a5_read_grid", "select doc_id, sheet, row_no, col_no, value from a_cells", ("a_cells",))
def _(spark, d):
    return fs.grid_cells(grids(spark, d))


@query("a6_grid_to_layout", """
select doc_id, n, count(*) as n_blocks, max(x1) as max_x, max(y1) as max_y from (
  select doc_id, max(row_no + 1) over (partition by doc_id) as n, (col_no + 1) / cast(3 as double) as x1, (row_no + 1) / cast(max(row_no + 1) over (partition by doc_id) as double) as y1, value
  from a_cells) where value <> '' group by doc_id, n""", ("a_cells",))
def _(spark, d):
    pages = fs.grid_to_layout(grids(spark, d)).select("doc_id", F.expr("pages[0]").alias("p"))
    return pages.selectExpr("doc_id", "cast(p.height as bigint) as n", "cast(size(p.blocks) as bigint) as n_blocks",
                            "array_max(p.blocks.bbox.x1) as max_x", "array_max(p.blocks.bbox.y1) as max_y").where("n_blocks > 0")


# --- layouts -------------------------------------------------------------------------
PER_PAGE = 40
LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')"
LINES = "filter(transform(split(text, '\\n'), s -> trim(s)), s -> s <> '')"
view("l_lines", (), f"""
select doc_id, line, n, cast(n // {PER_PAGE} + 1 as int) as page_no, n % {PER_PAGE} as place from (
  select doc_id, unnest({LINES_SQL}) as line, generate_subscripts({LINES_SQL}, 1) - 1 as n from documents)""")
view("l_pages", ("l_lines",), "select doc_id, page_no, string_agg(line, ' ' order by n) as text from l_lines group by doc_id, page_no")


def _numbers(count: str) -> str:
    return f"filter(sequence(0, {count}), p -> p < {count})"


def layouts(spark, d) -> DataFrame:
    """Text lines as blocks, forty to a page; every third line of a page is a table row as well."""
    box = "named_struct('x0', 0.1D, 'y0', i / 40D, 'x1', case when i % 7 = 0 then 0.1D else 0.9D end, 'y1', (i + 1) / 40D)"
    block = f"named_struct('text', t, 'bbox', {box}, 'confidence', 1.0D, 'source', 'text')"
    lines = f"slice(lines, p * {PER_PAGE} + 1, {PER_PAGE})"
    rows = f"transform(filter({lines}, (t, i) -> i % 3 = 0), t -> split(t, ' '))"
    page = (f"named_struct('number', cast(p + 1 as int), 'label', cast(null as string), 'width', 595.0D, 'height', 842.0D, "
            f"'blocks', transform({lines}, (t, i) -> {block}), 'tables', array(named_struct('rows', {rows}, 'bbox', "
            "named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 0.5D), 'source', 'text')), 'used_ocr', (doc_id + p) % 5 = 0)")
    cut = table(spark, d, "documents").selectExpr("doc_id", f"{LINES} as lines")
    counted = cut.selectExpr("doc_id", "lines", f"cast(ceil(size(lines) / {PER_PAGE}) as int) as n")
    return counted.selectExpr("doc_id", "'application/pdf' as media_type", f"transform({_numbers('n')}, p -> {page}) as pages")


def pages(spark, d) -> DataFrame:
    flat = F.transform("pages", lambda p: F.struct(
        p["number"].alias("page_no"), F.array_join(F.transform(p["blocks"], lambda b: b["text"]), " ").alias("text")))
    return rows_of(layouts(spark, d), ["doc_id"], flat)


view("l_stats", ("l_pages",), """
select doc_id, page_no, length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g')) as n_visible, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) as n_alnum,
  len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> '')) as n_words,
  (length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g')) - length(regexp_replace(text, '[^\\p{Cc}\\p{Cf}\\p{Co}\\x{FFFD}]', '', 'g')))
    / cast(nullif(length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g')), 0) as double) as readable_ratio from l_pages""")
view("l_routes", ("l_stats",), "select *, case when n_alnum >= 50 and n_words >= 10 and coalesce(readable_ratio, 0) >= 0.8 then 'text_layer' else 'ocr' end as route from l_stats")


@query("b1_text_layer_stats", "select * from l_stats", ("l_stats",))
def _(spark, d):
    return ly.text_layer_stats(pages(spark, d))


@query("b2_route_pages", "select doc_id, page_no, route from l_routes", ("l_routes",))
def _(spark, d):
    return ly.route_pages(ly.text_layer_stats(pages(spark, d))).select("doc_id", "page_no", "route")


@query("b2_used_ocr", "select doc_id, bool_or(route = 'ocr') as used_ocr from l_routes group by doc_id", ("l_routes",))
def _(spark, d):
    return ly.used_ocr(ly.route_pages(ly.text_layer_stats(pages(spark, d))))


@query("b3_check_page_limits", """
select d.doc_id, coalesce(n, 0) as n_pages, case when n is null then 'no_pages' else 'too_many_pages' end as error
from documents d left join (select doc_id, count(*) as n from l_pages group by doc_id) p on p.doc_id = d.doc_id where n is null or n > 2""", ("l_pages",))
def _(spark, d):
    return ly.check_page_limits(pages(spark, d), table(spark, d, "documents"), 2)


@query("b4_plan_ocr", """
select doc_id, case when width * height * s * s > 40000000.0 then greatest(s * sqrt(40000000.0 / (width * height * s * s)), 1.0) else s end as scale,
  case when width * height > 40000000.0 then 'page_too_large' end as error
from (select doc_id, cast(n_chars as double) * 3 + 1 as width, cast(doc_id % 9000 as double) + 100 as height, cast(300 as double) / 72 as s from documents)""")
def _(spark, d):
    sized = table(spark, d, "documents").selectExpr("doc_id", "cast(n_chars as double) * 3 + 1 as width", "cast(doc_id % 9000 as double) + 100 as height")
    return ly.plan_ocr(sized).select("doc_id", "scale", "error")


BOXED = "select doc_id, cast(doc_id % 700 as double) - 20 as x0, cast(n_chars % 900 as double) as y0, cast(n_chars % 800 as double) as x1, cast(doc_id % 1000 as double) as y1 from {documents}"


@query("b5_normalize_bbox", f"""
select doc_id, least(greatest(x0 / 595, 0), 1) as x0, least(greatest(y0 / 842, 0), 1) as y0, least(greatest(x1 / 595, 0), 1) as x1, least(greatest(y1 / 842, 0), 1) as y1
from ({BOXED.replace('{documents}', 'documents')})""")
def _(spark, d):
    raw = spark.sql(BOXED, documents=table(spark, d, "documents"))
    box = ly.normalize_bbox(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(595.0), F.lit(842.0))
    return raw.select("doc_id", box.alias("b")).select("doc_id", "b.*")


@query("b6_ocr_words", """
with w as (select doc_id, word, k, case when (doc_id + k) % 4 = 0 then '-1' when (doc_id + k) % 4 = 1 then 'bad' else cast((doc_id + k) % 120 as varchar) end as conf, text from (
  select doc_id, text, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as k from documents)),
 kept as (select doc_id, count(*) as n, sum(least(coalesce(try_cast(conf as double), 0), 100)) as c from w where trim(word, chr(32) || chr(9) || chr(10)) <> '' and coalesce(try_cast(conf as double), 0) >= 0 and doc_id % 6 <> 0 group by doc_id)
select d.doc_id, coalesce(n, 1) as n_blocks, cast(round(coalesce(c, 50)) as bigint) as score from documents d left join kept on kept.doc_id = d.doc_id""")
def _(spark, d):
    conf = "case when doc_id % 6 = 0 or (doc_id + k) % 4 = 0 then '-1' when (doc_id + k) % 4 = 1 then 'bad' else cast((doc_id + k) % 120 as string) end"
    words = f"transform(split(text, ' '), (w, k) -> named_struct('text', w, 'conf', {conf}, 'left', k, 'top', k, 'width', 10, 'height', 5))"
    raw = table(spark, d, "documents").selectExpr("doc_id", f"{words} as words", "600D as width", "800D as height", "text as page_text")
    total = "aggregate(blocks, 0D, (acc, b) -> acc + b.confidence * 100)"
    return ly.ocr_words_to_blocks(raw).selectExpr("doc_id", "cast(size(blocks) as bigint) as n_blocks", f"cast(round({total}) as bigint) as score")


@query("b7_clean_table_rows", """
select doc_id, count(*) as n_rows from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
where regexp_matches(line, '[^\\s\\p{Z}]') group by doc_id""")
def _(spark, d):
    rows = "transform(split(text, '\\n'), s -> transform(split(s, ' '), c -> nullif(c, '')))"
    raw = table(spark, d, "documents").selectExpr("doc_id", f"{rows} as rows")
    return ly.clean_table_rows(raw).selectExpr("doc_id", "cast(size(rows) as bigint) as n_rows")


@query("b8_text_volume", """
select doc_id, count(*) as n_pages, sum(length(text)) as n_chars, string_agg(cast(length(text) as varchar), ', ' order by page_no) as per_page,
  case when sum(length(text)) < 200 then 'scan' else 'text_layer' end as verdict from l_pages group by doc_id""", ("l_pages",))
def _(spark, d):
    return ly.text_volume(pages(spark, d))


# a block's box as a pointer, null where it has no width; pointers of blocks and of the page's table
BOX = "case when place % 7 <> 0 then {x1: 0.1::double, y1: round_even(place / 40, 4), x2: 0.9::double, y2: round_even((place + 1) / 40, 4)} end"
KIND = "case when (doc_id + page_no - 1) % 5 = 0 then 'ocr' else 'pdf_text' end"
POINTER = "{kind: " + KIND + ", page: page_no, bbox: {b}, sheet: null::varchar, cell_range: null::varchar, text: null::varchar}"
BLOCK_REF, TABLE_REF = POINTER.replace("{b}", BOX), POINTER.replace("{b}", "{x1: 0.0::double, y1: 0.0::double, x2: 1.0::double, y2: 0.5::double}")
view("l_layout", ("l_lines",), f"""
select d.doc_id, coalesce(pages, []) as pages from documents d left join (
  select doc_id, list({{number: page_no, label: null::varchar, blocks: blocks, tables: [{{rows: rows, source_ref: ref}}]}} order by page_no) as pages from (
    select doc_id, page_no, list({{text: line, source_ref: {BLOCK_REF}}} order by place) as blocks, list(string_split(line, ' ') order by place) filter (place % 3 = 0) as rows,
      {TABLE_REF} as ref from l_lines group by doc_id, page_no) group by doc_id) using (doc_id)""")
view("l_raw", ("l_lines",), """
select d.doc_id, coalesce(pages, []) as pages from documents d left join (
  select doc_id, list({number: page_no, label: null::varchar, width: 595.0::double, height: 842.0::double, blocks: blocks,
      tables: [{rows: rows, bbox: {x0: 0.0::double, y0: 0.0::double, x1: 1.0::double, y1: 0.5::double}, source: 'text'}], used_ocr: (doc_id + page_no - 1) % 5 = 0} order by page_no) as pages from (
    select doc_id, page_no, list({text: line, bbox: {x0: 0.1::double, y0: place / 40, x1: case when place % 7 = 0 then 0.1::double else 0.9::double end, y1: (place + 1) / 40}, confidence: 1.0::double, source: 'text'} order by place) as blocks,
      list(string_split(line, ' ') order by place) filter (place % 3 = 0) as rows from l_lines group by doc_id, page_no) group by doc_id) using (doc_id)""")


@query("b9_page_source_ref", f"""
select doc_id, cast(case when place % 7 <> 0 then to_json({{kind: {KIND}, page: page_no, bbox: {BOX}}}) else to_json({{kind: {KIND}, page: page_no}}) end as varchar) as source_ref from l_lines""", ("l_lines",))
def _(spark, d):
    page = F.col("p")
    refs = rows_of(layouts(spark, d), ["doc_id", "media_type"], F.transform("pages", lambda p: F.struct(p.alias("p"))))
    blocks = rows_of(refs, ["doc_id", "media_type", "p"], F.expr("transform(p.blocks, b -> named_struct('bbox', b.bbox))"))
    return blocks.select("doc_id", F.to_json(ly.page_source_ref(F.col("media_type"), page, F.col("bbox"))).alias("source_ref"))


@query("b10_serialize_layout", "select doc_id, cast(to_json({media_type: 'application/pdf', pages: pages}) as varchar) as layout_json from l_layout", ("l_layout",))
def _(spark, d):
    return ly.serialize_layout(layouts(spark, d))


@query("b11_content_fingerprint", """
select doc_id, sha256(cast(to_json({media_type: 'application/pdf', used_ocr: len(list_filter(pages, lambda p: p.used_ocr)) > 0, pages: pages}) as varchar)) as content_hash from l_raw""", ("l_raw",))
def _(spark, d):
    return ly.content_fingerprint(layouts(spark, d)).select("doc_id", "content_hash")


EVIDENCE = "regexp_replace(translate(lower({c}), '‐‑‒–—−,«»“”„‘’\"''', '------.'), '[\\s\\p{{Z}}]+', '', 'g')"


@query("b12_normalize_evidence_text", f"select doc_id, {EVIDENCE.format(c='text')} as normalized from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize_evidence_text(F.col("text")).alias("normalized"))


@query("b13_value_variants", """
select o_orderkey, case o_orderkey % 4 when 0 then concat_ws('|', strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d.%m.%Y'), concat(cast(day(o_orderdate) as varchar), '.', cast(month(o_orderdate) as varchar), '.', cast(year(o_orderdate) as varchar)))
  when 1 then concat_ws('|', v, case when regexp_replace(v, '\\.?0+$', '') <> v then regexp_replace(v, '\\.?0+$', '') end, split_part(v, '.', 1)) when 2 then o_orderpriority else '' end as variants
from (select *, cast(cast(o_totalprice as decimal(18,2)) as varchar) as v from orders)""")
def _(spark, d):
    value = F.expr("""case o_orderkey % 4 when 0 then cast(cast(o_orderdate as date) as string) when 1 then cast(cast(o_totalprice as decimal(18,2)) as string)
      when 2 then concat(' ', o_orderpriority, ' ') else '  ' end""")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tx.value_variants(value), "|").alias("variants"))


view("l_index", ("l_lines",), f"""
select doc_id, row_number() over (partition by doc_id order by page_no, part, place) - 1 as index_pos, {EVIDENCE.format(c='line')} as haystack,
  {KIND} as kind, page_no as page, cast(to_json(case when part = 1 then {{x1: 0.0::double, y1: 0.0::double, x2: 1.0::double, y2: 0.5::double}} else {BOX} end) as varchar) as bbox,
  left(trim(regexp_replace(line, '[\\s\\p{{Z}}]+', ' ', 'g')), 500) as text from (
  select *, 0 as part from l_lines union all select *, 1 from l_lines where place % 3 = 0)""")


@query("b14_source_index", "select * from l_index", ("l_index",))
def _(spark, d):
    return ly.source_index_rows(layouts(spark, d)).select(
        "doc_id", "index_pos", "haystack", "ref.kind", "ref.page", F.to_json("ref.bbox").alias("bbox"), "ref.text")


VALUES = """
select doc_id, 0 as ord, '/number' as path, split(text, ' ')[cast(size(split(text, ' ')) / 2 as int)] as value from {documents}
union all select doc_id, 1, '/total_amount', concat(cast(n_chars as string), '.50') from {documents}
union all select doc_id, 2, '/currency', case when doc_id % 2 = 0 then null else 'нигде' end from {documents}"""
view("l_values", (), "select doc_id, ord, path, value, " + EVIDENCE.format(c="trim(value, chr(32) || chr(9) || chr(10))") + """ as needle, 0 as variant from (
  select doc_id, 0 as ord, '/number' as path, w[(len(w) // 2) + 1] as value from (select doc_id, string_split(text, ' ') as w from documents)
  union all select doc_id, 1, '/total_amount', concat(cast(n_chars as varchar), '.50') from documents
  union all select doc_id, 2, '/currency', case when doc_id % 2 = 0 then null else 'нигде' end from documents)
union all select doc_id, 1, '/total_amount', concat(cast(n_chars as varchar), '.50'), concat(cast(n_chars as varchar), '.5'), 1 from documents
union all select doc_id, 1, '/total_amount', concat(cast(n_chars as varchar), '.50'), cast(n_chars as varchar), 2 from documents""")


@query("b15_link_evidence", """
select v.doc_id, v.path, case when v.value is null then null else coalesce(h.kind, case when doc_id % 5 = 0 then 'ocr' else 'pdf_text' end) end as kind, case when v.value is null then null else coalesce(h.page, 1) end as page,
  h.at.bbox as bbox, h.at.text as text
from (select distinct doc_id, path, value from l_values) v left join (
  select n.doc_id, n.path, arg_min(i.kind, n.variant * 1000000 + i.index_pos) as kind, arg_min(i.page, n.variant * 1000000 + i.index_pos) as page, arg_min({bbox: i.bbox, text: i.text}, n.variant * 1000000 + i.index_pos) as at
  from l_values n join l_index i on i.doc_id = n.doc_id and contains(i.haystack, n.needle) where length(n.needle) >= 2 group by n.doc_id, n.path) h using (doc_id, path)""",
       ("l_values", "l_index"))
def _(spark, d):
    docs = table(spark, d, "documents")
    words = "split(text, ' ')"
    element = lambda i, p, v: f"named_struct('ord', {i}, 'path', '{p}', 'value', {v}, 'confidence', 0.9D, 'sources', cast(array() as array<{ly.SOURCE.simpleString()}>))"
    values = [element(0, "/number", f"{words}[cast(floor(size({words}) / 2) as int)]"),
              element(1, "/total_amount", "concat(cast(n_chars as string), '.50')"),
              element(2, "/currency", "case when doc_id % 2 = 0 then null else 'нигде' end")]
    nested = docs.selectExpr("doc_id", f"array({', '.join(values)}) as fields")
    linked = ly.link_evidence(nested, ly.build_source_index(layouts(spark, d)))
    return rows_of(linked, ["doc_id"], "fields").selectExpr("doc_id", "path", "get(sources, 0).kind as kind", "get(sources, 0).page as page",
                                                    "to_json(get(sources, 0).bbox) as bbox", "get(sources, 0).text as text")
