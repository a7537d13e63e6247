"""One query per operator with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.llm import bpe, conversations, exact_dedup, knn, licenses, ngram_join, packing, pii, quality, resampling, suffix_dedup, token_files, url_filters, url_labels
from vouchsafe.llm.catalog import ORACLES, QUERIES, pii_key, query, tokenizer_path  # noqa: F401
from vouchsafe.llm.tables import table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query(
    "op3_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op1_bpe_prefix_coding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_token_files(files, with_ids=False)


@query("op8_quality_discriminant")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_pii_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), pii_key())


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), least=400, keep_first=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op4_voronoi_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
    )
    SELECT * FROM r WHERE rank <= 20
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "embeddings").where(knn.usable(F.col("embedding")))
    vectors = usable.select("vec_id", knn.whole_components(F.col("embedding")).alias("v"))
    return knn.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # four ids in a row share a directory; the first is its licence file if it speaks of a licence
    folder = F.floor(F.col("doc_id") / 4).cast("string")
    is_file = (F.pmod("doc_id", F.lit(4)) == 0) & F.coalesce(F.col("text").rlike("(?i)licen[cs]e"), F.lit(False))
    path = F.when(is_file, F.concat_ws("/", folder, F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", folder, "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)))"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a text in DuckDB, over its bytes; ``crc_table.c`` holds CRC_TABLE."""
    byte = "CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT)".format(text)
    return (
        f"xor(list_reduce(list_transform(range(strlen({text})), lambda i: {byte}),"
        " lambda c, b: xor(c >> 8, crc_table.c[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"
    )


@query(
    "op13_target_resampling",
    f"""
    WITH crc_table AS MATERIALIZED (SELECT {CRC_TABLE} AS c),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    sw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
    tw AS MATERIALIZED (
        SELECT w, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark) GROUP BY w
    ),
    b AS MATERIALIZED (
        SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM sw UNION SELECT w FROM tw), crc_table
    ),
    s AS (SELECT bucket, sum(n) AS n FROM sw JOIN b USING (w) GROUP BY bucket),
    t AS (SELECT bucket, sum(n) AS n FROM tw JOIN b USING (w) GROUP BY bucket),
    totals AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS big_s, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS big_t),
    gain AS (
        SELECT s.bucket, CAST(floor(1000 * ln(
            (coalesce(t.n, 0) + 1.0::DOUBLE) * (big_s + 10000) / ((s.n + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS g
        FROM s LEFT JOIN t USING (bucket), totals
    ),
    weights AS (SELECT r, CAST(sum(sw.n) AS BIGINT) AS n_features, CAST(sum(sw.n * g) AS BIGINT) AS weight FROM sw JOIN b USING (w) JOIN gain USING (bucket) GROUP BY r),
    scored AS (
        SELECT d.r, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM d LEFT JOIN weights USING (r)
    ),
    ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, rank
    FROM scored LEFT JOIN (SELECT r, rank FROM ranked WHERE rank <= n * 10 // 100) USING (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Host and path rules of the query, longest wins.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


@query("op12_url_filters")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_labels.labelled(), "url string, label int")
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filters.train(labelled))


def _repair_sql() -> str:
    """The cheapest edits of each conversation, turn by turn, as a fold over its list of turns."""
    far = 1_000_000_000_000  # the cost of a stack top that isn't reached

    def on(top: str, cost: str, letter: str) -> str:
        return f"{{c: {top}.c + {cost}, l: {top}.l || '{letter}'}}"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def only(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} ELSE {{c: CAST({far} AS BIGINT), l: ''}} END"

    def closed(s: str) -> tuple[str, str, str, str]:
        """The tops after insertions: a user turn behind any but a user turn, an answer behind that."""
        user = best(f"{s}.u", on(f"{s}.b", "3", "I"), on(f"{s}.s", "3", "I"), on(f"{s}.p", "3", "I"))
        return f"{s}.b", f"{s}.s", user, best(f"{s}.p", on(f"({user})", "3", "I"))

    b, s_, u, p_ = closed("acc")
    more = "CASE WHEN x.cut THEN 3 ELSE 0 END"
    before = best(b, s_, p_)
    step = f"""{{
        b: {on(b, "4", "D")},
        s: {best(on(s_, "4", "D"), only("NOT x.go AND x.i = 's'", on(b, more, "K")))},
        u: {best(on(f"({u})", "4", "D"), only("NOT x.go AND x.i = 'u'", on(f"({before})", more, "K")), only("NOT x.go", on(f"({before})", f"3 + {more}", "R")))},
        p: {best(on(f"({p_})", "4", "D"), only("NOT x.go AND x.i = 'a'", on(f"({u})", more, "K")), only("NOT x.go", on(f"({u})", f"3 + {more}", "R")))},
        i: '', go: false, cut: false}}"""
    none = f"{{c: CAST({far} AS BIGINT), l: ''}}"
    start = f"{{b: {{c: CAST(0 AS BIGINT), l: ''}}, s: {none}, u: {none}, p: {none}, i: '', go: false, cut: false}}"
    last = best("e.b", closed("e")[3])
    return f"""
    WITH crc_table AS MATERIALIZED (SELECT {CRC_TABLE} AS c),
    k AS MATERIALIZED (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations
    ),
    m AS (SELECT k.*, {crc_sql("name")} % 20 AS kind FROM k, crc_table),
    r AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM m
    ),
    o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            sha256(concat_ws(':', coalesce('=' || conv_id, 'null'), length(role), role, text)), copy) AS pos FROM r
    ),
    f AS (
        SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS cut,
               CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS initial,
               lag(CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
        FROM o
    ),
    g AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
               count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
               list({{b: {none}, s: {none}, u: {none}, p: {none}, i: initial, go: blank OR again, cut: cut}} ORDER BY pos) AS turns,
               list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
        FROM f GROUP BY conv_id
    ),
    d AS (SELECT *, list_reduce(turns, lambda acc, x: {step}, {start}) AS e FROM g),
    w AS (SELECT *, {last} AS best FROM d),
    n AS (
        SELECT *, string_split(best.l, '') AS ls, (length(best.l) - length(replace(best.l, 'D', ''))) AS gone,
               length(replace(best.l, 'D', '')) % 2 AS system FROM w
    ),
    t AS (
        SELECT *, list_transform(list_filter(range(1, length(best.l) + 1), lambda j: ls[j] <> 'D'), lambda j: {{
            letter: ls[j], place: j - 1 - len(list_filter(ls[1:j - 1], lambda y: y = 'D')), nth: j - len(list_filter(ls[1:j], lambda y: y = 'I'))}}) AS made
        FROM n
    ),
    z AS (
        SELECT *, coalesce(list_aggregate(list_transform(made, lambda v: concat(
            CASE WHEN v.letter = 'K' THEN roles[v.nth] WHEN system = 1 AND v.place = 0 THEN 'system' WHEN (v.place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END,
            ':', CASE WHEN v.letter = 'I' THEN '' ELSE texts[v.nth] END)), 'string_agg', chr(10)), '') AS repaired FROM t
    )
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
    """


@query("op11_conversation_repair", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.with_digests(rows, conversations.repaired_conversations(rows, dropped))
