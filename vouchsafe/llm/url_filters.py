"""URL filters: host and path rules, and for the rest a logistic regression on hashed character n-grams.

Everything is column expressions. A page's n-grams are cut, hashed and summed inside its own row against an
array of weights, so pages are neither exploded nor shuffled. Training holds the small labelled table in one
row of nested arrays and repeats gradient steps with ``aggregate``: the weights are kept as the labelled
addresses' coefficients, so a step is two sparse products.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.tables import lower_ascii, written
from vouchsafe.operators.rows import let, once

#: Buckets of the n-grams. Few are taken by a small labelled table, so n-grams that it lacks rarely count.
BUCKETS = 1 << 16
#: Lengths of the n-grams, in characters.
SIZES = (3, 4)
#: Labelled addresses that are learned from, those with the smallest hashes: bounds the row that training works on.
LABELLED = 2048
#: Gradient steps, the weight decay, and the share of the last move that the next step starts with.
STEPS, DECAY, MOMENTUM = 200, 0.05, 0.9


def host_and_path(url: Column) -> Column:
    """Struct of host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up
    to ``?``, ``#`` or the end). Null, or without ``://``: both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise(None)
    after = F.coalesce(F.substring(url, F.char_length(rest) + 4, F.char_length(url)), F.lit(""))
    return let(
        after,
        lambda a: let(
            F.regexp_extract(a, "^[^/?#]*", 0),
            lambda h: F.struct(
                lower_ascii(h).alias("host"),
                F.regexp_extract(F.substring(a, F.char_length(h) + 1, F.char_length(a)), "^[^?#]*", 0).alias("path"),
            ),
        ),
    )


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones that with the longer host.

    ``rules`` holds (verdict, host followed by the start of the path). A rule fits its host and all
    subdomains when the path starts with the rule's. The list is part of the plan.
    """
    cut = [(rule, verdict, *(rule.partition("/")[0], rule[len(rule.partition("/")[0]) :])) for verdict, rule in rules]
    cut.sort(key=lambda r: (-len(r[0]), -len(r[2]), r[0]))
    if not cut:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    listed = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit("." + h).alias("host"), F.lit(p).alias("path")) for r, v, h, p in cut]
    )
    fits = F.filter(listed, lambda r: F.endswith(F.concat(F.lit("."), host), r["host"]) & F.startswith(path, r["path"]))
    return let(F.get(fits, F.lit(0)), lambda r: F.when(r.isNotNull(), F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def gram_buckets(kind: str, text: Column, sizes: Sequence[int] = SIZES, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the n-grams of ``text``, in order; ``kind`` keeps those of hosts and paths apart."""

    def grams(chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        gram = lambda i: F.concat(F.lit(kind), *[F.get(chars, i + k) for k in range(n)])
        return F.transform(starts, lambda i: F.crc32(gram(i).cast("binary")) % buckets)

    # split cuts at characters; with marks at both ends the first and last letters are n-grams of their own
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return let(chars, lambda c: F.array_distinct(F.concat(*[grams(c, n) for n in sizes])))


def address_features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The two lists of buckets of an address; an empty host or path has none."""
    return F.array(gram_buckets("h", host, buckets=buckets), gram_buckets("p", path, buckets=buckets))


def train(
    labelled: DataFrame, *, most: int = LABELLED, steps: int = STEPS, decay: float = DECAY, buckets: int = BUCKETS,
) -> DataFrame:
    """(bucket, weight) from ``labelled`` (url, label 1 to block or 0 to allow); bucket ``buckets`` holds the intercept.

    Each list of an address has length one as a vector. Rows with a null url or another label are left out;
    repeated rows count each. Only the ``most`` rows with the smallest hashes of url and label are learned from.
    Without rows there are no weights, and nothing is blocked.
    """
    known = labelled.where("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("double").alias("y"))
    some = known.orderBy(F.xxhash64("url", "y"), "url", "y").limit(most)
    # from here on everything has the size of `most` addresses
    numbered = some.withColumn("n", F.row_number().over(Window.orderBy("url", "y")) - 1)
    lists = once(numbered, _a=host_and_path(F.col("url"))).select(
        "n", "y", F.explode(F.concat(address_features(F.col("_a.host"), F.col("_a.path"), buckets), F.array(F.array(F.lit(buckets).cast("long"))))).alias("b"),
    )
    entries = written(lists.select("n", "y", F.explode("b").alias("bucket"), (1 / F.sqrt(F.greatest(F.size("b"), F.lit(1)))).alias("x")), "url-features")
    grouped = entries.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("at"))
    columns = written(grouped.withColumn("k", F.row_number().over(Window.orderBy("bucket")) - 1), "url-columns")
    rows = (
        entries.join(columns.select("bucket", "k"), "bucket").groupBy("n", "y")
        .agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("has"))
    )
    both = rows.select(F.struct("n", "y", "has").alias("row"), F.lit(None).alias("column")).unionByName(
        columns.select(F.lit(None).alias("row"), F.struct("k", "bucket", "at").alias("column")),
    )
    one = both.agg(F.sort_array(F.collect_list("row")).alias("rows"), F.sort_array(F.collect_list("column")).alias("columns"))

    def dot(entries: Column, place: str, values: Column) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["x"] * F.get(values, e[place]))

    def weights(parts: Column) -> Column:
        return F.transform(F.col("columns"), lambda c: dot(c["at"], "n", parts))

    def stepped(parts: Column) -> Column:
        # each address has a squared length of 3 at most, so this step never overshoots
        step = F.lit(4 / 3) / F.size("rows")
        return let(
            weights(parts),
            lambda w: F.zip_with(
                F.col("rows"), parts,
                lambda r, a: a * (1 - step * decay) + step * (r["y"] - 1 / (1 + F.exp(-dot(r["has"], "k", w)))),
            ),
        )

    def moved(state: Column) -> Column:
        ahead = F.zip_with(state["now"], state["before"], lambda a, b: a + MOMENTUM * (a - b))
        return F.struct(let(ahead, stepped).alias("now"), state["now"].alias("before"))

    zeros = F.transform(F.col("rows"), lambda _: F.lit(0.0))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(zeros.alias("now"), zeros.alias("before")), lambda state, _: moved(state))
    learned = one.select("columns", last["now"].alias("parts"))
    return learned.select(F.inline(F.arrays_zip(F.col("columns.bucket").alias("bucket"), weights(F.col("parts")).alias("weight"))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], weights: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url).

    The verdict is the longest fitting rule's; where none fits, ``block`` from a score of 0.5 on. ``score`` is
    the model's probability, null where a rule decides. Null and malformed addresses have an empty host and
    path, which the model judges like any other. Rows that repeat are judged each; no rows, no rows.
    """
    # at most `buckets` rows, and not more than the labelled addresses have n-grams; a constant of the plan
    known = {r["bucket"]: r["weight"] for r in weights.collect()}
    w = F.split(F.lit(",".join(repr(known[b]) if b in known else "0" for b in range(buckets + 1))), ",").cast("array<double>")
    read = once(pages.select("page_id", "url"), _a=host_and_path(F.col("url"))).select("page_id", F.col("_a.host").alias("host"), F.col("_a.path").alias("path"))
    ruled = once(read, _r=matched_rule(F.col("host"), F.col("path"), rules))
    margin = let(
        w,  # named once, so the plan holds it once
        lambda all_w: F.aggregate(
            address_features(F.col("host"), F.col("path"), buckets), F.get(all_w, F.lit(buckets)),
            lambda total, found: total + F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(all_w, b)) / F.sqrt(F.greatest(F.size(found), F.lit(1))),
        ),
    )
    scored = once(ruled, score=F.when(F.col("_r").isNull(), 1 / (1 + F.exp(-margin))))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")
