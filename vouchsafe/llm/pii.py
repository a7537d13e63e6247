"""Format-preserving pseudonyms for personal numbers and dates, in column expressions alone.

A value that passes its format's validation is permuted with a keyed Feistel network over exactly the
values of that format: card numbers stay card numbers with a right check digit, dates stay dates. The
permutation depends on the key and the format only, so equal values stay equal in all documents and the
holder of the key can turn them back. Values that fail the validation stay as they are.

A network over ``p * q`` values keeps a number as (number div q, number mod q); a round adds a keyed hash
of one part to the other, modulo that part's own size, and swaps the parts. After an even number of rounds
the sizes are back in place, so no value outside the format is ever met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.tables import unused
from vouchsafe.operators.rows import let, once

ROUNDS = 8

_LEFT, _RIGHT = r"(?<![\w.+-])", r"(?![\w-])(?!\.\w)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = rf"(?:(?<![\w.+-])\+\d{{1,3}}[ .-]?)?(?<!\w)\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w.+-])(?:\+\d{{1,3}}[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_RIGHT}"
ADDRESS = rf"{_LEFT}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_RIGHT}"
PERSON = rf"{_LEFT}\d{{3}}-\d{{2}}-\d{{4}}{_RIGHT}"
DATE = rf"{_LEFT}\d{{4}}-\d{{2}}-\d{{2}}(?:(?=[Tt]\d{{2}})|{_RIGHT})|{_LEFT}\d{{2}}/\d{{2}}/\d{{4}}{_RIGHT}|{_LEFT}\d{{2}}\.\d{{2}}\.\d{{4}}{_RIGHT}"
_GROUP = r"\d++(?!\w|\.\w|-(?!\d+\b))"
#: A whole run of digit groups up to a value of another form; which windows of it are cards is judged afterwards.
CARD = rf"{_LEFT}(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -](?!{EMAIL}|{DATE}|{PERSON}|{PHONE}|{ADDRESS}){_GROUP})*+"
#: Layouts in which cards are printed; they go before other windows of a run.
CARD_LAYOUT = r"^(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3}|\d{6}([ -])\d{7,13}|\d{8}[ -]\d{8})$"
CARD_DIGITS = (13, 19)
WALKS = 32
KEY_ID = r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
SECRET = r"(?i:(?<!\w)(?:password|passwd|token|secret|api_key))\s*[=:]\s*\"?[0-9A-Za-z]{12,}\"?"
#: Order decides where two forms start at one place.
FORMS = {
    "email": EMAIL, "secret": SECRET, "key_id": KEY_ID, "date": DATE, "person": PERSON, "phone": PHONE, "address": ADDRESS,
    "card": CARD,
}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: Every form holds a digit or an @ or one of these words; other texts are not searched.
QUICK = r"[0-9@]|AKIA|(?i:passw|token|secret|api_key)"

# fixed values: days of the 400 years from 1800 to 2199 are 189 * 773
FIRST_DAY, DAYS_P, DAYS_Q = "1800-01-01", 189, 773


def _hash(key: str, kind: str, round_no: Column, part: Column) -> Column:
    """A keyed non-negative number of 60 bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), part.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(number: Column, p: Column, q: Column, key: str, kind: str, back: bool = False) -> Column:
    """Keyed permutation of the numbers below ``p * q`` (each part below 2**31); ``back`` inverts it."""
    start = F.struct(
        F.floor(number / q).alias("x"), (number % q).alias("y"),
        p.cast("long").alias("p"), q.cast("long").alias("q"),
    )

    def step(state: Column, n: Column) -> Column:
        if back:
            y = state["x"]
            x = F.pmod(state["y"] - _hash(key, kind, n, y) % state["q"], state["q"])
            return F.struct(x.alias("x"), y.alias("y"), state["q"].alias("p"), state["p"].alias("q"))
        x = (state["x"] + _hash(key, kind, n, state["y"]) % state["p"]) % state["p"]
        return F.struct(state["y"].alias("x"), x.alias("y"), state["q"].alias("p"), state["p"].alias("q"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, start, step, lambda s: s["x"] * s["q"] + s["y"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def _permute_digits(digits: Column, key: str, kind: str, back: bool) -> Column:
    """Keyed permutation of the digit strings of this length (2 to 18)."""
    size = F.length(digits)
    low = F.floor(size / 2)
    out = permute(digits.cast("long"), _power(size - low), _power(low), key, kind, back)
    return F.lpad(out.cast("string"), size, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order; everything else stays."""
    chars = F.split(form, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substr(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum of a digit string in which the last digit counts once, the one before it double, and so on."""
    places = F.split(F.reverse(digits), "")
    weighted = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0),
    ))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def card_valid(text: Column) -> Column:
    return (_luhn_sum(_digits(text)) % 10 == 0) & (_digits(text).cast("decimal(20,0)") > 0)


def card_windows(run: Column) -> Column:
    """array<struct(at, size)> in order: the parts of a digit run that are card numbers, no two overlapping.

    All windows of whole groups with 13 to 19 digits are judged. Where windows that pass overlap, an unbroken
    number goes first, then a printed layout, then the whole run, then the longer and the earlier one.
    """
    fewest, most = CARD_DIGITS

    def groups(c: Column) -> Column:
        digit = lambda i: F.coalesce(F.get(c, i).between("0", "9"), F.lit(False))
        places = F.sequence(F.lit(0), F.size(c) - 1)
        first = F.filter(places, lambda i: digit(i) & ~digit(i - 1))
        last = F.filter(places, lambda i: digit(i) & ~digit(i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def windows(g: Column) -> Column:
        from_here = lambda x, i: F.transform(
            F.slice(g, i + 1, F.lit(most)), lambda y, n: F.struct(
                (x["a"] + 1).alias("at"), (y["b"] - x["a"] + 1).alias("size"), n.alias("gaps"),
            ),
        )
        return F.filter(
            F.flatten(F.transform(g, from_here)), lambda w: (w["size"] - w["gaps"]).between(fewest, most),
        )

    def ranked(w: Column) -> Column:
        text = F.substr(run, w["at"], w["size"])
        rank = F.when(w["gaps"] == 0, 0).when(text.rlike(CARD_LAYOUT), 1).when(w["size"] == F.length(run), 2).otherwise(3)
        return F.struct(rank.alias("rank"), (-w["size"]).alias("less"), w["at"].alias("at"), w["size"].alias("size"))

    passing = F.filter(
        let(let(F.split(run, ""), groups), windows),
        lambda w: let(F.substr(run, w["at"], w["size"]), card_valid),
    )
    apart = lambda w, x: (w["at"] + w["size"] <= x["at"]) | (x["at"] + x["size"] <= w["at"])
    chosen = F.aggregate(
        F.array_sort(F.transform(passing, ranked)), F.array().cast("array<struct<at:int,size:int>>"),
        lambda kept, w: F.when(
            F.forall(kept, lambda x: apart(w, x)),
            F.array_append(kept, F.struct(w["at"].cast("int").alias("at"), w["size"].cast("int").alias("size"))),
        ).otherwise(kept),
    )
    return F.array_sort(chosen)


def _cards(run: Column, windows: Column, key: str, back: bool) -> Column:
    """The run with its card windows permuted.

    New digits can make a window pass that goes before the chosen ones; then the permutation goes on until the run
    is read as before, so that the way back finds the same windows. A run that needs more than ``WALKS``
    steps (a long table of numbers) keeps its last state.
    """

    end = lambda w: w["at"] + w["size"]

    def changed(text: Column) -> Column:
        part = lambda w, i: let(F.coalesce(end(F.get(windows, i - 1)), F.lit(1)), lambda at: F.concat(
            F.substr(text, at, w["at"] - at), let(F.substr(text, w["at"], w["size"]), lambda t: _card(t, key, back)),
        ))
        rest = F.coalesce(end(F.get(windows, F.size(windows) - 1)), F.lit(1))
        return F.concat(F.array_join(F.transform(windows, part), ""), F.substr(text, rest, F.length(text)))

    def step(state: Column, n: Column) -> Column:
        done = state["done"] | ((n > 0) & (card_windows(state["run"]) == windows))
        return let(done, lambda d: F.struct(F.when(d, state["run"]).otherwise(changed(state["run"])).alias("run"), d.alias("done")))

    start = F.struct(run.alias("run"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), start, step, lambda s: s["run"])


def _card(text: Column, key: str, back: bool) -> Column:
    """All digits but the check digit are permuted, the check digit is computed anew."""
    digits = _digits(text)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = _permute_digits(payload, key, "card", back)
    check = F.pmod(-_luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)).cast("string")
    return _refill(text, F.concat(new, check))


def address_valid(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda o: o.cast("int") <= 255)


def _address(text: Column, key: str, back: bool) -> Column:
    number = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    out = permute(number, F.lit(65536), F.lit(65536), key, "address", back)
    octets = F.transform(F.array(*[F.lit(n) for n in (16777216, 65536, 256, 1)]), lambda n: (F.floor(out / n) % 256).cast("string"))
    return F.array_join(octets, ".")


def _phone_number(text: Column) -> Column:
    return F.substr(_digits(text), F.length(_digits(text)) - 9, F.lit(10))


def _phone(text: Column, key: str, back: bool) -> Column:
    """Country code and layout stay. Area and exchange codes that start with 2 to 9 keep to such codes."""
    number = _phone_number(text)
    area, exchange = F.substring(number, 1, 3).cast("long"), F.substring(number, 4, 3).cast("long")
    plan = (area >= 200) & (exchange >= 200)
    packed = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + F.substring(number, 7, 4).cast("long")
    inside = permute(packed, F.lit(80_000), F.lit(80_000), key, "phone", back)
    strict = F.concat(
        (F.floor(inside / 8_000_000) + 200).cast("string"), (F.floor(inside / 10_000) % 800 + 200).cast("string"),
        F.lpad((inside % 10_000).cast("string"), 4, "0"),
    )
    # numbers outside the plan keep their first digit of both codes and permute the rest
    loose_in = F.concat(F.substring(number, 2, 2), F.substring(number, 5, 6))
    loose = _permute_digits(loose_in, key, "phone-other", back)
    other = F.concat(
        F.substring(number, 1, 1), F.substring(loose, 1, 2), F.substring(number, 4, 1), F.substring(loose, 3, 6),
    )
    code = F.substr(_digits(text), F.lit(1), F.length(_digits(text)) - 10)
    return _refill(text, F.concat(code, F.when(plan, strict).otherwise(other)))


def person_valid(text: Column) -> Column:
    area = F.substring(text, 1, 3).cast("int")
    return area.between(1, 899) & (area != 666) & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")


def _person(text: Column, key: str, back: bool) -> Column:
    """898 areas x 99 groups x 9,999 serials, exactly."""
    area = F.substring(text, 1, 3).cast("long")
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    number = (index * 99 + F.substring(text, 5, 2).cast("long") - 1) * 9999 + F.substring(text, 8, 4).cast("long") - 1
    out = permute(number, F.lit(898 * 99), F.lit(9999), key, "person", back)
    place = F.floor(out / (99 * 9999)) + 1
    digits = F.concat(
        F.lpad((place + F.when(place >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.floor(out / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((out % 9999 + 1).cast("string"), 4, "0"),
    )
    return _refill(text, digits)


def _day(text: Column) -> Column:
    """Year-month-day; with a slash the month comes first unless it can't, with a dot the day comes first."""
    day_first = text.contains(".") | (text.contains("/") & (F.substring(text, 1, 2).cast("int") > 12))
    other = F.when(day_first, F.try_to_date(F.translate(text, "./", "--"), "dd-MM-yyyy")).otherwise(
        F.try_to_date(F.translate(text, "/", "-"), "MM-dd-yyyy"),
    )
    return F.when(text.rlike("^[0-9]{4}-"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(other)


def date_valid(text: Column) -> Column:
    return F.coalesce(_day(text).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))


def _date(text: Column, key: str, back: bool) -> Column:
    """A day of the same 400 years. A slash date is written month first, also where it could only be read day first."""
    first = F.lit(FIRST_DAY).cast("date")
    number = F.date_diff(_day(text), first).cast("long")
    slash = text.contains("/")
    new = F.date_add(first, permute(number, F.lit(DAYS_P), F.lit(DAYS_Q), key, "date", back).cast("int"))
    return (
        F.when(text.contains("."), F.date_format(new, "dd.MM.yyyy"))
        .when(slash, F.date_format(new, "MM/dd/yyyy"))
        .otherwise(F.date_format(new, "yyyy-MM-dd"))
    )


def _characters(text: Column, key: str, kind: str, back: bool, hexadecimal: bool = False) -> Column:
    """Feistel network on the two halves of a string; each character keeps its class (digit, small, capital).

    A round shifts the characters of one half within their classes by a keyed stream of the other half.
    """
    size = F.length(text)
    middle = F.floor(size / 2).cast("int")

    def shift(part: Column, other: Column, n: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            base = (
                F.when(c.between("0", "9"), 10).when(c.between("a", "f") if hexadecimal else c.between("a", "z"), 6 if hexadecimal else 26)
                .when(c.between("A", "F") if hexadecimal else c.between("A", "Z"), 6 if hexadecimal else 26)
            )
            zero = F.when(c.between("0", "9"), F.ascii(F.lit("0"))).when(c.between("a", "z"), F.ascii(F.lit("a"))).otherwise(F.ascii(F.lit("A")))
            move = _hash(key, kind, n, F.concat_ws("|", i.cast("string"), other)) % base
            value = F.ascii(c) - zero
            return F.when(base.isNull(), c).otherwise(F.char(zero + F.pmod(value - move if back else value + move, base)))

        return F.array_join(F.transform(F.split(part, ""), one), "")

    start = F.struct(F.substr(text, F.lit(1), middle).alias("x"), F.substr(text, middle + 1, size).alias("y"))

    def step(state: Column, n: Column) -> Column:
        if back:
            return F.struct(shift(state["y"], state["x"], n).alias("x"), state["x"].alias("y"))
        return F.struct(state["y"].alias("x"), shift(state["x"], state["y"], n).alias("y"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    # after an even number of rounds both halves have their first lengths again
    return F.aggregate(order, start, step, lambda s: F.concat(s["x"], s["y"]))


def _email(text: Column, key: str, back: bool) -> Column:
    at = F.instr(text, "@")
    return F.concat(_characters(F.substr(text, F.lit(1), at - 1), key, "email", back), F.substr(text, at, F.length(text)))


def _secret(text: Column, key: str, back: bool) -> Column:
    head = F.regexp_extract(text, r"^(.*[=:]\s*\"?)[0-9A-Za-z]+\"?$", 1)
    body = F.regexp_extract(text, r"([0-9A-Za-z]+)\"?$", 1)
    new = F.when(body.rlike("^[0-9a-fA-F]+$"), _characters(body, key, "hex", back, True)).otherwise(
        _characters(body, key, "secret", back),
    )
    return F.concat(head, new, F.when(text.endswith('"'), '"').otherwise(""))


def _key_id(text: Column, key: str, back: bool) -> Column:
    return F.concat(F.substring(text, 1, 4), _characters(F.substring(text, 5, 16), key, "key-id", back))


_Change = Callable[[Column, str, bool], Column]
#: Cards are changed by window, not as a whole.
_CHANGES: dict[str, tuple[Callable[[Column], Column] | None, _Change | None]] = {
    "email": (None, _email), "secret": (None, _secret), "key_id": (None, _key_id), "date": (date_valid, _date),
    "person": (person_valid, _person), "phone": (None, _phone), "address": (address_valid, _address), "card": (None, None),
}


def kind_of(match: Column) -> Column:
    """Form of a found value, null where its validation fails; a run of digits is a "card" without validation."""
    out: Column | None = None
    for kind, pattern in FORMS.items():
        valid = _CHANGES[kind][0]
        # a run is the last form, and only its surroundings decide where it ends
        hit = match.rlike(r"^[0-9][0-9 -]{12,}$" if kind == "card" else f"^(?:{pattern})$")
        value = F.lit(kind) if valid is None else F.when(valid(match), kind)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def marked_value(match: Column) -> Column:
    """struct(value, kind, windows, n): a found value, its form, the cards of a run, the number of values to replace."""
    whole = lambda kind, windows: F.struct(
        match.alias("value"), F.when((kind != "card") | (F.size(windows) > 0), kind).alias("kind"), windows.alias("windows"),
        F.when(kind == "card", F.size(windows)).otherwise(1).cast("long").alias("n"),
    )
    return let(kind_of(match), lambda kind: let(F.when(kind == "card", card_windows(match)), lambda windows: whole(kind, windows)))


def pseudonym(mark: Column, key: str, back: bool = False) -> Column:
    match, kind = mark["value"], mark["kind"]
    out = F.when(kind == "card", _cards(match, mark["windows"], key, back))
    for name, (_, change) in _CHANGES.items():
        if change is not None:
            out = out.when(kind == name, change(match, key, back))
    return out.otherwise(match)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with every personal value in ``text`` replaced, all other columns and rows unchanged.

    ``counts`` names a column (map of form to number of replaced values) to add. Null and empty texts stay
    as they are. ``back`` turns the values back with the same key; it finds a value where its replacement
    still has the form, which every form keeps.
    """
    there = F.col(f"`{text}`")
    matches, marks = unused(docs, "_matches", "_marked")
    hit = F.coalesce(there.rlike(QUICK), F.lit(False))
    empty = F.array().cast("array<string>")
    found = once(
        docs,
        **{matches: F.when(hit, F.regexp_extract_all(there, F.lit(ANY), F.lit(0))).otherwise(empty)},
    )
    marked = once(found, **{marks: F.transform(matches, marked_value)})
    # what stands between the values is cut out once, not again for each value
    rebuilt = let(F.split(there, ANY, -1), lambda between: F.concat(
        F.element_at(between, 1),
        F.array_join(
            F.transform(marks, lambda m, i: F.concat(
                pseudonym(m, key, back), F.coalesce(F.get(between, i + 1), F.lit("")),
            )),
            "",
        ),
    ))
    changed = F.when(F.exists(marks, lambda m: m["kind"].isNotNull()), rebuilt).otherwise(there)
    out = {text: changed}
    if counts:
        kinds = F.transform(F.filter(marks, lambda m: m["kind"].isNotNull()), lambda m: m["kind"])
        out[counts] = F.map_from_entries(F.transform(
            F.array_sort(F.array_distinct(kinds)),
            lambda k: F.struct(k, F.aggregate(
                F.filter(marks, lambda m: m["kind"] == k), F.lit(0).cast("long"), lambda a, m: a + m["n"],
            )),
        ))
    return marked.withColumns(out).drop(matches, marks)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of replaced values in all and by form."""
    done = pseudonymise(docs.select("doc_id", "text"), key, counts="_counts")
    number = lambda k: F.coalesce(F.try_element_at("_counts", F.lit(k)), F.lit(0)).cast("long")
    return done.select(
        "doc_id", "text",
        F.coalesce(F.aggregate(F.map_values("_counts"), F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0)).alias("replaced"),
        *[number(k).alias(f"n_{k}") for k in FORMS],
    )
