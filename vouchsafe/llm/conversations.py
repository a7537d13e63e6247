"""Conversation repair by generalised LR parsing with weighted edits.

The roles of a conversation must follow ``conversation -> (system? pairs)?``, ``pairs -> pairs pair | pair``,
``pair -> user assistant``. A parse reads the turns from left to right and holds a graph-structured stack:
for each stack top the cheapest way to reach it, as (cost, letters of the edits). Delete, rerole and insert
are actions beside the table's shifts; equal tops merge by the smaller (cost, letters). Two different
strings of edits over the same turns that cost the same differ at some letter before either ends, so the
order survives whatever follows, and merging early is exact.

A conversation may be of any size. Turns are dealt into ranges of (conversation, turn) and cut into blocks of
consecutive rows; each block parses its runs of one conversation from every top that may stand before them,
which gives a small matrix of (cost, letters). Matrices of one conversation are multiplied in rounds of
neighbours. Copies of a turn are found by their digest with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.tables import written
from vouchsafe.operators.rows import lookup_join

KEEP, DELETE, REROLE, INSERT = "K", "D", "R", "I"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3
WORDS = {"s": "system", "u": "user", "a": "assistant"}

#: Stack tops: nothing read, a system turn, a user turn that waits for its answer, whole pairs.
START, SYSTEM, USER, PAIRS = range(4)
#: Shifts by role initial. The assistant's shift is followed by the reduction of its pair, which uncovers START,
#: SYSTEM or PAIRS and goes to PAIRS from each of them, so one link below USER is as good as any other.
SHIFT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIRS}, {"u": USER})
ACCEPTED = (START, PAIRS)

#: Binary logarithms of the consecutive rows that are parsed together, and of the runs of one conversation that are
#: multiplied in one task.
BLOCK_BITS, NEIGHBOUR_BITS = 10, 6

Paths = dict[int, tuple[int, str]]

BLANK = r"^[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"


def _better(paths: Paths, top: int, cost: int, letters: str) -> bool:
    if top in paths and paths[top] <= (cost, letters):
        return False
    paths[top] = cost, letters
    return True


def insertions(paths: Paths) -> Paths:
    """The tops that inserted turns reach, beside those that are there."""
    waiting = list(paths)
    while waiting:
        top = waiting.pop()
        cost, letters = paths[top]
        for role in "ua":
            to = SHIFT[top].get(role)
            if to is not None and _better(paths, to, cost + INSERT_COST, letters + INSERT):
                waiting.append(to)
    return paths


def read_turn(paths: Paths, initial: str, must_go: bool, truncated: bool) -> Paths:
    """The tops behind one more turn."""
    found: Paths = {}
    more = TRUNCATED_COST if truncated else 0
    for top, (cost, letters) in insertions(paths).items():
        _better(found, top, cost + DELETE_COST, letters + DELETE)
        if must_go:
            continue
        for role, to in SHIFT[top].items():
            if role == initial:
                _better(found, to, cost + more, letters + KEEP)
            if role != "s":
                _better(found, to, cost + more + REROLE_COST, letters + REROLE)
    return found


def parse(turns: list[tuple[str, bool, bool]], start: int = START) -> Paths:
    """Cheapest (cost, letters) per stack top after ``turns`` (initial, must go, truncated)."""
    paths: Paths = {start: (0, "")}
    for turn in turns:
        paths = read_turn(paths, *turn)
    return insertions(paths)


def follow(paths: Paths, matrix: dict[int, Paths]) -> Paths:
    """Paths through one more stretch of turns, given its paths from each top."""
    found: Paths = {}
    for top, (cost, letters) in paths.items():
        for to, (more, behind) in matrix.get(top, {}).items():
            _better(found, to, cost + more, letters + behind)
    return found


def edits(letters: str) -> Iterator[tuple[str, str]]:
    """(letter, initial of the role that the turn gets) of each edit; nothing for a deleted turn.

    The letters say how many turns come out, and a first system turn makes that number odd.
    """
    left = len(letters) - letters.count(DELETE)
    system = left % 2
    place = 0
    for letter in letters:
        if letter == DELETE:
            yield letter, ""
        else:
            yield letter, "s" if system and not place else "ua"[(place - system) % 2]
            place += 1


# -- damage ---------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped): conv_id, turn, role, text after damage, and the conv_id of each row that it drops.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes its role ``user``. Null role and text are one blank, as are null conv_id and turn in the key.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    marked = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = marked.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy"), marked.where("kind = 0").select("conv_id")


# -- repair ---------------------------------------------------------------------------------------------------

RUN = (
    "conv_id {0}, block long, whole boolean, turns long, first_turn {1}, last_turn {1}, blank long, duplicate long,"
    " truncated long, illegal long, first string, last string,"
    " paths array<struct<start: int, top: int, cost: long, letters: string>>"
)


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every turn with what the parse needs: initial, key (digest), blank, cut."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    own = F.concat_ws(
        ":", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")), F.char_length("role"), "role", "text",
    )
    return plain.select(
        "*",
        F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"),
        F.substring(F.unhex(F.sha2(own.cast("binary"), 256)), 1, 16).alias("key"),
        F.rlike("text", F.lit(BLANK)).alias("blank"),
        (~F.rlike("text", F.lit(WHOLE))).alias("cut"),
    )


def _ordered(rows: DataFrame, dropped: DataFrame | None) -> DataFrame:
    """Turns without text, with ``pos`` that rises along each conversation: ranges dealt by Spark, rows sorted in them."""
    slim = _marked(rows).select("conv_id", "turn", "key", "initial", "blank", "cut").withColumn("present", F.lit(True))
    if dropped is not None:
        none = dropped.select("conv_id").withColumns({c: F.lit(None).cast(slim.schema[c].dataType) for c in slim.columns[1:-1]})
        slim = slim.unionByName(none.withColumn("present", F.lit(False)))
    order = ["conv_id", "turn", "key", "_row"]
    named = slim.withColumn("_row", F.monotonically_increasing_id())
    # a marker has a key of its own, so that no join brings all markers together
    named = named.withColumn("key", F.coalesce("key", F.col("_row").cast("string").cast("binary")))
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.drop("_row").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _with_copies(ordered: DataFrame) -> DataFrame:
    """``ordered`` with ``again``: an equal turn stands earlier in the conversation."""
    repeated = ordered.where("present").groupBy("key").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1")
    joined = lookup_join(ordered, repeated, "key", copies="n", spread=["pos"])
    return joined.withColumn("again", F.coalesce(F.col("pos") > F.col("first_pos"), F.lit(False))).drop("first_pos", "n")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _parse_block(table: pa.Table) -> pa.Table:
    """One row for each conversation in a block of consecutive rows."""
    table = table.sort_by("pos")
    columns = [table.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "cut", "again", "present")]
    ids, n, at, found = columns[0], table.num_rows, 0, []
    block = table.column("block")[0].as_py()
    while at < n:
        to = at + 1
        while to < n and ids[to] == ids[at]:
            to += 1
        rows = [r for r in zip(*(c[at:to] for c in columns[1:])) if r[-1]]
        inside = 0 < at and to < n  # the neighbours in the block belong to other conversations
        turns = [t for t, *_ in rows if t is not None]
        blank = [bool(b) for _, _, b, *_ in rows]
        again = [bool(a) and not b for b, (*_, a, _) in zip(blank, rows)]
        cut = [bool(c) and not b and not a for b, a, (_, _, _, c, _, _) in zip(blank, again, rows)]
        initials = [r[1] for r in rows]
        todo = list(zip(initials, (b or a for b, a in zip(blank, again)), cut))
        paths = [
            {"start": start, "top": top, "cost": cost, "letters": letters}
            for start in ((START,) if inside else range(len(SHIFT)))
            for top, (cost, letters) in parse(todo, start).items()
        ]
        found.append({
            "conv_id": ids[at], "block": block, "whole": inside, "turns": len(set(turns)),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "blank": sum(blank), "duplicate": sum(again), "truncated": sum(cut),
            "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])),
            "first": initials[0] if rows else None, "last": initials[-1] if rows else None, "paths": paths,
        })
        at = to
    return pa.Table.from_pylist(found, _schema(table))


def _schema(table: pa.Table) -> pa.Schema:
    whole, text = pa.int64(), pa.string()
    path = pa.struct([("start", pa.int32()), ("top", pa.int32()), ("cost", whole), ("letters", text)])
    kind, turn = table.schema.field("conv_id").type, table.schema.field("turn" if "turn" in table.schema.names else "first_turn").type
    return pa.schema([
        ("conv_id", kind), ("block", whole), ("whole", pa.bool_()), ("turns", whole), ("first_turn", turn), ("last_turn", turn),
        ("blank", whole), ("duplicate", whole), ("truncated", whole), ("illegal", whole), ("first", text), ("last", text),
        ("paths", pa.list_(path)),
    ])


def _join_two(a: dict, b: dict) -> dict:
    """Two neighbouring runs of a conversation as one."""
    matrix = _matrix(b)
    paths = [
        {"start": start, "top": top, "cost": cost, "letters": letters}
        for start, own in _matrix(a).items() for top, (cost, letters) in follow(own, matrix).items()
    ]
    touching = a["last"] is not None and b["first"] is not None
    return {
        "conv_id": a["conv_id"], "block": a["block"], "whole": False,
        "turns": a["turns"] + b["turns"] - (a["turns"] > 0 and b["turns"] > 0 and a["last_turn"] == b["first_turn"]),
        "first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"],
        "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"],
        **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")},
        "illegal": a["illegal"] + b["illegal"] + (touching and not _legal(a["last"], b["first"])),
        "first": b["first"] if a["first"] is None else a["first"], "last": a["last"] if b["last"] is None else b["last"],
        "paths": paths,
    }


def _matrix(run: dict) -> dict[int, Paths]:
    found: dict[int, Paths] = {}
    for p in run["paths"]:
        found.setdefault(p["start"], {})[p["top"]] = p["cost"], p["letters"]
    return found


def _join_runs(table: pa.Table) -> pa.Table:
    runs = table.drop_columns(["neighbours"]).sort_by("block").to_pylist()
    while len(runs) > 1:
        pairs = [_join_two(a, b) for a, b in zip(runs[::2], runs[1::2])]
        runs = pairs + runs[2 * len(pairs) :]
    return pa.Table.from_pylist(runs, _schema(table))


def repaired_conversations(rows: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in ``rows`` or ``dropped``.

    ``rows`` has conv_id, turn (a whole number), role and text; null role and text are one blank. A conversation's
    turns stand in order of ``turn``, nulls first, those of one turn in order of their digest. Each turn's first fault
    counts: blank, an equal role and text before, no ``.!?`` at the end. ``audit`` holds the letters of the cheapest
    edits, the ASCII-least of equally cheap ones. A null conv_id is a conversation; one without turns has zeros
    and an empty audit. An empty role has a blank as initial. Other columns are not read.
    """
    kinds = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    schema = RUN.format(*kinds)
    turns = _with_copies(_ordered(rows, dropped)).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    runs = written(turns.groupBy("block").applyInArrow(_parse_block, schema), "runs")
    # conversations in more than one block: neighbours are multiplied in rounds until few are left of each
    parts, bits = runs.where("NOT whole"), 0
    while True:
        most = parts.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits = bits + NEIGHBOUR_BITS if most > 1 << NEIGHBOUR_BITS else 63
        near = parts.withColumn("neighbours", F.shiftright("block", bits))
        parts = written(near.groupBy("conv_id", "neighbours").applyInArrow(_join_runs, schema), "runs")
        if bits == 63:
            break
    from_start = F.filter("paths", lambda p: (p["start"] == START) & p["top"].isin(*ACCEPTED))
    best = F.array_min(F.transform(from_start, lambda p: F.struct(p["cost"].alias("cost"), p["letters"].alias("letters"))))
    done = runs.where("whole").unionByName(parts).withColumn("_best", best)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return done.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("_best.cost").alias("cost"), F.col("_best.letters").alias("audit"),
    )


def _heads_and_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's result, then its turns in order, side by side in one partition."""
    turns = _marked(rows).select("conv_id", F.lit(1).alias("_at"), "turn", "key", "role", "text")
    heads = found.withColumn("_at", F.lit(0))
    dealt = heads.unionByName(turns, allowMissingColumns=True).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "_at", "turn", "key")


class _Writer:
    """The edits of one conversation, applied to its turns as they come."""

    def __init__(self, audit: str):
        self.edits = edits(audit)

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the inserted turns before this one, and of this one unless it is deleted."""
        for letter, initial in self.edits:
            if letter == INSERT:
                yield letter, WORDS[initial], ""
                continue
            if letter != DELETE:
                yield letter, role if letter == KEEP else WORDS[initial], text
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for letter, initial in self.edits:
            yield letter, WORDS[initial], ""


def repaired_turns(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the turns that come out of the repair.

    A conversation's turns pass through one task in order, never held together.
    """
    found = repaired_conversations(rows) if found is None else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, place = None, _Writer(""), 0
        schema = None
        for batch in batches:
            out: list[tuple] = []
            for conv, at, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_at", "audit", "role", "text"))):
                if at == 0:
                    for r in writer.rest():
                        out.append((now, place, *r))
                        place += 1
                    now, writer, place = conv, _Writer(audit), 0
                    continue
                for r in writer.turn(role, text):
                    out.append((now, place, *r))
                    place += 1
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))])
            yield _batch(out, schema)
        if schema is not None:
            yield _batch([(now, place + k, *r) for k, r in enumerate(writer.rest())], schema)

    dealt = _heads_and_turns(rows, found.select("conv_id", "audit"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``: of the repaired ``role:text`` in order, joined by line feeds.

    A digest is made in sequence by definition, so a conversation's texts stream through one task; no more than
    a batch of them and the letters of one conversation are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer, digest, first, schema = None, _Writer(""), hashlib.sha256(), True, None

        def put(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in turns:
                digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                first = False

        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in RESULT), ("repaired_sha256", pa.string())])
            out: list[tuple] = []
            roles, texts, at = (batch.column(c).to_pylist() for c in ("role", "text", "_at"))
            heads = [batch.column(c) for c in RESULT]
            for k, role, text in zip(range(len(at)), roles, texts):
                if at[k]:
                    put(writer.turn(role, text))
                    continue
                if head is not None:
                    put(writer.rest())
                    out.append((*head, digest.hexdigest()))
                head = tuple(c[k].as_py() for c in heads)
                writer, digest, first = _Writer(head[-1]), hashlib.sha256(), True
            yield _batch(out, schema)
        if head is not None:
            put(writer.rest())
            yield _batch([(*head, digest.hexdigest())], schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _heads_and_turns(rows, found.select(*RESULT)).mapInArrow(run, schema)
