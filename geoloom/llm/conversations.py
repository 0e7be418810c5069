"""Repair the order of roles in conversations at the least cost.

A conversation is well formed if the initials of its roles spell `(s?(ua)+)?`. A
row's first fault counts: blank (nothing but space), duplicate (the same role and
text stood before), truncated (the last visible character is none of `.!?`). Edits
and what they cost: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit
of blank and duplicate rows), Insert an empty turn 2; a truncated row that stays
adds 1. Costs to go are found backwards over turn and state of the grammar; a walk
forwards then takes, of the edits on a cheapest way, the one with the least initial
in ASCII order (D, I, K, R). In a state an initial leads to one state only, so this
is the least string of edits.

Rows of a conversation stand in the order of turn (nulls first), then role, then
text as far as its first 16 characters tell, then the text's SHA-256. Null roles
and texts count as one space; so does a null conversation or turn in the key of
`damage_turns`. Rows with a null conversation form one of their own. Roles that
begin otherwise than with s, u or a can only be reroled or deleted. Rows that
repeat are duplicates; very long texts count whole; an empty table gives no rows.
Other columns are left out, whatever their names.

How it scales: faults are found on rows without texts (digests instead), where equal
rows are counted before the shuffle and a text that fills much of a conversation is
split by adaptive execution. Rows without texts and rows with texts then meet by
conversation in one sorted stream. A task holds a batch and three bytes for each
row of one conversation, which is what its string of edits takes anyhow: a digest
of one conversation's text has to pass through one process in order, so that the
stream, not the group, is what a very long conversation puts into a task. Costs to
go, less their minimum, take few values, so the backward pass is a table look-up a
row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import splittable

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a. By state, where each initial leads.
LEADS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: The initial that an inserted or reroled turn has in each state.
GIVEN = tuple(next(x for x in "ua" if x in leads) for leads in LEADS)
INITIALS = "sua"
CLEAN, BLANK, DUPLICATE, CUT = range(4)
LEGAL = ("su", "ua", "au")


def damage_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: the rows with one fault in five planted by a checksum of `conv:turn`.

    copies: 0 (dropped), 1 or 2 (repeated).
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled(conv_col), filled(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled(text_col), ".!?", "")).otherwise(filled(text_col))
    role = F.when(kind == 4, "user").otherwise(filled(role_col))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def last_visible(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def stream(rows: DataFrame) -> DataFrame:
    """Each conversation's rows without texts (part 0), then those with texts (part 1), in one order.

    rows: conv_id, turn, role, text, copies.
    """
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    full = rows.select("conv_id", conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    full = full.withColumns({"head": F.substring("text", 1, 16), "digest": F.unhex(F.sha2("text", 256))})
    counted = full.groupBy("conv", "turn", "role", "head", "digest").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("copies").alias("copies"),
        F.max(F.length(F.rtrim("text", F.lit(SPACE))) == 0).alias("blank"),
        F.max(~last_visible(F.col("text")).isin(".", "!", "?")).alias("cut"),
    )
    # the least of structs takes a null turn for the smallest
    first = counted.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    marked = counted.join(splittable(first, "conv"), ["conv", "role", "digest"], "left")
    later = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), CUT).otherwise(CLEAN)
    order = ["turn", "role", "head", "digest"]
    narrow = marked.select("conv", F.lit(0).alias("part"), *order, "copies", fault.alias("fault"), "conv_id", F.lit(None).cast("string").alias("text"))
    texts = full.where("copies > 0").select("conv", F.lit(1).alias("part"), *order, "copies", F.lit(None).cast("int").alias("fault"), "conv_id", "text")
    met = narrow.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", *order)
    return met.select("conv", "part", "conv_id", "turn", "role", "copies", "fault", "text")


class Costs:
    """Costs to go by state, less their minimum, as numbered vectors; steps between them are kept."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, str]] = {}
        ending = [0 if q in ACCEPTED else None for q in range(4)]
        self.last, _ = self.number(self.with_inserts(ending))

    def with_inserts(self, cost: list[int | None]) -> list[int]:
        """Costs where turns may be inserted first; None: no way on without."""
        far = 1 << 40
        out = [far if c is None else c for c in cost]
        for _ in range(3):  # three inserts lead through every state
            out = [min(c, INSERT + out[LEADS[q][GIVEN[q]]]) for q, c in enumerate(out)]
        return out

    def number(self, cost: list[int]) -> tuple[int, int]:
        low = min(cost)
        vector = tuple(c - low for c in cost)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], low

    def ways(self, after: tuple[int, ...], code: int, q: int) -> dict[str, int]:
        """By its initial, what each edit of a row costs in state q with what follows."""
        initial, fault = code >> 2, code & 3
        found = {"D": DELETE + after[q]}
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if initial < 3 and INITIALS[initial] in LEADS[q]:
                found["K"] = KEEP + extra + after[LEADS[q][INITIALS[initial]]]
            found["R"] = REROLE + extra + after[LEADS[q][GIVEN[q]]]
        return found

    def step(self, after: int, code: int) -> tuple[int, int, str]:
        """(vector before a row, what the minimum grows by, the edit of each state) from the vector after it."""
        if (after, code) not in self.steps:
            ways = [self.ways(self.vectors[after], code, q) for q in range(4)]
            cost = self.with_inserts([min(w.values()) for w in ways])
            tight = []
            for q, w in enumerate(ways):
                w["I"] = INSERT + cost[LEADS[q][GIVEN[q]]]
                tight.append(min(x for x, c in w.items() if c == cost[q]))
            self.steps[after, code] = (*self.number(cost), "".join(tight))
        return self.steps[after, code]

    def cheapest(self, codes: bytes | bytearray) -> tuple[int, str]:
        """The least cost and the edits of a conversation's rows."""
        behind, at, total = array("H"), self.last, 0
        for code in reversed(codes):
            behind.append(at)
            at, more, _ = self.step(at, code)
            total += more
        total += self.vectors[at][0]
        edits: list[str] = []
        q = 0
        for code, after in zip(codes, reversed(behind), strict=True):
            tight = self.step(after, code)[2]
            while (edit := tight[q]) == "I":
                edits.append(edit)
                q = LEADS[q][GIVEN[q]]
            edits.append(edit)
            q = moved(q, edit, code >> 2)
        while q not in ACCEPTED:
            edits.append("I")
            q = LEADS[q][GIVEN[q]]
        return total, "".join(edits)


def moved(q: int, edit: str, initial: int) -> int:
    """The state after a row."""
    return q if edit == "D" else LEADS[q][GIVEN[q] if edit == "R" else INITIALS[initial]]


def initial_of(role: str) -> int:
    return INITIALS.index(role[0]) if role and role[0] in INITIALS else 3


class Conversation:
    """One conversation of the stream: codes and turns first, then its texts."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.low: int | None = None
        self.high: int | None = None
        self.distinct = 0
        self.edits: str | None = None

    def note(self, turn: int | None, role: str, copies: int, fault: int) -> None:
        if copies <= 0:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        kind = initial_of(role) << 2
        self.codes.append(kind | fault)
        self.codes += bytes([kind | (BLANK if fault == BLANK else DUPLICATE)]) * (copies - 1)

    def solve(self, costs: Costs) -> None:
        if self.edits is None:
            self.cost, self.edits = costs.cheapest(self.codes)
            self.q = self.at = 0

    def repaired(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that come with a row."""
        initial = initial_of(role)
        for _ in range(copies):
            yield from self.inserted()
            edit = self.edits[self.at]
            self.at += 1
            if edit != "D":
                yield edit, ROLES[GIVEN[self.q]] if edit == "R" else role, text
            self.q = moved(self.q, edit, initial)

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits.startswith("I", self.at):
            self.at += 1
            yield "I", ROLES[GIVEN[self.q]], ""
            self.q = LEADS[self.q][GIVEN[self.q]]

    def summary(self) -> tuple:
        code = np.frombuffer(bytes(self.codes), np.uint8)
        faults = np.bincount(code & 3, minlength=4)
        initial = code >> 2
        pairs = np.bincount(initial[:-1].astype(int) * 4 + initial[1:], minlength=16)
        legal = sum(int(pairs[INITIALS.index(a) * 4 + INITIALS.index(b)]) for a, b in LEGAL)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), max(len(code) - 1, 0) - legal, self.cost, self.edits


def conversations(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[tuple[Conversation, Iterator[tuple[str, str, str]]]]:
    """(conversation, the repaired turns that follow): several times for one conversation, the last with what is inserted at its end."""
    now, conv = None, None
    for batch in batches:
        for key, part, conv_id, turn, role, copies, fault, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != conv:
                if now is not None:
                    now.solve(costs)
                    yield now, now.inserted()
                now, conv = Conversation(conv_id), key
            if part == 0:
                now.note(turn, role, copies, fault)
            else:
                now.solve(costs)
                yield now, now.repaired(role, text, copies)
    if now is not None:
        now.solve(costs)
        yield now, now.inserted()


def summaries(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    costs, rows, now, digest, first = Costs(), [], None, None, True

    def closed() -> tuple:
        return *now.summary(), digest.hexdigest()

    for conversation, turns in conversations(batches, costs):
        if conversation is not now:
            if now is not None:
                rows.append(closed())
            now, digest, first = conversation, hashlib.sha256(), True
        for _, role, text in turns:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if now is not None:
        rows.append(closed())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def turns_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    costs, rows, size, now, position = Costs(), [], 0, None, 0
    for conversation, turns in conversations(batches, costs):
        if conversation is not now:
            now, position = conversation, 0
        for edit, role, text in turns:
            rows.append((now.conv_id, position, edit, role, text))
            position += 1
            size += 64 + len(text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def repair_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), edit (K, R or I), role, text.

    rows: conv_id, turn, role, text and copies (how often a row stands there).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", arrow_type(rows, "conv_id")), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return stream(rows).mapInArrow(lambda batches: turns_of(batches, schema), f"conv_id {kind}, position long, edit string, role string, text string")


def repair_summaries(rows: DataFrame) -> DataFrame:
    """A row for each conversation: faults, cost, edits (`audit`) and the digest of the repaired turns.

    rows: as for `repair_turns`; a conversation of which no row is left (copies 0)
    has zeros, no edits and the digest of nothing.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", arrow_type(rows, "conv_id")), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    columns = ", ".join(f"{c} long" for c in counts)
    return stream(rows).mapInArrow(lambda batches: summaries(batches, schema), f"conv_id {kind}, {columns}, audit string, repaired_sha256 string")
