"""Repair of the turn structure of conversations by lightest derivations.

Repairs are derived in a weighted hypergraph. An item says: the first k rows are edited, and what
they give ends in state q. An edge derives an item from its antecedents: the edit of one row (keep,
rerole, delete), or an insertion, applied to an item. The weight of a derivation is the pair (cost,
audit), the audit being the initials of its edits in order; edges only add to both, so the weight of
a head is never below that of an antecedent (a superior function), and Knuth's agenda may finalise
an item the first time it is popped. Two derivations of one item with the same cost never have
audits of which one begins the other: the longer one would end in insertions, which cost. So the
order of audits stays when both are extended, and the popped weight is the least.

Long conversations are derived in windows of ``WINDOW`` rows: the finalised items at the end of a
window are the axioms of the next, and what their audits have in common is put out. Rows of a
conversation stream through one task in order; it holds the audit, but never the texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows whose items one run of the agenda holds.
WINDOW = 64
#: Costs: another role, a deletion, an insertion, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row with such an initial leads from each state, where a user or assistant turn made
#: by an edit leads, and the states that may end a conversation.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MAKES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Rows in a batch that leaves a task.
OUT_ROWS = 256

Weight = tuple[int, str]


def edges(row: int, state: int, rows: list[tuple[str, int]]) -> Iterator[tuple[tuple[int, int], int, str]]:
    """(head, cost, initial) of the edges out of the item (row, state)."""
    yield (row, MAKES[state]), INSERT, "I"
    if row == len(rows):
        return
    initial, fault = rows[row]
    yield (row + 1, state), DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT_OFF else 0
    if (state, initial) in KEEPS:
        yield (row + 1, KEEPS[state, initial]), more, "K"
    yield (row + 1, MAKES[state]), REROLE + more, "R"


def agenda(axioms: dict[int, Weight], rows: list[tuple[str, int]], goals: tuple[int, ...] | None = None) -> dict[int, Weight]:
    """Least weights of the items after ``rows``, by state; with ``goals`` only of the first goal popped."""
    heap = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(heap)
    final: set[tuple[int, int]] = set()
    out: dict[int, Weight] = {}
    while heap:
        cost, audit, row, state = heapq.heappop(heap)
        if (row, state) in final:
            continue
        final.add((row, state))
        if row == len(rows):
            if goals is not None and state in goals:
                return {state: (cost, audit)}
            out[state] = (cost, audit)
            if goals is None and len(out) == len(MAKES):
                break
        for head, price, initial in edges(row, state, rows):
            if head not in final:
                heapq.heappush(heap, (cost + price, audit + initial, *head))
    return out


class Repair:
    """The lightest repair of rows that are given one by one as (initial, fault)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.items: dict[int, Weight] = {START: (0, "")}
        self.cost = 0
        self.audit: list[str] = []

    def add(self, initial: str, fault: int) -> None:
        self.rows.append((initial, fault))
        if len(self.rows) == WINDOW:
            self.items = agenda(self.items, self.rows)
            self.rows = []
            # The common start of all audits and the least cost belong to any repair.
            low, high = min(a for _, a in self.items.values()), max(a for _, a in self.items.values())
            n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            least = min(c for c, _ in self.items.values())
            self.cost += least
            self.audit.append(low[:n])
            self.items = {q: (c - least, a[n:]) for q, (c, a) in self.items.items()}

    def finish(self) -> Weight:
        (weight,) = agenda(self.items, self.rows, ENDS).values()
        return self.cost + weight[0], "".join(self.audit) + weight[1]


FOUND = "cid string, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Found:
    """What is told of one conversation, from its rows in order."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.initial: str | None = None
        self.least: int | None = None
        self.turn: int | None = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.repair.add(initial, fault)
        self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn = turn
            self.turns += 1

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return gaps, *self.faults[BLANK:], self.illegal, *self.repair.finish()


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _streamed(new, schema: str):
    """Conversations stream by: ``new()`` makes a helper whose add() gets each row and row() tells the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, helper, done = None, None, []
        for batch in batches:
            cid, known, *rest = (c.to_pylist() for c in batch.columns)
            for i, key in enumerate(zip(cid, known, strict=True)):
                if key != last:
                    if helper is not None:
                        done.append((*last, *helper.row()))
                        if len(done) >= OUT_ROWS:
                            yield _columns(done, schema)
                            done = []
                    last, helper = key, new()
                helper.add(*(c[i] for c in rest))
        if helper is not None:
            done.append((*last, *helper.row()))
        yield _columns(done, schema)

    return run


class _Rendered:
    """The digest of the repaired lines. The first row gives the audit, the others role and text."""

    def __init__(self) -> None:
        self.audit = ""
        self.at = 0
        self.state = START
        self.digest = sha256()
        self.empty = True

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def _made(self, text: str) -> None:
        self.state = MAKES[self.state]
        self._put("user" if self.state == USER else "assistant", text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._made("")

    def add(self, audit: str | None, role: str | None, text: str | None) -> None:
        if audit is not None:
            self.audit = audit
            return
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEPS[self.state, role[:1]]
            self._put(role, text)
        elif edit == "R":
            self._made(text)

    def row(self) -> tuple:
        self._inserted()
        return (self.digest.hexdigest(),)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after seeded damage, for trials of ``repair``.

    The CRC-32 of "conv_id:turn" modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes the
    ``.!?`` out of it, 3 repeats the row, 4 makes its role user. Nulls count as one space, in role
    and text too; conv_id and turn stay null.
    """
    space = F.lit(" ")
    text = F.coalesce(F.col(text_col).cast("string"), space)
    key = F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), space), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        text.alias("text"), F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20)).alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _key(conv_id: Column) -> list[Column]:
    """A conversation as (cid, known): a null id is not known."""
    return [F.coalesce(conv_id.cast("string"), F.lit("")).alias("cid"), conv_id.isNotNull().alias("known")]


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text), or of ``ids`` (conv_id) if given.

    Columns: conv_id; gaps, the turn numbers missing between the least and the greatest; blank,
    duplicate and truncated, rows by the first fault they have (no other character than ASCII white
    space; role and text of an earlier row; last such character not one of ``.!?``); illegal,
    neighbours whose role initials are not su, ua or au; cost and audit of the cheapest edits that
    make the role initials ``(s?(ua)+)?``, of equally cheap ones the least audit; repaired_sha256 of
    the repaired ``role:text`` lines. Keeping is free, another role costs 2, a deletion 3 (the only
    edit of blank and duplicate rows), an empty user or assistant turn put in 2, a truncated row
    that stays 1 more.

    Rows go by turn, nulls first and left out of gaps; rows of one turn by role and then by a digest
    of their text. A null role or text is one space; a role without characters can't be kept. Null
    conv_ids are one conversation; repeated rows are duplicates; very long texts are taken whole.
    Conversations of ``ids`` without rows have zeros, an empty audit and the digest of nothing.
    Other columns are not read. Empty tables give no rows.

    Faults are found by groups of equal rows. The agenda gets rows without texts, and the texts go
    through one more pass for the digest, which has to be taken in order: a conversation is a
    stream in one task, whose memory holds a character of audit for each of its rows.
    """
    space = F.lit(" ")
    rows = turns.select(
        *_key(F.col("conv_id")), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumn("mark", F.unhex(F.sha2(F.concat("role", F.lit(":"), "text"), 256)))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    kind = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    # Rows alike in role and text are one group; all but its first row are duplicates.
    alike = rows.groupBy("cid", "known", "mark", "turn", "role", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    alike = cut(alike, "alike")
    first = alike.groupBy("cid", "known", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    slim = alike.join(first, ["cid", "known", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    again = ~F.col("first.turn").eqNullSafe(F.col("turn")) | (F.col("copy") > 1)
    slim = slim.select(
        "cid", "known", "turn", "role", "mark", F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("kind") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("kind")).alias("fault"))
    # Of equal rows the one that is no duplicate comes first.
    slim = slim.repartition("cid", "known").sortWithinPartitions("cid", "known", F.asc_nulls_first("turn"), "role", "mark", F.col("fault") == DUPLICATE)
    found = cut(slim.select("cid", "known", "turn", "initial", "fault").mapInArrow(_streamed(_Found, FOUND), FOUND), "found")

    none = F.lit(None).cast("string")
    lines = found.select("cid", "known", "audit", none.alias("role"), none.alias("text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mark"), F.lit(0).alias("part"))
    lines = lines.unionByName(rows.withColumn("audit", none).withColumn("part", F.lit(1)).select(*lines.columns))
    lines = lines.repartition("cid", "known").sortWithinPartitions("cid", "known", "part", F.asc_nulls_first("turn"), "role", "mark")
    schema = "cid string, known boolean, repaired_sha256 string"
    digests = lines.select("cid", "known", "audit", "role", "text").mapInArrow(_streamed(_Rendered, schema), schema)

    named = (turns if ids is None else ids).select("conv_id").distinct().select("conv_id", *_key(F.col("conv_id")))
    out = named.join(found, ["cid", "known"], "left").join(digests, ["cid", "known"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
