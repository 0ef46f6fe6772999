"""Repair of conversations by depth-first branch and bound.

A conversation's rows, in order of turn, are edited at least cost so that the initials of their roles read ``(s?(ua)+)?``: a row is kept
(0), given the role of a user or an assistant (3) or deleted (4), and empty turns of either are inserted (3). Blank rows and duplicates
must be deleted; a truncated row costs 3 more unless it is. ``audit`` has the edits' initials in order; of the cheapest the ASCII-least counts.

Search. Nodes are (rows read, state), the state being what has been written so far: nothing, a system turn, a user's, an assistant's.
Prefixes wait on an explicit stack, the most promising on top. A prefix is cut off if

- it is dominated: its node's table holds one of less (cost, audit). At one node equal costs never have audits of which one begins with the other (they
  differ in inserts only, which cost), so the order of prefixes is the order of whole audits;
- another state at the same row holds one that is cheaper even after the edits that make it as good (``EMULATE``);
- its cost and a lower bound of the rest exceed the incumbent, or equal it with a greater audit. The bound of a suffix is 4 for each row that
  must go, 3 for each truncated one, and 3 for each two adjoining pairs of whole rows whose initials don't follow each other (no single edit mends more than two).

When the stack is empty, the incumbent is proved optimal. Long conversations are searched in blocks of ``BLOCK`` rows, which pass on the best
prefix of each state; rows are let go as soon as all of them agree on their edits, so memory does not grow with a conversation's length, but for its audit.

Spark deals rows out by conversation, once; duplicates are flagged by a window on that same partitioning, and rows stream through in order. A
conversation is one task's stream, as the digest of its repaired text is a chain over all its rows: a very long one takes time, not memory.

Defined cases: a null role or text counts as one space, a null conversation is one of its own; null turns come first; rows of one
turn are taken in order of role and text (as they are given); an empty role has no initial and follows nothing; very long texts are hashed whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table

BLOCK = 32
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after writing an initial; pairs that are missing are not allowed.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: EMULATE[s][t]: with at most this cost more a prefix in state t can be continued as well as any in state s.
EMULATE = {
    NOTHING: {SYSTEM: 2 * INSERT, USER: DELETE + INSERT, ASSISTANT: DELETE},
    SYSTEM: {NOTHING: 0, USER: INSERT, ASSISTANT: 0},
    USER: {NOTHING: INSERT, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {NOTHING: 0, SYSTEM: 2 * INSERT, USER: INSERT},
}
#: Blank space of texts (fixed values): the space, and the control characters from tab to carriage return.
BLANK = " \x09\x0a\x0b\x0c\x0d"


class Row(NamedTuple):
    """A row as the search sees it."""

    role: str
    text: str
    gone: bool  # blank or a duplicate
    cut: bool  # truncated


class Label(NamedTuple):
    """A prefix: its cost, the audit since the rows that were let go, the state at the block's first row and the block's part of the audit."""

    cost: int
    audit: str
    entry: int
    edits: str


def suffix_bounds(rows: list[Row]) -> list[int]:
    """What the rows from each place on cost at least."""
    out, base, breaks, after = [0] * (len(rows) + 1), 0, 0, None
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        if row.gone:
            base += DELETE
        else:
            base += TRUNCATED * row.cut
            if after is not None and not row.cut and not after.cut and row.role[:1] + after.role[:1] not in ("su", "ua", "au"):
                breaks += 1
            after = row
        out[i] = base + 3 * ((breaks + 1) // 2)
    return out


def search(rows: list[Row], entries: dict[int, Label], last: bool) -> dict[int, Label]:
    """The best prefix of each state after ``rows``, from those before them; of the ``last`` block only the best whole one."""
    n, bounds = len(rows), suffix_bounds(rows)
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    ends: dict[int, Label] = {}
    incumbent: tuple[int, str] | None = None
    stack: list[tuple[int, int, Label]] = []

    def worse(i: int, state: int, key: tuple[int, str]) -> bool:
        here = best[i]
        if state in here and here[state] < key or incumbent is not None and (key[0] + bounds[i], key[1]) > incumbent:
            return True
        return any(t in here and here[t][0] + more < key[0] for t, more in EMULATE[state].items())

    def push(i: int, state: int, label: Label) -> None:
        key = label[:2]
        if best[i].get(state) != key and not worse(i, state, key):
            best[i][state] = key
            stack.append((i, state, label))

    for state, e in sorted(entries.items(), key=lambda x: x[1][:2], reverse=True):
        push(0, state, Label(e.cost, e.audit, state, ""))
    while stack:
        i, state, label = stack.pop()
        key = label[:2]
        if best[i][state] != key or worse(i, state, key):
            continue
        cost, audit, entry, edits = label
        if i == n:
            if not last:
                ends[state] = label
            elif state in (NOTHING, ASSISTANT) and (incumbent is None or key < incumbent):
                incumbent, ends = key, {state: label}
        moves = [(cost + INSERT, "I", i, ASSISTANT if state == USER else USER)]
        if i < n:
            row = rows[i]
            moves.append((cost + DELETE, "D", i + 1, state))
            if not row.gone:
                extra, own = TRUNCATED * row.cut, row.role[:1]
                if (state, own) in NEXT:
                    moves.append((cost + extra, "K", i + 1, NEXT[state, own]))
                target = ASSISTANT if state == USER else USER
                if row.role != ROLE[target]:
                    moves.append((cost + extra + RENAME, "R", i + 1, target))
        moves.sort(key=lambda m: (m[0] + bounds[m[2]], m[1]), reverse=True)
        for c, letter, j, to in moves:
            push(j, to, Label(c, audit + letter, entry, edits + letter))
    return {state: x for state, x in ends.items() if not worse(n, state, x[:2])}


def applied(rows: list[Row], edits: str, state: int) -> Iterator[tuple[str, str, str]]:
    """The turns ``(edit, role, text)`` that ``edits`` make of ``rows`` from ``state`` on."""
    i = 0
    for letter in edits:
        row = rows[i] if letter != "I" else None
        i += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state, row.role[:1]]
            yield letter, row.role, row.text
        else:
            state = ASSISTANT if state == USER else USER
            yield letter, ROLE[state], row.text if row else ""


class Repair:
    """The search over one conversation whose rows are added in order; repaired turns go to ``sink`` as they become certain."""

    def __init__(self, sink: Callable[[str, str, str], None], block: int = BLOCK):
        self.sink, self.block, self.rows = sink, block, []
        self.labels = {NOTHING: Label(0, "", NOTHING, "")}
        self.waiting: list[tuple[list[Row], dict[int, Label]]] = []
        self.settled: list[str] = []

    def add(self, row: Row) -> None:
        if len(self.rows) == self.block:
            self.search(False)
        self.rows.append(row)

    def search(self, last: bool) -> None:
        self.labels = search(self.rows, self.labels, last)
        self.waiting.append((self.rows, self.labels))
        self.rows = []
        # how far back do all prefixes agree?
        alive, k = set(self.labels), len(self.waiting)
        while k and len(alive) > 1:
            k -= 1
            alive = {self.waiting[k][1][s].entry for s in alive}
        if len(alive) == 1 and k:
            self.settle(k, alive.pop())

    def settle(self, k: int, state: int) -> None:
        """Let the first ``k`` blocks go, which end in ``state``."""
        path = []
        for rows, labels in reversed(self.waiting[:k]):
            path.append((rows, labels[state].edits, labels[state].entry))
            state = labels[state].entry
        done = "".join(edits for _, edits, _ in reversed(path))
        for rows, edits, entry in reversed(path):
            for turn in applied(rows, edits, entry):
                self.sink(*turn)
        self.settled.append(done)
        self.waiting = self.waiting[k:]
        self.labels = {s: x._replace(audit=x.audit[len(done) :]) for s, x in self.labels.items()}

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation."""
        self.search(True)
        (label,) = self.labels.values()
        return label.cost, "".join(self.settled)


class Summary:
    """Counts, repair and digest of one conversation; ``out`` gets its repaired turns if ``keep`` is set."""

    def __init__(self, block: int = BLOCK, keep: bool = False):
        self.keep = keep
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.digest, self.written = hashlib.sha256(), 0
        self.out: list[tuple[str, str, str]] = []
        self.repair = Repair(self.turn, block)

    def turn(self, edit: str, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written += 1
        if self.keep:
            self.out.append((edit, role, text))

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        ink = text.rstrip(BLANK)
        blank = not ink
        seen = seen and not blank
        cut = not blank and not seen and ink[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + seen, self.truncated + cut
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None:
            self.turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        self.repair.add(Row(role, text, blank or seen, cut))

    def row(self) -> tuple:
        cost, audit = self.repair.finish()
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` by conversation and in order, with ``__seen`` for those whose role and text were seen earlier in it."""
    same, first = Window.partitionBy("conv_id", "role", "text"), [F.col("turn").asc_nulls_first(), F.col("__role"), F.col("__text")]
    flagged = rows.repartition("conv_id").withColumn("__seen", F.when(F.col("__gone"), F.lit(False)).otherwise(F.row_number().over(same.orderBy("__gone", *first)) > 1))
    return flagged.sortWithinPartitions("conv_id", *first).select("conv_id", "turn", "role", "text", "__gone", "__seen").transform(bounded)


def prepared(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns that the search needs, under its own names."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), space(role).alias("__role"), space(text).alias("__text"), F.lit(False).alias("__gone"))


def conversations(batches: Iterator[pa.RecordBatch], block: int = BLOCK, keep: bool = False) -> Iterator[tuple[int | None, Summary, bool]]:
    """Each conversation of sorted batches with its key: at its end (True), and after every batch that ends inside it (False)."""
    now, key = None, None
    for batch in batches:
        for conv, turn, role, text, gone, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "__gone", "__seen"))):
            if now is None or conv != key:
                if now is not None:
                    yield key, now, True
                now, key = Summary(block, keep), conv
            if not gone:
                now.add(turn, role, text, seen)
        if now is not None:
            yield key, now, False
    if now is not None:
        yield key, now, True


def summaries(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a conversation of ``prepared`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        for key, summary, ended in conversations(batches, block):
            if not ended:
                continue
            found.append((key, *summary.row()))
            size += len(found[-1][7])
            if len(found) >= 1000 or size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), SUMMARY)], schema=SUMMARY)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), SUMMARY)], schema=SUMMARY)

    return ordered(rows).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def summarised(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one a conversation."""
    return summaries(prepared(df, key, turn, role, text))


def repaired(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired turns ``(conv_id, place, edit, role, text)``, numbered from 0 in each conversation; ``edit`` is K, R or I."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, summary, ended in conversations(batches, block, True):
            if ended:
                summary.row()
            if summary.out:
                edits, roles, texts = zip(*summary.out)
                n, summary.out = len(edits), []
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(summary.written - n, summary.written), pa.int64()), pa.array(edits), pa.array(roles), pa.array(texts)], schema=TURNS)

    return ordered(prepared(df, key, turn, role, text)).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def damaged(df: DataFrame) -> DataFrame:
    """``prepared`` rows, damaged by the checksum of ``conv_id:turn`` (mod 20): 0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's.

    Dropped rows stay as marks, so that no conversation is lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = prepared(df, "conv_id", "turn", "role", "text").withColumn("__kind", kind).withColumn("__gone", F.col("__kind") == 0)
    text = F.when(F.col("__kind").isin(0, 1), F.lit("")).when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("__kind") == 4, F.lit("user")).otherwise(F.col("role"))})
    return rows.withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__copy", "__kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return summaries(damaged(table(spark, sf_dir, "conversations")))
