"""Conversations repaired at least cost: rows kept, given another role, deleted or inserted until the roles alternate.

The edits of a conversation are paths through a lattice of (rows passed, role said last). An auction finds a
shortest one: the path from the origin is extended along arcs that the node prices allow and contracted where a
price is too low. The prices it ends with make every arc of every shortest path tight, and of the paths of
tight arcs the one with the least audit text is followed. Long conversations are solved in blocks of rows from
their end; the prices at a block's start are the costs at the end of the block before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.columns import batch

# Rows of one lattice, and lattices that a worker process remembers.
BLOCK, MOST_KEPT = 16, 50_000
# White space, and the costs of the edits.
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# What was said last: nothing, s, u or a; and what may follow.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
INITIALS = "sua"
ROLES = {2: "user", 3: "assistant"}
FINE, CUT, LOST = 0, 4, 8


def code_of(initial: str, fault: int) -> int:
    """A row as one small number: what role it has, and whether it is fine, truncated or must go."""
    return fault + (INITIALS.index(initial) if initial and initial in INITIALS else 3)


def _next_said(state: int) -> int:
    """The state behind a row whose role an edit may choose: user or assistant, whichever may follow."""
    return 3 if state == 2 else 2


def _lattice(codes: bytes, after: tuple[int, ...] | None) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, node) of every node; node 4 * i + q has passed i rows and state q, the last one is the target.

    ``after``: cost from each state at the block's end on; without it the conversation ends here.
    """
    target = 4 * len(codes) + 4
    arcs: list[list[tuple[str, int, int]]] = []
    for i in range(len(codes) + 1):
        for q in range(4):
            own = []
            if i == len(codes) and after is not None:
                arcs.append([("", after[q], target)])
                continue
            if i < len(codes):
                initial, fault = codes[i] & 3, codes[i] & 12
                own.append(("D", DELETE, 4 * i + 4 + q))
                if fault != LOST:
                    extra = TRUNCATED if fault == CUT else 0
                    to = STEPS[q].get(INITIALS[initial]) if initial < 3 else None
                    if to is not None:
                        own.append(("K", KEEP + extra, 4 * i + 4 + to))
                    own.append(("R", REROLE + extra, 4 * i + 4 + _next_said(q)))
            elif q in ENDS:
                own.append(("", 0, target))
            own.append(("I", INSERT, 4 * i + _next_said(q)))
            arcs.append(own)
    return arcs


def _auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> None:
    """Raise prices until a path of tight arcs leads from the origin to the target.

    No price may exceed an arc's cost and the price behind it; every cycle must cost something.
    """
    path = [origin]
    while path[-1] < len(arcs):
        node = path[-1]
        least, to = min((cost + prices[j], j) for _, cost, j in arcs[node])
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


@lru_cache(MOST_KEPT)
def solve_block(codes: bytes, after: tuple[int, ...] | None) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """From each state before the rows: the least cost, and the least audit of that cost with the state it ends in."""
    arcs = _lattice(codes, after)
    prices = [0] * (len(arcs) + 1)
    for q in range(4):
        _auction(arcs, prices, q)
    # A tight arc lies on a shortest path where the target can be reached from its end by tight arcs.
    follow: dict[int, tuple[str, int]] = {len(arcs): ("", len(arcs))}
    for i in range(len(codes), -1, -1):
        for node in sorted(range(4 * i, 4 * i + 4), key=prices.__getitem__):
            tight = [(edit, j) for edit, cost, j in arcs[node] if prices[node] == cost + prices[j] and j in follow]
            if tight:
                follow[node] = min(tight)
    traces = []
    for q in range(4):
        audit, node = [], q
        while True:
            edit, to = follow[node]
            if to == len(arcs):
                traces.append(("".join(audit), node % 4))
                break
            audit.append(edit)
            node = to
    return tuple(prices[:4]), tuple(traces)


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost of a conversation's rows, and the least audit of that cost."""
    blocks, after, base = [], None, 0
    cuts = range(0, max(len(codes), 1), BLOCK)
    for at in reversed(cuts):
        costs, traces = solve_block(bytes(codes[at:at + BLOCK]), after)
        blocks.append(traces)
        least = min(costs)
        base += least
        after = tuple(c - least for c in costs)
    state, audit = 0, []
    for traces in reversed(blocks):
        part, state = traces[state]
        audit.append(part)
    return base + after[0], "".join(audit)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with faults by crc32 of "conv_id:turn" modulo 20 (a null is one space in that text).

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Other columns are left out.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    own = _filled(turns).withColumn("f", F.crc32(key.cast("binary")) % 20).where("f <> 0")
    return own.select(
        "conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _filled(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
    )


ORDER = ["conv_id", "kind", "turn", "role", "digest"]
AUDITED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def _told(turns: DataFrame) -> DataFrame:
    """Rows with a digest of their text and what SQL can say of them: blank, without a sentence end, role and text said at an earlier turn."""
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    own = _filled(turns).withColumns({
        "digest": F.md5(F.col("text").cast("binary")), "blank": core == "",
        "cut": ~F.substring(core, -1, 1).isin(".", "!", "?"), "kind": F.lit(1),
    })
    # Combined on the map side, so a text that fills a conversation meets as one row.
    first = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(*(F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "digest")), "first")
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("conv_id", "role", "digest")]
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return own.join(first, same[0] & same[1] & same[2]).withColumn("again", again).drop("first", *(f"first_{c}" for c in ("conv_id", "role", "digest")))


class _Audit:
    """One conversation as its rows pass: counts, and one byte a row for the lattice."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = self.said = None

    def add(self, turn: int | None, role: str, digest: str, blank: bool, cut: bool, again: bool) -> None:
        row = turn, role, digest
        duplicate = not blank and (again or row == self.before)
        fault = LOST if blank or duplicate else CUT if cut else FINE
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += fault == CUT
        self.codes.append(code_of(role[:1], fault))
        if self.before is not None:
            self.illegal += self.said + role[:1] not in ("su", "ua", "au")
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.before, self.said = row, role[:1]

    def end(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *solve(bytes(self.codes))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, own, out = None, None, []
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "digest", "blank", "cut", "again"))
        for conv, kind, *row in zip(*columns):
            if own is None or conv != key:
                if own is not None:
                    out.append((key, *own.end()))
                key, own = conv, _Audit()
            if kind:
                own.add(*row)
        if len(out) > 1000:
            yield batch(list(zip(*out)), AUDITED)
            out = []
    if own is not None:
        out.append((key, *own.end()))
    if out:
        yield batch(list(zip(*out)), AUDITED)


def audit_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Of every conversation (also those of ``ids`` without rows): counts of faults, least cost, and the audit of its edits.

    Rows are taken by turn, nulls first, then by role and a digest of the text. A row is blank (no character but white
    space), else a duplicate (role and text of an earlier row; equal rows of one turn too), else truncated (ends in none of
    . ! ?). K keeps a row, R makes it the user's or assistant's, D deletes it, as blank rows and duplicates must be, I inserts an empty one. Roles
    count by their first character; a null role or text is one space; rows without a conv_id are one conversation, and
    one without rows has zeros and an empty audit. An empty table gives none, other columns are ignored. Of a conversation one byte a row is held.
    """
    told = _told(turns).select(*ORDER, "blank", "cut", "again")
    marks = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    marks = marks.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(told.schema[c].dataType).alias(c) for c in told.columns[2:]))
    return told.unionByName(marks).repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_audits, AUDITED)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edit, turn, role, text) of every edit, and (its row of ``AUDITED``, None, ...) before them."""
    audit, at, state, key = "", 0, 0, None

    def inserted(state: int) -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            state = _next_said(state)
            yield state, (key, "I", None, ROLES[state], "")

    for b in batches:
        names = [x.split()[0] for x in AUDITED.split(", ")]
        heads = list(zip(*(b.column(c).to_pylist() for c in names)))
        for head, kind, turn, role, text in zip(heads, *(b.column(c).to_pylist() for c in ("kind", "turn", "role", "text"))):
            if not kind:
                for _, row in inserted(state):
                    yield row
                audit, at, state, key = head[-1], 0, 0, head[0]
                yield head, None, None, None, None
                continue
            for state, row in inserted(state):
                yield row
            edit = audit[at]
            at += 1
            if edit == "K":
                state = STEPS[state][role[0]]
            elif edit == "R":
                state = _next_said(state)
                role = ROLES[state]
            yield key, edit, turn, role, text
    for _, row in inserted(state):
        yield row


def _with_audits(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of every conversation in order behind the row that holds its audit."""
    rows = _filled(turns).withColumns({"kind": F.lit(1), "digest": F.md5(F.col("text").cast("binary"))})
    heads = audit_conversations(turns, ids).withColumn("kind", F.lit(0))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Every edit as a row: conv_id, place, edit, turn, role and text as they are after it; a deleted row keeps its own.

    Without the rows whose edit is D, role and text by place are the repaired conversations; see ``audit_conversations``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for key, edit, turn, role, text in _replay(batches):
            if edit is None:
                place = 0
                continue
            out.append((key, place, edit, turn, role, text))
            place += 1
            if len(out) > 1000:
                yield batch(list(zip(*out)), REPAIRED)
                out = []
        if out:
            yield batch(list(zip(*out)), REPAIRED)

    return _with_audits(turns, None).mapInArrow(run, REPAIRED)


DIGEST = f"{AUDITED}, repaired_sha256 string"


def repair_digest(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The audit of every conversation, and the digest of its repaired rows (role:text, joined by newlines)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, sha, begun = [], None, None, False
        for key, edit, _, role, text in _replay(batches):
            if edit is None:
                if head:
                    out.append((*head, sha.hexdigest()))
                head, sha, begun = key, hashlib.sha256(), False
            elif edit != "D":
                sha.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True
            if len(out) > 1000:
                yield batch(list(zip(*out)), DIGEST)
                out = []
        if head:
            out.append((*head, sha.hexdigest()))
        if out:
            yield batch(list(zip(*out)), DIGEST)

    return _with_audits(turns, ids).mapInArrow(run, DIGEST)
