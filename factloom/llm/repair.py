"""Repair of conversation structure by iterative-deepening A*.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``: nothing, or a system turn or none, then user and
assistant in turn. Rows are kept, given another role, deleted, and turns without text inserted; the cheapest way is looked for,
and of several the one whose string of edits is least in ASCII.

Rows are dealt by conversation and sorted; a task streams one conversation after the other. Of a conversation it holds a byte and a
digest for each row while it reads, and some numbers for each row while it searches, never the texts. The search goes through the edits in ASCII order under a bound on the cost, starts at the least cost
that the rows still ahead can be had for, and raises the bound to the least cost that went beyond it. States (row, grammar state)
from which a remaining budget didn't do are kept in a table and not tried again. Costs ahead come from one pass backwards over the
rows for the grammar's four states; they never overestimate, and long conversations need few nodes for it. A second stream applies
the edits to the texts.

Defined results: nulls in role or text count as one space, a null id is a conversation of its own, null turns come first and in no
gap; equal turns are ordered by role and text; a role that doesn't begin with s, u or a can't be kept; an empty table gives an empty
table; other columns are ignored. A conversation is by nature one sequence: a hot one is streamed in one task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant. The role that is next, and where it leads.
NEXT, AFTER = (b"u", b"u", b"a", b"u"), (2, 2, 3, 2)
ACCEPTS = (True, False, False, True)
#: A row in a byte: its initial, whether it must go, whether it is truncated.
INITIALS, MUST_GO, CUT_OFF = {"s": 1, "u": 2, "a": 3}, 4, 8
_TURNS = {2: "user", 3: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def kept(initial: int, state: int) -> int | None:
    """Grammar state after a row of this initial, or None."""
    if initial == 1:
        return 1 if state == 0 else None
    return AFTER[state] if initial == AFTER[state] else None


def ahead(rows: bytes) -> list[array]:
    """For each grammar state the least cost of the rows from a place on."""
    n = len(rows)
    out = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    after = [0, 6, 3, 0]
    for q in range(4):
        out[q][n] = after[q]
    for i in range(n - 1, -1, -1):
        row = rows[i]
        here = [DELETE + after[q] for q in range(4)]
        if not row & MUST_GO:
            more = TRUNCATED if row & CUT_OFF else 0
            for q in range(4):
                here[q] = min(here[q], REROLE + more + after[AFTER[q]])
                to = kept(row & 3, q)
                if to is not None:
                    here[q] = min(here[q], KEEP + more + after[to])
        for _ in range(2):  # a turn inserted, or two
            here = [min(here[q], INSERT + here[AFTER[q]]) for q in range(4)]
        for q in range(4):
            out[q][i] = here[q]
        after = here
    return out


def edits(row: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, rows it takes, next state, cost) for a row in a state, in ASCII order of the edits; 256 is the end."""
    out = [("D", 1, state, DELETE)] if row < 256 else []
    out.append(("I", 0, AFTER[state], INSERT))
    if row < 256 and not row & MUST_GO:
        more = TRUNCATED if row & CUT_OFF else 0
        to = kept(row & 3, state)
        if to is not None:
            out.append(("K", 1, to, KEEP + more))
        out.append(("R", 1, AFTER[state], REROLE + more))
    return tuple(out)


_EDITS = {(row, q): edits(row, q) for row in [*range(16), 256] for q in range(4)}


def search(rows: bytes, least: Callable[[int, int], int] | None = None) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair. ``least`` gives a cost ahead that is never too high."""
    if least is None:
        table = ahead(rows)
        least = lambda i, q: table[q][i]
    n, failed = len(rows), {}
    bound = least(0, 0)
    while True:
        beyond = None
        path: list[str] = []
        stack = [(0, 0, 0, iter(_EDITS[rows[0] if n else 256, 0]))]
        if n == 0:
            return 0, ""
        while stack:
            i, q, spent, options = stack[-1]
            if i == n and ACCEPTS[q]:
                return spent, "".join(path)
            for name, takes, to, cost in options:
                j, total = i + takes, spent + cost
                need = max(least(j, to), failed.get((j, to), -1) + 1)
                if total + need > bound:
                    beyond = total + need if beyond is None else min(beyond, total + need)
                    continue
                path.append(name)
                stack.append((j, to, total, iter(_EDITS[rows[j] if j < n else 256, to])))
                break
            else:
                failed[i, q] = max(failed.get((i, q), -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def streamed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows dealt by conversation, in order; ``__kind`` 0 comes first."""
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "__kind", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "__kind", *columns)


def conversations_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, iterator over its rows); what is left of one is skipped."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    held = next(rows, None)

    def own_rows(own: object) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == own:
            row, held = held, next(rows, None)
            yield row

    while held is not None:
        conv = held[0]
        stream = own_rows(conv)
        yield conv, stream
        for _ in stream:
            pass


def plain(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def audited(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id``, the faults found (``COUNTS``), and ``audit``: the edits of the cheapest repair. ``ids`` adds conversations without rows."""
    rows = plain(conversations).withColumn("__kind", F.lit(1))
    named = (ids if ids is not None else conversations).select("conv_id").distinct()
    every = rows.unionByName(named.select("conv_id", F.lit(0).alias("__kind")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, stream in conversations_in(batches):
            out.append((conv, *audit_of(r[2:] for r in stream if r[1])))
            if len(out) >= 500:
                yield packed(out)
                out = []
        yield packed(out)

    names = ["conv_id", *COUNTS, "audit"]

    def packed(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.string() if c == "audit" else pa.int64()) for i, c in enumerate(names)], names)

    return streamed(every, ["turn", "role", "text"]).withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def audit_of(stream: Iterator[tuple]) -> tuple:
    """Counts and edits of one conversation, from its (turn, role, text) in order."""
    codes, seen = bytearray(), set()
    low = high = before = None
    turns = blank = duplicate = truncated = illegal = 0
    last = None
    for turn, role, text in stream:
        if turn is not None:
            low = turn if low is None else low
            high = turn
            turns += turn != before
            before = turn
        code = INITIALS.get(role[:1], 0)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        end = text.rstrip(_SPACE)[-1:]
        if not end:
            blank, code = blank + 1, code | MUST_GO
        elif digest in seen:
            duplicate, code = duplicate + 1, code | MUST_GO
        elif end not in ".!?":
            truncated, code = truncated + 1, code | CUT_OFF
        seen.add(digest)
        illegal += last is not None and (last, role[:1]) not in (("s", "u"), ("u", "a"), ("a", "u"))
        last = role[:1]
        codes.append(code)
    cost, audit = search(bytes(codes))
    return 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, audit


def turns_of(audit: str, stream: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    state = 0
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            yield _TURNS[state], ""
            continue
        role, text = next(stream)
        if edit == "K":
            state = kept(INITIALS[role[:1]], state)
            yield role, text
        elif edit == "R":
            state = AFTER[state]
            yield _TURNS[state], text


def with_audits(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    rows = plain(conversations).withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("__kind", F.lit(1))
    return streamed(rows.unionByName(audits.withColumn("__kind", F.lit(0)), allowMissingColumns=True), ["role", "text", "audit", *COUNTS])


def repaired(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the conversations after their edits, turns numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, stream in conversations_in(batches):
            audit = next(stream)[4]
            for n, (role, text) in enumerate(turns_of(audit, (r[2:4] for r in stream)), 1):
                out.append((conv, n, role, text))
                if len(out) >= 500:
                    yield packed(out)
                    out = []
        yield packed(out)

    def packed(made: list[tuple]) -> pa.RecordBatch:
        kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(kinds.values())], list(kinds))

    return with_audits(conversations, audits).mapInArrow(run, "conv_id long, turn long, role string, text string")


def repair_digests(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The audits with ``repaired_sha256``: of the repaired ``role:text``, joined by newlines, worked out while they are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, stream in conversations_in(batches):
            first = next(stream)
            digest = hashlib.sha256()
            for n, (role, text) in enumerate(turns_of(first[4], (r[2:4] for r in stream))):
                digest.update(f"{'\n' if n else ''}{role}:{text}".encode())
            out.append((conv, *first[5:], first[4], digest.hexdigest()))
            if len(out) >= 500:
                yield packed(out)
                out = []
        yield packed(out)

    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def packed(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for i, c in enumerate(names)], names)

    rows = with_audits(conversations, audited(conversations, ids))
    return rows.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn: one of twenty each is dropped, emptied, cut off, repeated, given to the user."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = plain(conversations).withColumn("__fault", fault).where("__fault <> 0")
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("__fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("__time", F.explode(times)).select("conv_id", "turn", F.when(F.col("__fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
