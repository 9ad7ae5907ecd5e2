"""Repair of conversations by A* on the lattice of edits.

A node is (rows read, role last written); from it a row is kept, given another role or
deleted, or an empty turn is inserted. Written roles must spell ``(s?(ua)+)?`` by their
initials. The search is ordered by (cost plus heuristic, audit): the heuristic sums, over the
rows still to come, the deletions that must be made and the charge that no edit of a
truncated row avoids. It is consistent, an audit names one path, and a prefix sorts before what continues
it, so the first audit to reach the end is the cheapest and, of equals, the least.

Rows of a conversation are read as a stream, ``WINDOW`` at a time: the search hands on, for each role last
written, the best audit so far, so a conversation of any length is searched exactly with one window of codes in
memory. Texts take no part: they are read once more in order, behind the finished audit, and written on as
they come. A conversation is one task's stream, since its result is one sequence; nothing else is.

Defined results: a null role or text counts as one blank. A role that starts with none of s, u, a (also an
empty one) cannot be kept. Rows go by turn (null first), then role, then the text's md5; rows with equal text
md5 count as equal. A null ``conv_id`` is a conversation of its own. Repeated rows are duplicates.
"""

from __future__ import annotations

import hashlib
import heapq
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

# Costs of edits, and what they must leave.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL_PAIRS = ["su", "ua", "au"]
BLANKS = " \t\n\x0b\f\r"
#: Rows searched at once.
WINDOW = 4096
#: Role last written: none, s, u, a. What may be kept next, and what relabelling or inserting writes.
KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
WRITTEN = [2, 2, 3, 2]
NAMES = {2: "user", 3: "assistant"}
PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
EDITS = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"


def search(rows: list[tuple[str, str]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) for each role last written after ``rows``; after the last rows only the best of all.

    ``rows`` are pairs of a role's initial and a fault (``blank``, ``duplicate``, ``truncated`` or nothing).
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        ahead[i] = ahead[i + 1] + (DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault == "truncated" else 0)
    heap = [(cost + ahead[0], audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(heap)
    closed, out = set(), {}
    while heap:
        total, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = total - ahead[i]
        if i == n:
            if not last:
                out[state] = cost, audit
                if len(out) == len(KEPT):
                    break
            elif state in (0, 3):
                return {state: (cost, audit)}
        heapq.heappush(heap, (total + INSERT, audit + "I", i, WRITTEN[state]))
        if i < n:
            initial, fault = rows[i]
            base = cost + ahead[i + 1]
            heapq.heappush(heap, (base + DELETE, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                base += TRUNCATED if fault == "truncated" else 0
                if (after := KEPT[state].get(initial)) is not None:
                    heapq.heappush(heap, (base, audit + "K", i + 1, after))
                heapq.heappush(heap, (base + RELABEL, audit + "R", i + 1, WRITTEN[state]))
    return out


class _Plan:
    """What is known of one conversation while its rows stream by."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.turns, self.low, self.high, self.seen = 0, None, None, None
        self.rows, self.done, self.starts = [], [], {0: (0, "")}

    def add(self, turn, initial, fault):
        if turn is not None and turn != self.seen:
            self.turns, self.seen, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL_PAIRS
        self.before = initial
        self.rows.append((initial, fault))
        if len(self.rows) == WINDOW:
            self.starts = search(self.rows, self.starts, last=False)
            same = os.path.commonprefix([audit for _, audit in self.starts.values()])
            self.done.append(same)
            self.starts = {k: (cost, audit[len(same) :]) for k, (cost, audit) in self.starts.items()}
            self.rows = []

    def result(self):
        ((cost, audit),) = search(self.rows, self.starts, last=True).values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, cost, "".join([*self.done, audit]))


def _columns(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )


ORDER = [F.asc_nulls_first, F.asc, F.asc]


def _ordered(*names):
    return [order(name) for order, name in zip(ORDER, names, strict=True)]


def plan(turns: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, and the cheapest edits with their cost."""
    small_batches(turns.sparkSession)
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    rows = _columns(turns).withColumn("last", last).drop("text").repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("last") == "", "blank").when(nth > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault).sortWithinPartitions("conv_id", *_ordered("turn", "role", "digest"))

    def read(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for conv, turn, role, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.result()))
                    now, state = conv, _Plan()
                state.add(turn, role, kind)
            if out:
                yield _batch(out, PLAN)
        if state is not None:
            yield _batch([(now, *state.result())], PLAN)

    return rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("role"), "fault").mapInArrow(read, PLAN)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def repair(turns: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Every edit in order (``K``, ``R``, ``D`` or ``I``) with the turn it leaves; a deleted turn stands as it was.

    ``plans`` are those of ``plan(turns)``. A conversation's rows lie together, in order, in one partition.
    """
    small_batches(turns.sparkSession)
    plans = plan(turns) if plans is None else plans
    none = {"turn": "long", "role": "string", "text": "string", "digest": "binary"}
    heads = plans.select("conv_id", F.lit(0).alias("part"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()), "audit")
    rows = _columns(turns).select("conv_id", F.lit(1).alias("part"), *none, F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ordered("turn", "role", "digest"))

    def read(batches):
        now = audit = None
        at = position = state = 0

        def inserts():
            nonlocal at, position, state
            while at < len(audit) and audit[at] == "I":
                state = WRITTEN[state]
                yield now, position, "I", None, NAMES[state], ""
                at, position = at + 1, position + 1

        for batch in batches:
            out = []
            for conv, part, turn, role, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if audit is not None:
                        out += inserts()
                    now, audit, at, position, state = conv, edits, 0, 0, 0
                    continue
                out += inserts()
                edit = audit[at]
                if edit == "K":
                    state = KEPT[state][role[:1]]
                elif edit == "R":
                    state = WRITTEN[state]
                    role = NAMES[state]
                out.append((conv, position, edit, turn, role, text))
                at, position = at + 1, position + 1
            if out:
                yield _batch(out, EDITS)
        if audit is not None and (out := list(inserts())):
            yield _batch(out, EDITS)

    return both.drop("digest").mapInArrow(read, EDITS)


def digests(edits: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired turns, ``role:text`` joined by newlines; reads ``repair``'s stream."""

    def read(batches):
        now, digest, first = None, None, True
        for batch in batches:
            out = []
            for conv, position, edit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, first = conv, hashlib.sha256(), True
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if out:
                yield _batch(out, "conv_id bigint, repaired_sha256 string")
        if digest is not None:
            yield _batch([(now, digest.hexdigest())], "conv_id bigint, repaired_sha256 string")

    return edits.select("conv_id", "position", "edit", "role", "text").mapInArrow(read, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by the crc32 of ``conv_id:turn``, modulo 20; nulls read as one blank."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, copies)"))).drop("col")


def report(conversations: DataFrame) -> DataFrame:
    """Every original conversation after planted damage: its faults, edits and the digest of what they leave."""
    turns = damaged(conversations)
    plans = plan(turns)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(plans, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    hashed = digests(repair(turns, plans))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.join(hashed, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
