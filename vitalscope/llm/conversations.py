"""Conversation structure repair with Four-Russians block tables.

A conversation is a string of symbols, one per row: the role's initial (s, u, a or
another), whether its text is cut off, or that the row must go (blank or a copy of an
earlier row). The cheapest edits that give role initials ``(s?(ua)+)?`` are a walk over
four states; what a row does to the vector of costs still to pay depends on its symbol
and, up to a constant, on a small set of normalised vectors. All of these vectors are found
first; a table then holds, for every vector and every block of BLOCK symbols, the vector
before the block and the constant. Conversations are worked through from their end by one
lookup per block. For the edits, a block is expanded backward from the vector at its
end and walked forward, taking the ASCII-least edit that still leads to the least cost.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty row of user or
assistant 3; a cut-off row that stays adds 3.

On Spark: rows are range-partitioned by conversation and turn, so a long conversation
spreads over many tasks. A conversation that lies inside one partition is finished there;
the first and last of a partition, and those beyond SEGMENT_ROWS or SEGMENT_BYTES, go on as
segments: each segment's block lookups start from every state at once and give a
4 x 4 table of costs, these are folded per conversation, and a last pass walks the
segments with the right vector at each one's end. That pass reads a conversation's rows in order
through one task in bounded memory, since SHA-256 is sequential; everything before it is spread.

Defined cases: a null in role or text counts as one space, a null turn sorts first and is left
out of ``gaps``, a null conv_id is a conversation of its own; rows with the same turn are
taken by role and text, in byte order; repeated rows are duplicates; a conversation
without rows has zeros, an empty audit and the digest of the empty string; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalscope.operators.skew import lookup_join

from .common import stored

BLOCK = 4  # symbols of a block
SEGMENT_ROWS, SEGMENT_BYTES = 50_000, 1 << 25
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 20  # no way
START, SYSTEM, USER, ASSISTANT = range(4)
NAME = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)  # what a new or renamed row must be after each state
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by initial: s, u, a, another
INITIAL = {"s": 0, "u": 1, "a": 2}
SYMBOLS, GONE = 9, 8  # initial, initial + 4 where the text is cut off, GONE
END = (0, 2 * INSERT, INSERT, 0)
SPACES = " \t\n\x0b\x0c\r"
RESULT = (
    "known boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string, repaired string"
)
ROWS = "known boolean, conv long, turn long, role string, text string, m long"


def _before(after: tuple, symbol: int) -> list[int]:
    """Costs from each state in front of a row, by the costs behind it."""
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if symbol != GONE:
            extra = CUT_OFF if symbol >= 4 else 0
            best = min(best, REROLE + extra + after[NEXT[state]])
            if state in KEPT[symbol % 4]:
                best = min(best, extra + after[KEPT[symbol % 4][state]])
        out.append(best)
    for _ in range(3):
        out = [min(out[s], INSERT + out[NEXT[s]]) for s in range(4)]
    return out


def _normal(costs) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


class Tables:
    """All normalised vectors, what a symbol and what a block does to each, and the edits of a step."""

    def __init__(self) -> None:
        units = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
        self.number = {v: i for i, v in enumerate([END, *units])}
        self.vectors = list(self.number)
        to, add = [], []
        for vector in self.vectors:  # grows while new vectors turn up
            row = [_normal(_before(vector, symbol)) for symbol in range(SYMBOLS)]
            for found, _ in row:
                if found not in self.number:
                    self.number[found] = len(self.vectors)
                    self.vectors.append(found)
            to.append([self.number[found] for found, _ in row])
            add.append([least for _, least in row])
        self.one, self.one_add = np.array(to), np.array(add)
        self.block, self.block_add = self.one, self.one_add
        for _ in range(BLOCK - 1):  # one more symbol in front
            to, add = self.one[self.block], self.one_add[self.block] + self.block_add[:, :, None]
            self.block, self.block_add = (x.transpose(0, 2, 1).reshape(len(self.vectors), -1) for x in (to, add))
        self.steps: dict[tuple, tuple[str, int]] = {}

    def boundaries(self, symbols: np.ndarray, end: int) -> tuple[list[int], int, int]:
        """(vector at the end of every block from the last to the first, vector before the first, constant)."""
        head = len(symbols) % BLOCK
        powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        codes = symbols[head:].reshape(-1, BLOCK) @ powers
        at, total, ends = end, 0, []
        for code in codes[::-1].tolist():
            ends.append(at)
            total += self.block_add[at, code]
            at = self.block[at, code]
        for symbol in symbols[:head][::-1].tolist():
            total += self.one_add[at, symbol]
            at = self.one[at, symbol]
        return ends, int(at), int(total)

    def step(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The edits up to and with a row, and the state behind it: the ASCII-least of the cheapest."""
        found = self.steps.get((after, symbol, state))
        if found is None:
            behind = self.vectors[after]
            front = _before(behind, symbol)
            edits, at = "", state
            extra = CUT_OFF if 4 <= symbol < GONE else 0
            while True:
                if front[at] == DELETE + behind[at]:
                    found = edits + "D", at
                elif front[at] == INSERT + front[NEXT[at]]:
                    edits, at = edits + "I", NEXT[at]
                    continue
                elif at in KEPT[symbol % 4] and front[at] == extra + behind[KEPT[symbol % 4][at]]:
                    found = edits + "K", KEPT[symbol % 4][at]
                else:
                    found = edits + "R", NEXT[at]
                break
            self.steps[after, symbol, state] = found
        return found

    def edits(self, symbols: np.ndarray, end: int, state: int) -> tuple[list[str], int]:
        """The edits up to and with each row of a segment, and the state behind it."""
        ends, _, _ = self.boundaries(symbols, end)
        head, out = len(symbols) % BLOCK, []
        starts = list(range(head, len(symbols), BLOCK))
        if head:
            starts, ends = [0, *starts], [*ends, self.boundaries(symbols[head:], end)[1]]
        for start, after in zip(starts, reversed(ends)):
            block = symbols[start:head if start < head else start + BLOCK].tolist()
            inner = [after]
            for symbol in reversed(block[1:]):
                inner.append(int(self.one[inner[-1], symbol]))
            for symbol, behind in zip(block, reversed(inner)):
                edit, state = self.step(int(behind), symbol, state)
                out.append(edit)
        return out, state


def tables(_kept: list = []) -> Tables:
    """The tables of a task; the driver never asks for them, so they do not travel."""
    if not _kept:
        _kept.append(Tables())
    return _kept[0]


def symbol_of(role: str, text: str, seen: bool) -> tuple[int, str]:
    """(symbol, first fault: blank, duplicate, truncated or nothing) of a row."""
    bare = text.rstrip(SPACES)
    if not bare:
        return GONE, "blank"
    if seen:
        return GONE, "duplicate"
    cut = bare[-1] not in ".!?"
    return INITIAL.get(role[:1], 3) + 4 * cut, "truncated" if cut else ""


class Conversation:
    """One conversation as its segments come in, each with the vector at its end."""

    def __init__(self, known: bool, conv: int, texts: bool) -> None:
        self.key, self.state, self.digest, self.begun = (known, conv), START, hashlib.sha256(), False
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.distinct = 0
        self.before, self.low, self.high, self.audit = None, None, None, []
        self.lines = [] if texts else None

    def line(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update(("\n" if self.begun else "").encode() + line.encode())
        self.begun = True
        if self.lines is not None:
            self.lines.append(line)

    def inserted(self, edits: str) -> None:
        for _ in edits:
            self.state = NEXT[self.state]
            self.cost += INSERT
            self.line(NAME[self.state], "")

    def segment(self, rows: list, end: int) -> None:
        """Rows (turn, role, text, times, seen before), ``end`` the number of the vector behind them."""
        symbols, owner = [], []
        for i, (turn, role, text, m, seen) in enumerate(rows):
            if not m:
                continue
            symbol, fault = symbol_of(role, text, seen)
            symbols += [symbol] + [GONE] * (m - 1)
            owner += [i] * m
            if fault:
                self.faults[fault] += 1
            self.faults["blank" if fault == "blank" else "duplicate"] += m - 1
            initial = role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.illegal += m - 1  # a role never follows itself
            self.before = initial
            if turn is not None:
                self.distinct += turn != self.high
                self.low = turn if self.low is None else self.low
                self.high = turn
        edits, _ = tables().edits(np.array(symbols, np.int64), end, self.state)
        self.audit += edits
        for edit, symbol, i in zip(edits, symbols, owner):
            self.inserted(edit[:-1])
            _, role, text, _, _ = rows[i]
            if edit[-1] == "D":
                self.cost += DELETE
                continue
            self.cost += CUT_OFF if symbol >= 4 else 0
            if edit[-1] == "R":
                self.state = NEXT[self.state]
                self.cost += REROLE
                role = NAME[self.state]
            else:
                self.state = KEPT[symbol % 4][self.state]
            self.line(role, text)

    def result(self) -> tuple:
        last = "I" * (END[self.state] // INSERT)
        self.inserted(last)
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        text = None if self.lines is None else "\n".join(self.lines)
        return (*self.key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit) + last, self.digest.hexdigest(), text)


def merged(batches):
    """Equal rows of a batch as one with their number, so that a row repeated very often stays few rows."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from table.group_by(table.column_names[:-1]).aggregate([("m", "sum")]).rename_columns(table.column_names).to_batches()


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _inside(texts: bool):
    """Results of the conversations inside a partition; the rows of its first, its last and of long ones as segments.

    Columns: the result's, then part, seg, pos, turn, role, text, m of a row.
    """
    nothing, blank = (None,) * 9, (None,) * 7

    def run(batches):
        from pyspark import TaskContext

        part, out, size = TaskContext.get().partitionId(), [], 0
        key, rows, seen, large = None, [], set(), True  # the first is never known to be whole
        seg = pos = held = 0

        def passed_on():
            nonlocal seg, pos
            for row in rows:
                yield (*key, *nothing, part, seg, pos, *row[:4])
                pos += 1
            seg += 1

        def batch_of(ready):
            columns = list(zip(*ready))
            types = [pa.bool_(), *[pa.int64()] * 7, *[pa.string()] * 3, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], OUT)

        for known, conv, turn, role, text, m in _rows(batches):
            if (known, conv) != key:
                if key is not None:
                    if large:
                        out += passed_on()
                    else:
                        one = Conversation(*key, texts)
                        one.segment(rows, 0)
                        out.append((*one.result(), *blank))
                    large = False
                key, rows, seen, held = (known, conv), [], set(), 0
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()
            rows.append((turn, role, text, m, mark in seen))
            if m:
                seen.add(mark)
            held += len(text) + 16
            if len(rows) >= SEGMENT_ROWS or held >= SEGMENT_BYTES:
                large = True
                out += passed_on()
                rows, seen, held = [], set(), 0
            size += len(text)
            if len(out) >= 5_000 or size >= SEGMENT_BYTES:
                if out:
                    yield batch_of(out)
                out, size = [], 0
        if key is not None:
            out += passed_on()
        if out:
            yield batch_of(out)
    return run


OUT = [f.split()[0] for f in RESULT.split(", ")] + ["part", "seg", "pos", "turn", "role", "text", "m"]
INSIDE = f"{RESULT}, part long, seg long, pos long, turn long, role string, text string, m long"


def _costs(frame: pd.DataFrame) -> pd.DataFrame:
    """A segment's costs from each state in front to each state behind it."""
    frame, symbols = frame.sort_values("pos"), []
    for role, text, m, seen in zip(frame["role"], frame["text"], frame["m"], frame["seen"]):
        if m:
            symbols += [symbol_of(role, text, bool(seen))[0]] + [GONE] * (int(m) - 1)
    symbols, t = np.array(symbols, np.int64), tables()
    matrix = []
    for behind in range(4):
        _, at, total = t.boundaries(symbols, t.number[tuple(0 if s == behind else FAR for s in range(4))])
        matrix += [c + total if c < FAR else FAR for c in t.vectors[at]]
    return frame.iloc[:1][["known", "conv", "part", "seg"]].assign(costs=[matrix])


def _folded(frame: pd.DataFrame) -> pd.DataFrame:
    """The vector at the end of every segment of a conversation."""
    frame = frame.sort_values(["part", "seg"], ascending=False)
    vector, ends = END, []
    for costs in frame["costs"]:
        ends.append(tables().number[vector])
        matrix = np.array(costs).reshape(4, 4) + np.array(vector)[:, None]
        vector, _ = _normal([int(c) for c in matrix.min(0)])
    return frame[["known", "conv", "part", "seg"]].assign(end=ends)


def _walked(texts: bool):
    """Conversations of several segments, their rows in order."""
    def run(batches):
        one, rows, at, size = None, [], None, 0
        columns = [f.split() for f in RESULT.split(", ")]
        types = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}

        def ready(result):
            return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(result, columns)], [n for n, _ in columns])

        for known, conv, part, seg, end, turn, role, text, m, seen in _rows(batches):
            if at != (known, conv, part, seg):
                if rows:
                    one.segment(rows, behind)
                if at is None or at[:2] != (known, conv):
                    if one is not None:
                        yield ready(one.result())
                    one = Conversation(known, conv, texts)
                at, rows, behind = (known, conv, part, seg), [], end
            rows.append((turn, role, text, m, seen))
        if one is not None:
            one.segment(rows, behind)
            yield ready(one.result())
    return run


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults by the checksum of ``conv_id:turn``, and ``times`` each one counts.

    Of 20 classes, 0 drops the row (0 times), 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 makes
    it a user's.
    """
    mark = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(mark) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None,
    texts: bool = False,
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``times`` names a column of how often a row counts (0: it only names its conversation).
    ``texts`` adds the repaired rows as ``repaired``, lines of ``role:text``.
    """
    own = lambda c, t: F.col(f"`{c}`").cast(t)
    space = F.lit(" ")
    count = own(times, "long") if times else F.lit(1).cast("long")
    slim = rows.select(
        own(conv, "long").isNotNull().alias("known"), F.coalesce(own(conv, "long"), F.lit(0)).alias("conv"), own(turn, "long").alias("turn"),
        F.when(count > 0, F.coalesce(own(role, "string"), space)).otherwise("").alias("role"),
        F.when(count > 0, F.coalesce(own(text, "string"), space)).otherwise("").alias("text"), count.alias("m"),
    )
    order = ["known", "conv", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = slim.mapInArrow(merged, ROWS).repartitionByRange(*order).sortWithinPartitions(*order)
    first = stored(placed.mapInArrow(_inside(texts), INSIDE))
    names = [f.split()[0] for f in RESULT.split(", ")]
    whole = first.filter("part is null").select(*names)

    cut = first.filter("part is not null").select("known", "conv", "part", "seg", "pos", "turn", "role", "text", "m")
    cut = cut.withColumn("mark", F.md5(F.concat_ws(":", F.col("known").cast("string"), F.col("conv").cast("string"), F.length("role").cast("string"), "role", "text")))
    early = cut.filter("m > 0").groupBy("mark").agg(F.min(F.struct("part", "pos")).alias("early"), F.count("*").alias("n")).filter("n > 1")
    marked = stored(lookup_join(cut, early.select("mark", "early"), "mark").withColumn(
        "seen", F.coalesce(F.struct("part", "pos") > F.col("early"), F.lit(False))).drop("mark", "early"))
    key = ["known", "conv", "part", "seg"]
    costs = marked.groupBy(*key).applyInPandas(_costs, "known boolean, conv long, part long, seg long, costs array<long>")
    ends = stored(costs.groupBy("known", "conv").applyInPandas(_folded, "known boolean, conv long, part long, seg long, end long"))
    # One row per segment: at most two a partition besides those of long conversations.
    joined = marked.withColumn("at", F.xxhash64(*key))
    other = ends.select(F.xxhash64(*key).alias("at"), *[F.col(c).alias(f"_{c}") for c in key], "end")
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    joined = lookup_join(joined, other, "at", "inner").filter(same[0] & same[1] & same[2] & same[3])
    ordered = joined.select(*key, "end", "turn", "role", "text", "m", "seen", "pos").repartition("known", "conv")
    ordered = ordered.sortWithinPartitions("known", "conv", "part", "pos").drop("pos")
    walked = ordered.mapInArrow(_walked(texts), RESULT)
    out = whole.unionByName(walked)
    shown = [F.when(F.col("known"), F.col("conv")).alias("conv_id"), *names[2:10], *(["repaired"] if texts else [])]
    return out.select(*shown)
