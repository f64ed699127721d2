"""Conversations repaired by the cheapest edits that give them a legal order of roles.

A conversation of n rows is a lattice of n + 1 layers with four states each: at
the start, and after a system, user or assistant turn. Edits are its edges: keep
and rerole go to the next layer and state, delete to the next layer, insert to
the next state. Dijkstra's search runs from both ends; its heaps meet, all
crossings as cheap as the best are finished, and of these the least concatenated
audit is picked. At one place equally dear audits of one side are never
beginnings of each other, so each side keeps its least one only.

Rows are range-sorted by conversation and turn and searched in chunks of a
bounded number of rows. A conversation that lies within a chunk is solved there.
One that spans chunks, however many rows it has, gets the cheapest edits between all pairs
of states for each chunk, which are then joined chunk by chunk. Texts aren't
needed for that: only a second pass, in which they stream by once, hashes the
repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.batches import columns, slices
from spokeworks.operators.staging import stage

CHUNK = 1024  # rows that are searched at once
REROLE, DELETE, KEEP_TRUNCATED, INSERT = 1, 2, 5, 5
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)  # first fault of a row; a code is 4 * initial + fault
OTHER, S, U, A = range(4)  # initials of roles; state 0 is the start, the others are those after an initial
NEXT = (U, U, A, U)  # the state after a user or assistant turn, whichever may follow a state
BEFORE = ((), (), (0, S, A), (U,))  # the states that NEXT leads from
LEGAL = ((S, U), (U, A), (A, U))
GOALS = (0, A)

_WHITE = r"[\x20\x09-\x0D]"
_LONGEST = (1 << 63) - 1


def _kept(initial: int, state: int) -> int:
    """The state after a row that is kept, or -1."""
    if initial == S:
        return S if state == 0 else -1
    return initial if initial and NEXT[state] == initial else -1


_KEPT = tuple(tuple(_kept(x, s) for s in range(4)) for x in range(4))
_KEPT_BEFORE = tuple(tuple(tuple(s for s in range(4) if _KEPT[x][s] == t) for t in range(4)) for x in range(4))


def _edges(codes: Sequence[int], row: int, state: int, back: bool) -> Iterator[tuple[int, int, int, str]]:
    """Edits from a place on, or ``back`` to those before it: ``row, state, cost, letter``."""
    near = BEFORE[state] if back else (NEXT[state],)
    for s in near:
        yield row, s, INSERT, "I"
    at, to = (row - 1, row - 1) if back else (row, row + 1)
    if not 0 <= at < len(codes):
        return
    yield to, state, DELETE, "D"
    initial, fault = codes[at] >> 2, codes[at] & 3
    if fault in (BLANK, DUPLICATE):
        return
    more = KEEP_TRUNCATED if fault == TRUNCATED else 0
    for s in _KEPT_BEFORE[initial][state] if back else (_KEPT[initial][state],):
        if s >= 0:
            yield to, s, more, "K"
    for s in near:
        yield to, s, REROLE + more, "R"


def cheapest(codes: Sequence[int], start: int = 0, goals: Sequence[int] = GOALS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from state ``start`` to one of ``goals``.

    Within a cost, places are settled layer by layer: edges without a cost lead
    to the next layer, so all equally dear audits of a place are known by then.
    """
    n = len(codes)
    labels: list[dict] = [{(0, start): (0, "")}, {(n, g): (0, "") for g in goals}]
    settled: list[dict] = [{}, {}]
    heaps: list[list] = [[], []]
    best: tuple[int, str] | None = None

    def settle(side: int, place: tuple[int, int]) -> None:
        nonlocal best
        cost, audit = settled[side][place] = labels[side][place]
        other = settled[1 - side]

        def crossing(far: tuple[int, str], own: tuple[int, str]) -> None:
            nonlocal best
            found = (own[0] + far[0], far[1] + own[1] if side else own[1] + far[1])
            if best is None or found < best:
                best = found

        if place in other:
            crossing(other[place], (cost, audit))
        for row, state, price, letter in _edges(codes, *place, back=bool(side)):
            to = (row, state)
            label = (cost + price, letter + audit if side else audit + letter)
            if to in other:
                crossing(other[to], label)
            if to not in settled[side] and (to not in labels[side] or label < labels[side][to]):
                labels[side][to] = label
                heappush(heaps[side], (label[0], -row if side else row, state))

    for side in (0, 1):
        for place in list(labels[side]):
            settle(side, place)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = int(len(settled[1]) < len(settled[0]))
        _, row, state = heappop(heaps[side])
        place = (-row if side else row, state)
        if place not in settled[side]:
            settle(side, place)
    return best


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after damage by a checksum of the ids; nulls are one space.

    Rows that are dropped have no copies, rows that are repeated have two.
    """
    blank = F.lit(" ")
    rows = columns(rows, conv_id="bigint", turn="bigint", role="string", text="string")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _code() -> Column:
    """Initial and fault of a row by itself."""
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    closed = F.col("text").rlike(rf"[.!?]{_WHITE}*\z")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(closed, GOOD).otherwise(TRUNCATED)
    return (number * 4 + fault).cast("int")


_ORDER = ("turn", "role", "hash")


def _cells(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with the ``code`` of the first copy and of the others.

    A row is a duplicate of an earlier turn's with the same role and text. How
    early that is, is an aggregate; so one row that a conversation repeats again
    and again is not brought to one task.
    """
    hashed = rows.withColumns({"hash": F.unhex(F.sha2("text", 256)), "code": _code()})
    cells = hashed.groupBy("conv_id", *_ORDER, "code").agg(F.sum("copies").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    firsts = (
        cells.where("copies > 0")
        .groupBy("conv_id", "role", "hash")
        .agg(F.count("*").alias("n"), F.min(turn).alias("first"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    met = cells.join(firsts, same, "left")
    fault = F.col("code").bitwiseAND(3)
    again = F.when(fault == BLANK, F.col("code")).otherwise(F.col("code") - fault + DUPLICATE)
    later = F.coalesce(F.col("first") != turn, F.lit(False))
    return met.select(
        "conv_id", *_ORDER, "copies", F.when(later, again).otherwise(F.col("code")).alias("code"), again.alias("again")
    )


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_CHUNKS = (
    "conv_id bigint, part int, number int, open boolean, first int, last int, "
    + "".join(f"{c} bigint, " for c in _COUNTS)
    + "low bigint, high bigint, cost bigint, audit string, costs array<bigint>, audits array<string>"
)


class _Chunk:
    """Consecutive rows of a conversation."""

    def __init__(self, conv: int | None, number: int):
        self.conv, self.number = conv, number
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, codes: bytes) -> None:
        self.codes += codes
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def row(self, part: int, open_: bool) -> dict:
        codes = bytes(self.codes)
        initials, faults = [c >> 2 for c in codes], [c & 3 for c in codes]
        out = {"conv_id": self.conv, "part": part, "number": self.number, "open": open_}
        out |= {"first": initials[0] if codes else None, "last": initials[-1] if codes else None}
        out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
        out |= {"illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))}
        out |= {"turns": self.turns, "low": self.low, "high": self.high}
        if not open_:
            out["cost"], out["audit"] = cheapest(codes)
            return out
        found = [cheapest(codes, s, (t,)) or (None, None) for s in range(4) for t in range(4)]
        return out | {"costs": [x[0] for x in found], "audits": [x[1] for x in found]}


def _arrow(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.record_batch([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _chunks(cells: DataFrame) -> DataFrame:
    """Chunks of conversations in order; ``open`` ones may go on in another chunk."""
    most = CHUNK
    ordered = cells.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, begins, rows = None, True, []  # the first and the last conversation of a part may be cut
        for batch in batches:
            read = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "copies", "code", "again")]
            for conv, turn, copies, code, again in zip(*read, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows.append(now.row(part, begins or now.number > 0))
                        begins = False
                    now = _Chunk(conv, 0)
                first = 1
                while copies:
                    n = min(copies, most - len(now.codes))
                    now.add(turn, bytes([code] * first + [again] * (n - first)))
                    copies, first = copies - n, 0
                    if len(now.codes) == most:
                        rows.append(now.row(part, True))
                        now = _Chunk(conv, now.number + 1)
            if rows:
                yield _arrow(rows, _CHUNKS)
                rows = []
        if now is not None:
            yield _arrow([now.row(part, True)], _CHUNKS)

    return ordered.select("conv_id", "turn", "copies", "code", "again").mapInArrow(task, _CHUNKS)


class _Joined:
    """Chunks of one conversation behind each other."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.sums = dict.fromkeys(_COUNTS, 0)
        self.last = self.low = self.high = None

    def add(self, row: dict) -> None:
        for c in _COUNTS:
            self.sums[c] += row[c]
        if row["first"] is not None:
            self.sums["illegal"] += self.last is not None and (self.last, row["first"]) not in LEGAL
            self.last = row["last"]
        if row["low"] is not None:
            self.sums["turns"] -= row["low"] == self.high
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        new: list[tuple[int, str] | None] = [None] * 4
        for s, own in enumerate(self.best):
            for t in range(4):
                price = row["costs"][4 * s + t]
                if own is None or price is None:
                    continue
                cost = own[0] + price
                if new[t] is None or cost <= new[t][0]:
                    found = (cost, own[1] + row["audits"][4 * s + t])
                    new[t] = found if new[t] is None else min(new[t], found)
        self.best = new

    def row(self) -> dict:
        cost, audit = min(x for x in (self.best[g] for g in GOALS) if x is not None)
        return {"conv_id": self.conv, **self.sums, "low": self.low, "high": self.high, "cost": cost, "audit": audit}


_SOLVED = "conv_id bigint, " + "".join(f"{c} bigint, " for c in _COUNTS) + "low bigint, high bigint, cost bigint, audit string"


def _joined(chunks: DataFrame) -> DataFrame:
    """Open chunks in order, joined; a conversation's chunks stream by, and only its audit is held."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in slices(batches, rows=64):
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Joined(row["conv_id"])
                now.add(row)
            if rows:
                yield _arrow(rows, _SOLVED)
                rows = []
        if now is not None:
            yield _arrow([now.row()], _SOLVED)

    ordered = chunks.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(task, _SOLVED)


_REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)


class _Writer:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, solved: dict):
        self.solved, self.audit, self.at, self.state = solved, solved["audit"], 0, 0
        self.hash, self.any = hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"\n{role}:{text}".encode() if self.any else f"{role}:{text}".encode())
        self.any = True

    def _turn(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._line("user" if self.state == U else "assistant", text)

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._turn("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": S, "u": U, "a": A}[role[0]]
            self._line(role, text)
        elif letter == "R":
            self._turn(text)

    def row(self) -> dict:
        self.inserted()
        s = self.solved
        gaps = 0 if s["low"] is None else min(s["high"] - s["low"] + 1 - s["turns"], _LONGEST)
        return {**s, "gaps": gaps, "repaired_sha256": self.hash.hexdigest()}


def _hashed(solved: DataFrame, rows: DataFrame) -> DataFrame:
    """The result of each conversation: first its edits, then its rows in order, as they stream by."""
    names = [c.split(" ")[0] for c in _SOLVED.split(", ")]
    edits = solved.select("conv_id", F.struct(*names[1:]).alias("edits"))
    texts = rows.where("copies > 0").withColumn("hash", F.unhex(F.sha2("text", 256)))
    both = edits.withColumn("after", F.lit(False)).unionByName(texts.withColumn("after", F.lit(True)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "after", *_ORDER)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in slices(batches, "text"):
            read = [batch.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text", "copies")]
            for conv, own, role, text, copies in zip(*read, strict=True):
                if own is not None:
                    if now is not None:
                        done.append(now.row())
                    now = _Writer({"conv_id": conv, **own})
                    continue
                for _ in range(copies):
                    now.add(role, text)
            if done:
                yield _arrow(done, _REPAIRED)
                done = []
        if now is not None:
            yield _arrow([now.row()], _REPAIRED)

    return ordered.select("conv_id", "edits", "role", "text", "copies").mapInArrow(task, _REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows, for every conversation of ``conv_id, turn, role, text, copies``.

    Rows are ordered by turn, nulls first; rows of one turn by role and then by
    a hash of the text. A row stands ``copies`` times; a conversation whose rows have none
    has zeros, an empty audit and the hash of an empty string, which is also what
    stays of one that is deleted as a whole. The null id is a conversation of its own. A role without an
    initial among ``s``, ``u`` and ``a``, the empty one too, can't be kept. Null
    roles and texts aren't expected here: ``damaged`` makes them a space, which is
    a blank text and such a role. Texts are equal if their SHA-256 is. ``gaps`` that
    exceed a long are the largest long. An empty table gives no rows.

    The hash runs over a conversation's rows in order and can't be split; they
    stream through one task, which holds the audit and a few rows at a time.
    """
    chunks = stage(_chunks(_cells(rows)), "conversation-chunks")
    names = [c.split(" ")[0] for c in _SOLVED.split(", ")]
    solved = chunks.where("NOT open").select(*names).unionByName(_joined(chunks))
    return _hashed(solved, rows)
