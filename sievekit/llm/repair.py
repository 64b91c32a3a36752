"""Conversations repaired by the cheapest edits, found by a Viterbi search that forgets what is settled.

A state is what the repaired roles so far allow next. Each row extends the survivors (one a state, with the least
cost, ties by the least edits in ASCII order) by inserts and one edit of its own. Survivors are tips of a backpointer
tree whose nodes count their references: a survivor that is dropped takes the branches with it that no other one shares, and once
all survivors share an ancestor, the edits up to it are emitted (to the audit and the running hash) and forgotten. So
memory is what is still open, not the conversation.

Ties are those of whole edit strings. Up to a row, all strings hold the same number of row edits and end in one,
so none begins another, and the order of two survivors stays what it was where they parted: each survivor keeps its
rank in that order, which stands for comparing the unresolved suffixes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import materialize

WHITE = " \t\n\v\f\r"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; where each role's initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: Costs: a role replaced, a row deleted, a row inserted, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The most that a history ending in the first state must pay above one ending in the second to follow all that the second may do.
BEHIND = {(0, 3): 0, (0, 1): 0, (0, 2): 2, (1, 0): 4, (1, 2): 2, (1, 3): 4, (2, 0): 5, (2, 1): 2, (2, 3): 2, (3, 0): 3, (3, 1): 0, (3, 2): 2}


def _inserts(state: int) -> Iterator[tuple[str, int]]:
    """(inserted initials, state after) of no, one or two inserts."""
    yield "", state
    for a in "ua":
        if (one := MOVES.get((state, a))) is not None:
            yield a, one
            for b in "ua":
                if (two := MOVES.get((one, b))) is not None:
                    yield a + b, two


def _steps(initial: str, delete_only: bool) -> list[list[tuple[int, str, str, str, int]]]:
    """By state: (cost, edits, inserted initials, role initial of the row's own turn or "", state after) of all ways past a row."""
    out = []
    for state in range(4):
        ways = []
        for inserted, now in _inserts(state):
            cost, edits = INSERT * len(inserted), "I" * len(inserted)
            ways.append((cost + DELETE, edits + "D", inserted, "", now))
            if delete_only:
                continue
            if (to := MOVES.get((now, initial))) is not None:
                ways.append((cost, edits + "K", inserted, "K", to))
            for role in "ua":
                if (to := MOVES.get((now, role))) is not None:
                    ways.append((cost + REROLE, edits + "R", inserted, role, to))
        out.append(ways)
    return out


WAYS = {(initial, only): _steps(initial, only) for initial in ("s", "u", "a", "") for only in (False, True)}


class Node:
    """Edits of one row in the tree. turns: (role, text) that they leave. refs: children and survivors that hold it."""

    __slots__ = ("above", "edits", "refs", "turns")

    def __init__(self, above: Node | None, edits: str, turns: list[tuple[str, str]]):
        self.above, self.edits, self.turns, self.refs = above, edits, turns, 0
        if above is not None:
            above.refs += 1


def release(node: Node | None) -> None:
    """One reference to the node less; what nothing holds any more goes, up to a shared ancestor."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node.above, node = None, node.above


class Repair:
    """One conversation, row by row."""

    def __init__(self, every: int = 64):
        self.tips = {START: (0, 0, Node(None, "", []))}  # state: cost, rank, node
        self.tips[START][2].refs = 1
        self.audit, self.hash, self.first = [], hashlib.sha256(), True
        self.open, self.every, self.look = 0, every, every

    def add(self, role: str, text: str, delete_only: bool, truncated: bool) -> None:
        initial = role[:1]
        ways = WAYS[initial if initial in ("s", "u", "a") else "", delete_only]
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.tips.items():
            for more, edits, inserted, own, to in ways[state]:
                found = (cost + more + (TRUNCATED if truncated and own else 0), rank, edits, inserted, own, node)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        held = {q: b for q, b in best.items() if not any(b[0] > best[p][0] + BEHIND[p, q] for p in best if p != q)}
        order = sorted(held, key=lambda q: held[q][1:3])
        now = {}
        for rank, q in enumerate(order):
            cost, _, edits, inserted, own, above = held[q]
            turns = [(NAMES[i], "") for i in inserted]
            if own:
                turns.append((role if own == "K" else NAMES[own], text))
            node = Node(above, edits, turns)
            node.refs = 1
            now[q] = (cost, rank, node)
        for _, _, node in self.tips.values():
            release(node)
        self.tips = now
        self.open += 1
        if self.open >= self.look:
            self.settle()

    def settle(self) -> None:
        """Emit what all survivors share."""
        path, node = [], next(iter(self.tips.values()))[2]
        while node is not None:
            path.append(node)
            node = node.above
        while len(path) > 1 and path[-1].refs == 1:  # held by one child alone
            done = path.pop()
            self.emit(done)
            path[-1].above = None
        self.open = len(path)
        self.look = max(self.every, 2 * self.open)

    def emit(self, node: Node) -> None:
        self.audit.append(node.edits)
        for role, text in node.turns:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired turns)."""
        finals = []
        for state, (cost, rank, node) in self.tips.items():
            finals += [(cost + INSERT * len(ins), rank, "I" * len(ins), ins, node) for ins, to in _inserts(state) if to in ENDS]
        cost, _, edits, inserted, node = min(finals, key=lambda f: f[:3])
        path = [Node(None, edits, [(NAMES[i], "") for i in inserted])]
        while node is not None:
            path.append(node)
            node = node.above
        for one in reversed(path):
            self.emit(one)
        return cost, "".join(self.audit), self.hash.hexdigest()


# --- frames ------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) after the damage that crc32 of "conv_id:turn" modulo 20 names; nulls count as one space.

    A dropped row stays with alive false, so that its conversation is known.
    """
    blank = F.lit(" ")
    own = rows.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    own = own.withColumn("_kind", kind)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    own = own.withColumn("text", text).withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))).withColumn("alive", F.col("_kind") != 0)
    return own.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_kind", "_copy")


def _digest() -> list[Column]:
    return [F.xxhash64(F.lit(i), "role", "text").alias(f"d{i}") for i in (1, 2)]


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


class Conversation:
    """The counts and the repair of one conversation, whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = self.initial = None

    def add(self, turn, role, text, first) -> None:
        """first: (has a turn, turn) of the earliest row with this role and text where there are several, else null."""
        if turn is not None and turn != self.high:
            self.distinct, self.high = self.distinct + 1, turn
            self.low = turn if self.low is None else self.low
        this = (turn, role, text)
        again = first is not None and ((turn is not None, turn or 0) > (first["known"], first["turn"] or 0) or this == self.before)
        self.before = this
        plain = text.rstrip(WHITE)
        blank, cut = not plain, bool(plain) and plain[-1] not in ".!?"
        again, cut = again and not blank, cut and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.repair.add(role, text, blank or again, cut)

    def row(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def repair_rows(rows: DataFrame) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text, alive, none null but conv_id and turn): its faults, the cost and audit of the cheapest edits, and the hash of what they leave.

    Rows go by turn (nulls first), rows of one turn by role and text, so repeated rows stand together. Rows that aren't
    alive only name their conversation. A null conv_id is a conversation. Where one of a conversation's rows appeared before is
    found by grouping, so the task that walks through a conversation holds none of its rows but those still open.
    """
    rows = materialize(rows.select("conv_id", "turn", "role", "text", "alive", *_digest()), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = rows.filter("alive").groupBy("conv_id", "d1", "d2").agg(F.count(F.lit(1)).alias("_c"), F.min(place).alias("first")).filter("_c > 1")
    several = several.select(F.col("conv_id").alias("_conv"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    marked = rows.join(several, same, "left").select("conv_id", "turn", "role", "text", "alive", "first")

    def walk(batches):
        now = None
        for batch in batches:
            done = []
            for conv, turn, role, text, alive, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                if alive:
                    now.add(turn, role, text, first)
            yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(walk, _OUT)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*done, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair_rows of the damaged rows; ids and turns as longs."""
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair_rows(damage(slim))
