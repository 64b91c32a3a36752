"""Packing of documents into training windows of several lengths.

Full windows are cut from a document's front. What is left is routed to the shortest context tier that holds it (the
tiers are powers of two, so their windows are padded to nothing else). Each tier is packed from the longest down: a
window opens with a rest of its own tier, its gap takes the longest rests of shorter tiers that fit, and what no
whole rest fits is cut from the shortest one that is longer, whose end goes back to a shorter tier. So every window is full. When
a cell's rests run out, the last gap can't be filled: that window is split into the powers of two of its length.

Tasks pack the documents that they read, in cells of a bounded number of tokens, so nothing is shuffled, no key can be
hot and memory is a cell. Windows of one length are then numbered over all tasks by prefix sums, and as many as make
step_tokens form a step group: every group of a length has the same tokens, but for the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.bpe import tokenizer
from sievekit.llm.common import SLICE, materialize


@dataclass(frozen=True)
class Params:
    """window: tokens of the longest tier; least: of the shortest; both powers of two. cell_tokens: about the tokens
    that are packed together. step_tokens: of a step group, a multiple of window. end_id: closes a document.
    kept_words: words whose ids a worker keeps, in each of two generations."""

    window: int = 1024
    least: int = 64
    cell_tokens: int = 2_000_000
    step_tokens: int = 1 << 19
    end_id: int = 0
    kept_words: int = 300_000


class Rests:
    """Rests of documents by length, with the longest that fits and the shortest that is longer found through one bit per length."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.bits |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        held = self.by[length]
        one = held.pop()
        if not held:
            self.bits &= ~(1 << length)
        return one

    def fitting(self, gap: int) -> int:
        """The longest length up to gap, 0 if there is none."""
        return max((self.bits & ((2 << gap) - 1)).bit_length() - 1, 0)

    def longer(self, gap: int) -> int:
        """The shortest length above gap, 0 if there is none."""
        above = self.bits >> (gap + 1)
        return (above & -above).bit_length() + gap if above else 0


def tier(length: int, params: Params) -> int:
    """The shortest context that holds so many tokens."""
    return max(params.least, 1 << (length - 1).bit_length())


def pack(lengths: list[int], params: Params = Params()) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length), whose lengths sum to a power of two of at most window. Lengths are 1 or more."""
    out, rests = [], Rests()
    for doc, n in enumerate(lengths):
        whole = n // params.window * params.window
        out += [[(doc, at, params.window)] for at in range(0, whole, params.window)]
        if n > whole:
            rests.put(n - whole, doc, whole)
    while rests.bits:
        length = rests.bits.bit_length() - 1
        size = gap = tier(length, params)
        pieces = []
        while gap and rests.bits:
            if fit := rests.fitting(gap):
                pieces.append((*rests.take(fit), fit))
                gap -= fit
            else:
                more = rests.longer(gap)
                doc, start = rests.take(more)
                pieces.append((doc, start, gap))
                rests.put(more - gap, doc, start + gap)
                gap = 0
        if gap:
            out += split(pieces, size - gap)
        else:
            out.append(pieces)
    return out


def split(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces in windows of the powers of two of their total, the longest first."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room, own = total & (1 << bit), []
        while room:
            doc, start, n = left.pop()
            part = min(n, room)
            own.append((doc, start, part))
            if part < n:
                left.append((doc, start + part, n - part))
            room -= part
        if own:
            out.append(own)
    return out


_PIECES = "doc_tokens long, start long, length long, ids binary, sequence_id long, offset long, context int, task int, place long"


def pieces(docs: DataFrame, path: str, params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """A row per piece: ``row`` (the document without its text, or its columns in keep), doc_tokens, start, length, ids
    (packed little-endian unsigned 32-bit), sequence_id, offset, context (the window's length), and for steps: task and place.

    A null text counts as empty: its only token is the closing id. Repeated rows are packed each for itself. Which
    documents share a window depends on how the input is split into tasks; the same split gives the same windows.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col("text"))
    schema = T.StructType([T.StructField("row", slim.schema["row"].dataType, False), *T._parse_datatype_string(_PIECES).fields])
    end = params.end_id.to_bytes(4, "little")

    def run(batches):
        encode, task, number, places = tokenizer(path, params.kept_words).encode_all, TaskContext.get().partitionId(), 0, {}

        def packed(rows, coded):
            nonlocal number
            lengths = [len(x) // 4 for x in coded]
            docs_, out = [], [[] for _ in range(9)]
            for window in pack(lengths, params):
                context = sum(n for _, _, n in window)
                place = places.get(context, 0)
                places[context] = place + 1
                offset = 0
                for doc, start, n in window:
                    docs_.append(doc)
                    values = (lengths[doc], start, n, coded[doc][4 * start : 4 * (start + n)], task << 40 | number, offset, context, task, place)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    offset += n
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.concat_arrays(rows).take(pa.array(docs_, pa.int64())), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            whole = pa.RecordBatch.from_arrays(arrays, names=["row", *"doc_tokens start length ids sequence_id offset context task place".split()])
            for i in range(0, whole.num_rows, 10_000):
                yield whole.slice(i, 10_000)

        rows, coded, held = [], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                own = [ids + end for ids in encode(part.column(1).to_pylist())]
                rows.append(part.column(0))
                coded += own
                held += sum(map(len, own)) // 4
                if held >= params.cell_tokens:
                    yield from packed(rows, coded)
                    rows, coded, held = [], [], 0
        if coded:
            yield from packed(rows, coded)

    return slim.mapInArrow(run, schema)


def steps(packed: DataFrame, params: Params = Params()) -> DataFrame:
    """packed, a written table of pieces, with step: the group of step_tokens that a window of its length belongs to.

    A task's windows of one length come after those of the tasks before; only a count for each task and length meets in one place.
    """
    counts = packed.filter("offset = 0").groupBy("task", "context").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("task", "context", (F.sum("_n").over(Window.partitionBy("context").orderBy("task")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("place")
    return packed.join(before, ["task", "context"]).withColumn("step", F.floor(rank * F.col("context") / params.step_tokens)).drop("_before", "task", "place")


def pack_documents(docs: DataFrame, path: str, params: Params = Params()) -> DataFrame:
    """All pieces with their step groups: row, doc_tokens, start, length, ids, sequence_id, offset, context, step."""
    return steps(materialize(pieces(docs, path, params), "pack-pieces"), params)
