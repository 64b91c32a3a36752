"""Language-model scoring by online logistic context mixing.

A text's bytes, and its end, are coded bit by bit. A byte's bits are the turns on its path in a prefix code that
depends on the two or three bytes before it, so that likely bytes have few. Three predictors look up the next turn under a
hashed context (the five bytes before, the word so far, the kind of the word before; each with the bytes that chose the
code); contexts run over the whole text and across blanks. Each finds a state (how often, and how one-sidedly, the
context turned here in the training texts), which a map turns into a logit. A gate picks the weights that combine the
logits, and a last table refines the mixed one. The code, the maps, and the weights and refinement a text
starts from are taken from all training texts; weights and refinement go on learning while a text is coded: after each segment of the text (512 bytes, then 1024, 1536, ...) they
move by what the segment's bits taught. So a text's score depends on the text and on the trained start alone, not
on the texts beside it or on partitions.

Beside it stands a smoothed count of whole words (the base score). Words are known by a 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import drop, id_modulus, materialize, releasing, settings, small_batches, small_reads

FOLDS, HELD_OUT = 5, 1
PREDICTORS, GATES, BUCKETS, STATES, DEEP, LANES = 3, 16, 24, 256, 18, 4
#: Ends a text (no byte of UTF-8); PAD of them stand before each text, since contexts reach less far back.
END, PAD, REACH = 255, 40, 16
#: Bytes of the word so far that count, and bits of the hash of the word before.
WORD, KINDS = 6, 6
#: Pieces in which a table travels.
PARTS = 512


@dataclass(frozen=True)
class Params:
    """most_bits: the table of contexts has 2**most_bits slots at most (a task that counts holds 8 bytes a slot, one that
    scores 1); below that it has a slot for each slot_bytes bytes of training text. head: most frequent words whose counts travel to every task (16 bytes each); others are joined.
    task_bytes: text that a counting task reads, about. held: words a task counts before it lets go of them (at most twice as many meanwhile).
    trees, tree_rows: most prefix codes, and bytes of training text that one of its own needs."""

    most_bits: int = 23
    slot_bytes: int = 32
    head: int = 500_000
    task_bytes: int = 96 << 20
    held: int = 1 << 19
    slice_bytes: int = 1 << 18
    count_bytes: int = 1 << 16
    block: int = 1 << 16
    segment: int = 512
    trees: int = 2048
    tree_rows: int = 100


# --- texts as arrays -----------------------------------------------------------------------------------------

_rng = np.random.default_rng(41)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: A number for each byte, the same for both cases of A-Z.
SYMBOL = (_rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))[_LOW]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32, END]] = True
#: The first predictor's order; the second has the word so far, the third the kind of the word before.
ORDERS, OWN = (5,), _rng.integers(0, 1 << 63, 4, np.uint64)
BASE, MIX, STEP = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    return _powers


def finish(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of a word, from its sum and its length in bytes; signed, as Spark's longs are."""
    h = raw + length.astype(np.uint64) * STEP
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def keep_memory() -> None:
    """Freeing one large array teaches the C library to keep what is freed after it: arrays of a few MB come and go all the time here."""
    np.empty(30 << 20, np.uint8)


class Slice:
    """Parts of texts laid out in one array: before each part PAD bytes (of the text before it, or END), behind a text's last part END.

    row: the text of each part; begin: where its coded bytes begin; size: how many there are; at: their place in the text.
    """

    def __init__(self, chunks: list[tuple[int, np.ndarray, int, np.ndarray, bool]]):
        """chunks: (row, bytes, place in the text, up to PAD bytes before, whether the text ends)."""
        edge, parts, at = np.full(PAD, END, np.uint8), [], 0
        self.row = np.array([c[0] for c in chunks])
        self.at = np.array([c[2] for c in chunks])
        self.last = np.array([c[4] for c in chunks])
        begin = []
        for _, data, _, before, last in chunks:
            parts += [edge[len(before) :], before, data] + [edge[:1]] * last
            begin.append(at + PAD)
            at += PAD + len(data) + last
        parts.append(edge)
        self.begin = np.array(begin)
        self.size = np.array([len(c[1]) + c[4] for c in chunks])
        self.data = np.concatenate(parts)
        n = len(self.data)
        power, self.inverse = powers(n + 1)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(SYMBOL.take(self.data, mode="clip") * power[:n], out=self.run[1:])

    def words(self):
        """(part, sum, length, whether it begins its part, whether it ends it) of each run of bytes that are no white space."""
        black = ~WHITE.take(self.data, mode="clip")
        for k in np.flatnonzero(self.at > 0).tolist():
            black[self.begin[k] - PAD : self.begin[k]] = False
        edges = np.flatnonzero(black[1:] != black[:-1]) + 1
        a, b = edges[::2], edges[1::2]
        part = np.searchsorted(self.begin, a, "right") - 1
        raw = (self.run[b] - self.run[a]) * self.inverse[a]
        return part, raw, b - a, a == self.begin[part], b == self.begin[part] + self.size[part]

    def contexts(self, code: Code) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each predictor and byte (times MIX, as blocks wants it), and the tree of each byte times 256."""
        d, run, inverse, n = self.data, self.run, self.inverse, len(self.data)
        out = np.zeros((PREDICTORS, n), np.uint64)
        wide = d.astype(np.uint32)
        two = (wide[:-1] << np.uint32(8)) | wide[1:]
        tree = np.zeros(n, np.uint16)
        tree[2:] = code.tree.take(two[:-1], mode="clip")
        deep = code.deep.take(three_bytes((two[:-2] << np.uint32(8)) | wide[2:-1]), mode="clip")
        np.maximum(tree[3:], deep, out=tree[3:])  # trees of three bytes have the highest numbers
        for p, k in enumerate(ORDERS):
            np.multiply(run[k:n] - run[: n - k], inverse[: n - k], out=out[p, k:])
        first = np.r_[0, np.flatnonzero(WHITE.take(d[:-1], mode="clip")) + 1]  # where words begin
        size = np.diff(first, append=n)
        since = np.arange(n)
        since -= np.repeat(first, size)
        near = np.arange(n)
        near -= np.minimum(since, WORD)
        np.subtract(run[:n], run.take(near, mode="clip"), out=out[1])
        out[1] *= inverse.take(near, mode="clip")
        space = np.maximum(first - 1, 0)
        before = np.maximum(space - since[space], space - REACH)
        kind = (run[space] - run[before]) * inverse[before] * MIX >> np.uint64(64 - KINDS)
        out[2] = np.repeat(kind, size)
        long = size > REACH + 1
        out[2][spread(first[long] + REACH + 1, size[long] - REACH - 1)] = 0
        mixed = tree * MIX
        for p in range(PREDICTORS):
            out[p] += mixed
            out[p] += OWN[p]
            out[p] *= MIX
        symbol = tree.astype(np.int64)
        symbol <<= 8
        return out, symbol


def whole_words(parts):
    """(slice, rows, hashes) for each slice: its words with their rows; a word that goes on in the text's next part comes with that."""
    open_ = None
    for s in parts:
        part, raw, length, opens, closes = s.words()
        row = s.row[part]
        if open_ is not None:
            if len(raw) and opens[0]:
                raw[0] = (int(open_[0]) + int(raw[0]) * pow(BASE, int(open_[1]), 1 << 64)) & ((1 << 64) - 1)
                length[0] += open_[1]
            else:
                row, raw, length, closes = np.r_[s.row[0], row], np.r_[open_[0], raw], np.r_[open_[1], length], np.r_[False, closes]
            open_ = None
        if not s.last[-1] and len(raw) and closes[-1]:
            open_ = raw[-1], length[-1]
            row, raw, length = row[:-1], raw[:-1], length[:-1]
        yield s, row, finish(raw, length)


def slices(column: pa.Array, params: Params):
    """The texts of a column (null: empty) as slices of about params.slice_bytes; a longer text comes in parts that end where segments do."""
    column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    held, size, none = [], 0, np.zeros(0, np.uint8)
    for i in range(len(column)):
        text = data[ends[i] : ends[i + 1]]
        if len(text) <= params.slice_bytes:
            held.append((i, text, 0, none, True))
            size += len(text) + PAD
            if size >= params.slice_bytes:
                yield Slice(held)
                held, size = [], 0
            continue
        at, k = 0, 0
        while at < len(text):
            end = at
            while end < len(text) and end - at < params.slice_bytes:
                k += 1
                end = bound(k, params)
            yield Slice([(i, text[at:end], at, text[max(0, at - PAD) : at], end >= len(text))])
            at = end
    if held:
        yield Slice(held)


def bound(k: int, params: Params) -> int:
    """Where the k-th segment begins."""
    return params.segment * k * (k + 1) // 2


# --- the code ------------------------------------------------------------------------------------------------


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits from the top of a 32-bit number, length) for each of 256 bytes."""
    heap = [(float(c), b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children, number = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], number, number))
        number += 1
    code, length, todo = np.zeros(256, np.uint32), np.zeros(256, np.uint8), [(heap[0][2], 0, 0)]
    while todo:
        at, bits, n = todo.pop()
        if at < 256:
            code[at], length[at] = bits << (32 - n), n
        else:
            todo += [(child, bits * 2 + turn, n + 1) for turn, child in enumerate(children[at])]
    return code, length


def three_bytes(number: np.ndarray) -> np.ndarray:
    """The place of three bytes (one 24-bit number) in Code.deep; where two meet they share a tree."""
    return number * np.uint32(0x9E3779B1) >> np.uint32(32 - DEEP)


@dataclass
class Code:
    """tree: of each two bytes; deep: of three bytes by their hash, 0 for none; code and length: of each tree and byte."""

    tree: np.ndarray
    deep: np.ndarray
    code: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(texts: list[bytes], params: Params) -> Code:
        """The code that a list of texts teaches."""
        parts = list(slices(pa.array(texts, pa.binary()).cast(pa.string()), params))
        grams = np.unique(np.concatenate([three_of(s) for s in parts]), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
        starts = own_trees(*grams, params)[2]
        after = after_starts(starts)
        return Code.made(grams, starts, np.unique(np.concatenate([after(s) for s in parts]), return_counts=True) if parts else grams, params)

    @staticmethod
    def made(grams: tuple[np.ndarray, np.ndarray], starts: np.ndarray, after: tuple[np.ndarray, np.ndarray], params: Params) -> Code:
        """A code for the most frequent three and two bytes before; the others share one for each byte before, rare bytes one code.

        grams: the numbers of three bytes and how often they stand in the texts; starts: of own_trees; after: what after_starts finds, and how often.
        """
        singles, pairs, _ = own_trees(*grams, params)
        pair = np.zeros(1 << 24, np.float32)
        pair[grams[0]] = grams[1]
        pair = pair.reshape(1 << 16, 256)
        single = pair.reshape(256, 256, 256).sum(0, dtype=np.float64)
        # no path is longer than 32: the least share is above the 32nd Fibonacci number's inverse
        zero = single.sum(0) + 0.2
        zero = np.maximum(zero / zero.sum(), 1e-5)
        one = single + 2 * zero
        codes, tree = [prefix_code(zero)], np.zeros(1 << 16, np.uint16)
        for b in singles.tolist():
            tree[np.arange(256) * 256 + b] = len(codes)
            codes.append(prefix_code(np.maximum(one[b] / one[b].sum(), 1e-5)))
        for q in pairs.tolist():
            share = pair[q] + 4 * one[q & 255] / one[q & 255].sum()
            tree[q] = len(codes)
            codes.append(prefix_code(np.maximum(share / share.sum(), 1e-5)))
        deep = np.zeros(1 << DEEP, np.uint16)
        follow = np.zeros(len(starts) * 256)
        follow[after[0]] = after[1]
        for start, many in zip(starts.tolist(), follow.reshape(-1, 256), strict=True):
            q = start & 0xFFFF
            share = many + 4 * (pair[q] + 0.01) / (pair[q] + 0.01).sum()
            deep[three_bytes(np.array([start], np.uint32))] = len(codes)
            codes.append(prefix_code(np.maximum(share / share.sum(), 1e-5)))
        return Code(tree, deep, np.concatenate([c for c, _ in codes]), np.concatenate([n for _, n in codes]))

    def sorted(self, places: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, codes, lengths) of bytes in falling order of length; symbol: 256 times the tree, plus the byte."""
        length = self.length.take(symbol)
        by = np.argsort(np.uint8(255) - length, kind="stable")
        return places.take(by), self.code.take(symbol.take(by)), length.take(by)


def three_of(part: Slice, back: int = 0) -> np.ndarray:
    """For each coded byte the number of three bytes: itself and the two before it, or those that stand back bytes earlier."""
    wide = part.data.astype(np.uint32)
    three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return joined_ranges(three, part.begin - back - 2, part.size).astype(np.int64)


def own_trees(grams: np.ndarray, counts: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, two bytes and three bytes that have a tree of their own for the byte behind them; the last two with the most frequent first."""
    seen = np.bincount((grams >> 8) & 255, counts, 256)
    many = np.bincount(grams >> 8, counts, 1 << 16)
    singles = np.flatnonzero(seen >= params.tree_rows)
    pairs = np.argsort(-many, kind="stable")[: params.trees // 4]
    pairs = pairs[many[pairs] >= max(params.tree_rows, 1)]
    # three bytes stand before another one unless they end with the text; once in each text they are none of it
    inner = (grams & 255) != END
    grams, counts = np.r_[grams[inner], (1 << 24) - 1], np.r_[counts[inner], many[-1]]
    starts = np.argsort(-counts, kind="stable")[: max(0, params.trees - 1 - len(singles) - len(pairs))]
    return singles, pairs, grams[starts[counts[starts] >= max(params.tree_rows, 1)]]


def after_starts(starts: np.ndarray):
    """A function from a slice to 256 * place + byte for each coded byte behind three bytes that are among starts."""
    place = np.full(1 << 24, -1, np.int16)
    place[starts] = np.arange(len(starts))

    def after(part: Slice) -> np.ndarray:
        own = place.take(three_of(part, 1), mode="clip")
        some = np.flatnonzero(own >= 0)
        return own.take(some).astype(np.int64) * 256 + joined_ranges(part.data, part.begin, part.size).take(some)

    return after


def joined(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The first sizes[0] items of x, then the first sizes[1], ..."""
    return np.concatenate([x[:m] for m in sizes]) if len(sizes) > 1 else x[: sum(sizes)]


def longer(length: np.ndarray) -> list[int]:
    """How many of some lengths in falling order are above 0, 1, ... up to the largest."""
    top = int(length[0]) if len(length) else 0
    return np.searchsorted(np.uint8(255) - length, np.arange(255, 254 - top, -1, dtype=np.uint8)).tolist()


def blocks(contexts: np.ndarray, code: np.ndarray, length: np.ndarray, bits: int):
    """(how many bytes have a first, second, ... block of slots, each for three turns, and a function from predictor to the numbers of all first
    blocks, then of all second ones, ...); bytes in falling order of length."""
    many, shift = longer(length)[:-1:3], np.uint64(64 - bits + 3)
    step = np.uint64(int(STEP) * int(MIX) % (1 << 64))
    own, at = np.full(sum(many), step), 0
    for k, m in enumerate(many):
        if k:
            own[at : at + m] = (code[:m] >> np.uint32(32 - 3 * k)) | np.uint32(1 << 3 * k)
            own[at : at + m] *= step
        at += m

    def numbers(p):
        h = joined(contexts[p], many) + own
        h >>= shift
        return h.view(np.int64)

    return many, numbers


def paths(code: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first turn of the first sizes[0] bytes, the second one of the first sizes[1], ..., and their places (1, 2-3 or 4-7) in their blocks."""
    back, inside = np.arange(31, 31 - len(sizes), -1, dtype=np.uint32), np.array([1, 2, 4], np.uint8)[np.arange(len(sizes)) % 3]
    path = joined(code, sizes) >> np.repeat(back, sizes)
    low = path.astype(np.uint8)
    turn = low & np.uint8(1)
    low >>= np.uint8(1)
    low &= np.repeat(inside - np.uint8(1), sizes)
    low |= np.repeat(inside, sizes)
    return turn, low


def steps(contexts: np.ndarray, code: np.ndarray, length: np.ndarray, bits: int):
    """For up to three turns of each byte at a time: (how many bytes have each of the turns, the turns, the slots of each predictor)."""
    left = longer(length)[:-1]
    many, number = blocks(contexts, code, length, bits)
    numbers, (turn, place), at, first = [number(p) << 3 for p in range(PREDICTORS)], paths(code, left), 0, 0
    for k, m in enumerate(many):
        sizes = left[3 * k : 3 * k + 3]
        n = sum(sizes)
        yield sizes, turn[at : at + n], [joined(x[first : first + m], sizes) + place[at : at + n] for x in numbers]
        at, first = at + n, first + m


def looked_up(contexts: np.ndarray, code: np.ndarray, length: np.ndarray, bits: int, table: np.ndarray):
    """All steps in one, with the table's bytes instead of slots: (sizes, turns, bytes of each predictor). A block's eight are fetched as one number.

    Many bytes have few turns, few have many, and short arrays cost as much as long ones.
    """
    sizes, eight = longer(length)[:-1], table.view("<u8")
    many, number = blocks(contexts, code, length, bits)
    turn, place = paths(code, sizes)
    shift = place.astype(np.uint64)
    shift <<= np.uint64(3)
    begin = np.repeat(np.cumsum([0, *many[:-1]]), 3)[: len(sizes)].tolist()
    found = []
    for p in range(PREDICTORS):
        block = eight.take(number(p), mode="clip").astype("<u8", copy=False)  # all places lie inside their tables by their making
        each = np.concatenate([block[i : i + n] for i, n in zip(begin, sizes)]) if sizes else block
        each >>= shift
        found.append(each.astype(np.uint8))
    return sizes, turn, found


def count_turns(part: Slice, coder: Code, table: np.ndarray, bits: int) -> None:
    """Add the turns of the slice's bytes to table[block, place]: up to three turns lead from place 1 of a context's block to 2 or 3, 4 to 7, or 8 to 15."""
    contexts, tree = part.contexts(coder)
    here = spread(part.begin, part.size)
    own, code, length = coder.sorted(here, (tree + part.data).take(here))
    flat = table.reshape(-1)
    many, number = blocks([c.take(own) for c in contexts], code, length, bits)
    before = np.repeat(np.arange(0, 3 * len(many), 3, dtype=np.uint32), many)
    turns = np.minimum(joined(length, many) - before, np.uint32(3))
    place = ((joined(code, many) << before) >> (np.uint32(32) - turns)) | (np.uint32(1) << turns)
    for p in range(PREDICTORS):
        at = number(p)
        at <<= 4
        at |= place
        np.add.at(flat, at, np.uint32(1))


def turns_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each slot turned to 0 and to 1, from the places where its block's turns led."""
    through = table.reshape(-1, 16).astype(np.uint64)
    for j in range(7, 1, -1):
        through[:, j] += through[:, 2 * j] + through[:, 2 * j + 1]
    through[:, 0] = through[:, 1] = 0
    return through[:, 0::2].reshape(-1), through[:, 1::2].reshape(-1)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def joined_ranges(x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x.take(spread(begin, size)), for ranges that are long or few."""
    return np.concatenate([x[a : a + n] for a, n in zip(begin.tolist(), size.tolist())])


def states(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """0: never seen; else a step of the total (1, 2, 3-4, 5-8, ...) and one of 32 steps of the share of ones."""
    one = one.astype(np.float64)
    n = zero + one
    level = np.minimum(np.ceil(np.log2(np.maximum(n, 1))), 7).astype(np.int64)
    share = np.minimum((one + 0.02) / (n + 0.04) * 32, 31).astype(np.int64)
    return np.where(n == 0, 0, np.maximum(level * 32 + share, 1)).astype(np.uint8)


def known(found: np.ndarray) -> np.ndarray:
    """Four steps of how well a state's context is known: 0 for the state never seen, then one for each two levels of the total, up to 3."""
    level = (found > 0).view(np.uint8)
    level += found > 63
    level += found > 127
    return level


KNOWN = known(np.arange(STATES, dtype=np.uint8))


def gates(found: list[np.ndarray]) -> np.ndarray:
    """The gates of turns, from the states (bytes) of each predictor."""
    return known(found[0]) * np.uint8(4) + known(found[1])


@dataclass
class Model:
    """code; table: a state for each slot; maps[predictor, state]: logits; weights[predictor, gate]; refined[bucket]: added to the mixed logit."""

    code: Code
    bits: int
    table: np.ndarray
    maps: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def start(self, texts: int):
        """The weights and refinements of so many texts before their first byte."""
        return np.tile(self.weights, texts), np.tile(self.refined, texts)

    def cost(self, part: Slice, weights: np.ndarray, refined: np.ndarray, params: Params) -> np.ndarray:
        """Bits of each part; weights and refined (a set for each part) go on learning."""
        contexts, tree = part.contexts(self.code)
        symbol = tree + part.data
        first, last = (np.floor((np.sqrt(1 + 8 * (x // params.segment)) - 1) / 2).astype(np.int64) for x in (part.at, part.at + part.size - 1))
        many = last - first + 1
        owner = np.repeat(np.arange(len(many)), many)
        number = spread(first, many)
        low = params.segment * number * (number + 1) // 2
        high = np.minimum(params.segment * (number + 1) * (number + 2) // 2, (part.at + part.size)[owner])
        begin, size = (part.begin - part.at)[owner] + low, high - low
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0, True])
        bits = np.zeros(len(many))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            last_ones = (number[order[a:b]] == last[owner[order[a:b]]]) & part.last[owner[order[a:b]]]
            learned = self._nothing(len(refined) // BUCKETS)
            for chosen, learns in ((order[a:b][~last_ones], True), (order[a:b][last_ones], False)):  # nothing follows a text's last segment
                here, of = spread(begin[chosen], size[chosen]), np.repeat(owner[chosen], size[chosen])
                for i in range(0, len(here), params.block):
                    own = here[i : i + params.block]
                    at, code, length = self.code.sorted(np.arange(len(own)), symbol.take(own))
                    own = own.take(at)
                    self._block([c.take(own) for c in contexts], code, length, of[i : i + params.block].take(at), weights, refined, bits, learned if learns else None)
            slope, many, error, curve = learned
            weights += (0.5 * slope / (many + 200)).astype(np.float32)
            refined += (error / (curve + 20)).astype(np.float32)
        return bits / math.log(2)

    @staticmethod
    def _nothing(texts: int):
        """Sums of error times input and of bits by gate, of errors and their spread by bucket."""
        return np.zeros((PREDICTORS, texts * GATES)), np.zeros(texts * GATES), np.zeros(texts * BUCKETS), np.zeros(texts * BUCKETS)

    def _block(self, contexts, code, length, of, weights, refined, bits, learned):
        """Adds to bits what some bytes of a segment cost, and to learned, if there is one, what they teach."""
        sizes, turn, found = looked_up(contexts, code, length, self.bits, self.table)
        inputs = [self.maps[p].take(f, mode="clip") for p, f in enumerate(found)]
        # neighbours mostly add to the same sum; they go to LANES of it in turns, so that none waits for the one before
        lane = np.arange(len(of)) & (LANES - 1)
        gate = joined(of * (GATES * LANES) + lane, sizes)
        gate += gates(found) * np.uint8(LANES)
        weights, refined = np.repeat(weights, LANES, axis=1), np.repeat(refined, LANES)
        z = weights[0].take(gate, mode="clip")
        z *= inputs[0]
        for p in range(1, PREDICTORS):
            w = weights[p].take(gate, mode="clip")
            w *= inputs[p]
            z += w
        bucket = joined(of * (BUCKETS * LANES) + lane, sizes)
        bucket += np.clip(z + np.float32(12), 0, BUCKETS - 1).astype(np.uint8) * np.uint8(LANES)
        z += refined.take(bucket, mode="clip")
        np.clip(z, -16, 16, out=z)
        # the odds against the turn that came, and the chance that it would not
        side = turn.astype(np.float32)
        side *= np.float32(-2)
        side += np.float32(1)
        z *= side
        against = np.exp(z, out=z)
        whole = against + np.float32(1)
        miss = against
        miss /= whole
        total = lambda at, x, n: np.bincount(at, x, n * LANES).reshape(-1, LANES).sum(1)
        np.log(whole, out=whole)
        cost, at = np.zeros(len(of), np.float32), 0
        for n in sizes:
            cost[:n] += whole[at : at + n]
            at += n
        bits += total(of * LANES + lane, cost, len(bits))
        if learned is not None:
            slope, many, error_sum, curve = learned
            side *= miss
            error = np.negative(side, out=side)
            for p in range(PREDICTORS):
                slope[p] += total(gate, error * inputs[p], len(many))
            many += total(gate, None, len(many))
            error_sum += total(bucket, error, len(curve))
            curve += total(bucket, miss - miss * miss, len(curve))


class Cells:
    """Numbers for (state of each predictor, turn): all that maps, start weights and refinement depend on. used: the states of the tables."""

    def __init__(self, *tables: np.ndarray):
        some = np.zeros(STATES, bool)
        some[0] = True
        for table in tables:
            some[table] = True
        self.used = np.flatnonzero(some)
        self.rank = np.zeros(STATES, np.uint8)
        self.rank[self.used] = np.arange(len(self.used))
        self.size = 2 * len(self.used) ** PREDICTORS

    def of(self, part: Slice, code: Code, ranked: np.ndarray, bits: int, params: Params):
        """The numbers of the slice's turns, some at a time; ranked: the table with each state's place in used."""
        contexts, tree = part.contexts(code)
        here, symbol = spread(part.begin, part.size), tree + part.data
        for i in range(0, len(here), params.block):
            own = here[i : i + params.block]
            own, codes, length = code.sorted(own, symbol.take(own))
            _, turn, found = looked_up([c.take(own) for c in contexts], codes, length, bits, ranked)
            number = found[0].astype(np.int32)  # below 2 * STATES ** PREDICTORS
            for f in found[1:]:
                number *= np.int32(len(self.used))
                number += f
            number <<= 1
            number += turn
            yield number.astype(np.int64)

    def read(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, zeros, ones) of the distinct cells, from the numbers and how often each was found."""
        cell, place = np.unique(numbers >> 1, return_inverse=True)
        zero, one = (np.bincount(place[numbers & 1 == t], counts[numbers & 1 == t], len(cell)) for t in (0, 1))
        n = len(self.used)
        return np.stack([self.used[cell // n ** (PREDICTORS - 1 - p) % n] for p in range(PREDICTORS)]), zero, one


def fit(code: Code, bits: int, table: np.ndarray, texts: list[bytes], params: Params) -> Model:
    """The model whose maps, start weights and refinement a list of texts teaches, which the table has not counted."""
    cells = Cells(table)
    ranked = cells.rank[table]
    numbers = [n for part in slices(pa.array(texts, pa.binary()).cast(pa.string()), params) for n in cells.of(part, code, ranked, bits, params)] if texts else []
    found = np.unique(np.concatenate(numbers), return_counts=True) if numbers else (np.zeros(0, np.int64),) * 2
    return fitted(code, bits, table, *cells.read(*found))


def fitted(code: Code, bits: int, table: np.ndarray, found: np.ndarray, zero: np.ndarray, one: np.ndarray) -> Model:
    """Maps, start weights and refinement from how often each cell (a state of each predictor) was followed by a zero and a one.

    Each is a sum over all bits of the texts: a state's map is the logit of how often a one followed it, the weights of a
    gate minimise the cost of its bits by Newton's method, and so does the refinement of each step of the mixed logit.
    """
    step = np.arange(STATES)
    default = np.where(step == 0, 0.0, (step % 32 - 15.5) / 16 * (1 + step // 32)).astype(np.float32)
    model = Model(code, bits, table, np.tile(default, (PREDICTORS, 1)), np.full((PREDICTORS, GATES), 0.4, np.float32), np.zeros(BUCKETS, np.float32))
    if not len(zero):
        return model
    gate = KNOWN[found[0]] * 4 + KNOWN[found[1]]
    for p in range(PREDICTORS):
        prior = 2 / (1 + np.exp(-default))
        model.maps[p] = np.log((np.bincount(found[p], one, STATES) + prior) / (np.bincount(found[p], zero, STATES) + 2 - prior))
    model.maps[:, 0] = 0
    inputs, n = np.stack([model.maps[p].take(found[p]) for p in range(PREDICTORS)]).astype(np.float32), zero + one
    for g in range(GATES):
        own = gate == g
        x, t, m, w = inputs[:, own].astype(np.float64), one[own], n[own], np.full(PREDICTORS, 0.3)
        for _ in range(8):
            chance = 1 / (1 + np.exp(-np.clip(w @ x, -16, 16)))
            slope = x @ (t - m * chance) - 2 * (w - 0.3)
            curve = (x * (m * (chance * (1 - chance) + 1e-6))) @ x.T + 2 * np.eye(PREDICTORS)
            w = np.clip(w + np.linalg.solve(curve, slope), -2, 3)
        model.weights[:, g] = w
    z = (model.weights.T[gate].T * inputs).sum(0)
    bucket = np.clip(z + np.float32(12), 0, BUCKETS - 1).astype(np.int64)
    chance = 1 / (1 + np.exp(-np.clip(z, -16, 16)))
    model.refined[:] = np.bincount(bucket, one - n * chance, BUCKETS) / (np.bincount(bucket, n * chance * (1 - chance), BUCKETS) + 20)
    return model


# --- gathering, joining, scoring -----------------------------------------------------------------------------


def packed_columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of whole numbers of rows, which come to the driver as packed batches, in no order."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for i in (0, 1)], names=["keys", "counts"])

    found = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows.mapInArrow(pack, "keys binary, counts binary").toLocalIterator()]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def totals(docs: DataFrame, tasks: int, size: int, setup) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts), ascending: how often each number below size is found in the texts (key, text).

    setup runs once in a task and returns a function from a batch to arrays of numbers.
    """

    def run(batches):
        numbers, table = setup(), np.zeros(size, np.uint32)
        for batch in batches:
            for found in numbers(batch):
                np.add.at(table, found, np.uint32(1))
        some = np.flatnonzero(table)
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].astype(np.int64))], names=["number", "n"])

    found = docs.select("key", "text").coalesce(tasks).mapInArrow(releasing(run), "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        numbers, counts = packed_columns(found)
    order = np.argsort(numbers)
    return numbers[order], counts[order]


def learned_code(docs: DataFrame, tasks: int, params: Params) -> Code:
    """The code that all training texts (key, text) teach, in two passes: what stands behind two bytes, then behind the most frequent three."""
    small = replace(params, slice_bytes=params.count_bytes)
    grams = totals(docs, tasks, 1 << 24, lambda: lambda batch: map(three_of, slices(batch.column(1), small)))
    starts = own_trees(*grams, params)[2]

    def setup():
        after = after_starts(starts)
        return lambda batch: map(after, slices(batch.column(1), small))

    return Code.made(grams, starts, totals(docs, tasks, max(1, len(starts)) * 256, setup), params)


def learned_start(docs: DataFrame, tasks: int, code: Code, bits: int, table: np.ndarray, halves: list[np.ndarray], params: Params) -> Model:
    """The model, with maps, start weights and refinement that all training texts (key, text) teach, each looked up in the table of the half it is not in."""
    cells = Cells(*halves)
    shared = docs.sparkSession.sparkContext.broadcast((code, cells, [cells.rank[t] for t in halves]))

    def setup():
        keep_memory()
        code, cells, ranked = shared.value

        def numbers(batch):
            own = batch.column(0).to_numpy(zero_copy_only=False) & 1
            for half in (0, 1):
                for part in slices(batch.column(1).filter(pa.array(own == half)), params):
                    yield from cells.of(part, code, ranked[1 - half], bits, params)

        return numbers

    found = totals(docs, tasks, cells.size, setup)
    shared.destroy()
    return fitted(code, bits, table, *cells.read(*found))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a few arrays of ascending keys with their counts, in one."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # which finds what ascends already
    key = key.take(order)
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key.take(first), np.add.reduceat(np.concatenate(counts).take(order), first) if len(first) else np.zeros(0, np.int64)


def gather(docs: DataFrame, code: Code, bits: int, tasks: int, params: Params) -> DataFrame:
    """What the training texts (key, text) teach, as a written table: (kind 0, a word's hash, its count) and, for the texts with an even key
    (kind 1) and an odd one (kind 2), (part, task, counts of turns).

    The halves are read apart, so that a task holds one table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(code)
    small = replace(params, slice_bytes=params.count_bytes)
    names = ["kind", "key", "n", "data"]

    def run(batches):
        keep_memory()
        code, half = shared.value, 0
        table, any_ = np.zeros((1 << bits >> 3, 16), np.uint32), False
        keys, counts, pending, waiting = [], [], [], 0

        def flush():
            found = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.int64),) * 2
            keys.append(found[0])
            counts.append(found[1])
            pending.clear()

        def words():
            n = len(keys[0])
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(keys[0]), pa.array(counts[0]), pa.nulls(n, pa.binary())], names=names)

        for batch in batches:
            if batch.num_rows:
                half = batch.column(0)[0].as_py() & 1
            for s, _, hashes in whole_words(slices(batch.column(1), small)):
                pending.append(hashes)
                waiting += len(hashes)
                count_turns(s, code, table, bits)
                any_ = True
                if waiting >= params.held:
                    flush()
                    waiting = 0
                    if sum(map(len, keys)) >= 2 * params.held:
                        keys[:], counts[:] = ([x] for x in merged(keys, counts))
                        if len(keys[0]) >= params.held:
                            yield words()
                            keys.clear()
                            counts.clear()
        flush()
        keys[:], counts[:] = ([x] for x in merged(keys, counts))
        if len(keys[0]):
            yield words()
        if any_:
            task = TaskContext.get().partitionId()
            for i, part in enumerate(table.reshape(PARTS, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([1 + half], pa.int32()), pa.array([i], pa.int64()), pa.array([task], pa.int64()), pa.array([packed(part)], pa.binary())], names=names)

    each = -(-tasks // 2)
    even, odd = (docs.select("key", "text").filter(F.pmod("key", F.lit(2)) == half).coalesce(each).mapInArrow(releasing(run), "kind int, key long, n long, data binary") for half in (0, 1))
    out = materialize(even.unionByName(odd), "lm-gathered", row_group=16 << 20)
    shared.destroy()
    return out


def packed(counts: np.ndarray) -> bytes:
    """Counts as they travel: most are 0 or small, and what is compressed here needs no room in the executors."""
    return zlib.compress(np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes(), 1)


def add_tables(parts: DataFrame, bits: int, tasks: int) -> list[np.ndarray]:
    """The states of the tables that are the sums of the tasks' parts (kind, key, n: task, data): of all, of kind 1 and of kind 2. First of up to 64 tasks at a time where they are many."""

    def add(rows):
        total, part = {}, None
        for batch in rows.to_batches():
            for kind, part, data in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), batch.column("data"), strict=True):
                got = np.frombuffer(zlib.decompress(data.as_buffer()), "<u4")
                total[kind] = got.astype(np.uint64) if kind not in total else total[kind] + got
        return part, total

    def some(key, rows):
        part, total = add(rows)
        return pa.table({"kind": pa.array(list(total), pa.int32()), "key": pa.array([part], pa.int64()), "n": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([packed(t) for t in total.values()], pa.binary())})

    def all_(key, rows):
        part, total = add(rows)
        none = np.zeros((1 << bits) // PARTS * 2, np.uint64)
        one, two = total.get(1, none), total.get(2, none)
        return pa.table({"key": pa.array([part], pa.int64()), "states": pa.array([b"".join(states(*turns_of(t)).tobytes() for t in (one + two, one, two))], pa.binary())})

    # few rows of up to 128 kB at a time
    with settings(parts.sparkSession, spark__sql__parquet__columnarReaderBatchSize="16"):
        return _summed(parts, bits, tasks, some, all_)


def _summed(parts: DataFrame, bits: int, tasks: int, some, all_) -> list[np.ndarray]:
    while tasks > 64:
        parts = parts.withColumn("n", F.floor(F.col("n") / 64)).groupBy("kind", "key", "n").applyInArrow(some, "kind int, key long, n long, data binary")
        tasks = -(-tasks // 64)
    out = np.zeros((3, PARTS, (1 << bits) // PARTS), np.uint8)
    for r in parts.groupBy("key").applyInArrow(all_, "key long, states binary").toLocalIterator():
        out[:, r["key"]] = np.frombuffer(r["states"], np.uint8).reshape(3, -1)
    return list(out.reshape(3, -1))


class Lookup:
    """Places of 64-bit keys among sorted ones, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.view(np.uint64))
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        wanted = wanted.view(np.uint64)
        place, at = np.full(len(wanted), -1), self.start[(wanted >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(at < len(self.keys))
        at = at[todo]
        while len(todo):
            found = self.keys[at]
            hit = found == wanted[todo]
            place[todo[hit]] = at[hit]
            on = (found < wanted[todo]) & (at + 1 < len(self.keys))
            todo, at = todo[on], at[on] + 1
        return place


def frequent_words(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in unsigned order, counts): all words (key, c) from a frequency on, the lowest for which there are no more than head."""
    step = F.floor(F.log2("c") * 16).cast("int")  # a row per step of the scale
    room, least = head, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("many")).collect(), key=lambda r: -r["step"]):
        room -= r["many"]
        if room < 0:
            break
        least = r["step"]

    keys, counts = packed_columns(words.filter(F.lit(least is not None) & (step >= F.lit(least or 0))).select("key", "c"))
    order = np.argsort(keys.view(np.uint64))
    return keys[order], counts[order]


def train(docs: DataFrame, params: Params) -> tuple[Model, DataFrame]:
    """The bit model of the training texts (key, text), and their words as a written table (key: hash, c: count)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(params.most_bits, max(12, (size // params.slot_bytes).bit_length()))
    tasks = max(1, -(-size // params.task_bytes))
    with small_reads(docs.sparkSession):
        code = learned_code(docs, tasks, params)
        found = gather(docs, code, bits, tasks, params)
        table, *halves = add_tables(found.filter("kind > 0"), bits, tasks + 1)
        words = materialize(found.filter("kind = 0").select("key", "n").repartition("key").groupBy("key").agg(F.sum("n").alias("c")), "lm-words")
        drop(docs.sparkSession, found)
        return learned_start(docs, tasks, code, bits, table, halves, params), words


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, one row per document.

    Null and empty texts consist of their end. Null ids count as empty text for the fold. Without training
    documents the base score is 0 a token and the bit model has no preference. score adds up the logarithms of a
    proper distribution over all texts, rows alike have the same, and the order of a text's words matters.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learning = docs.filter(id_modulus("doc_id", FOLDS) != HELD_OUT).select(F.xxhash64("text").alias("key"), "text")
    ends = learning.count()
    model, words = train(learning, params)
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    shared = docs.sparkSession.sparkContext.broadcast((model, *frequent_words(words, params.head)))

    def run(batches):
        keep_memory()
        model, keys, counts = shared.value
        find, value = Lookup(keys), np.log10(counts + 0.5)
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                m = part.num_rows
                tokens, known, size = np.zeros((3, m), np.int64)
                base, bits = np.zeros((2, m))
                rare, owner, state = [], [], None
                for s, row, hashes in whole_words(slices(part.column(1), params)):
                    place = find(hashes)
                    hit = place >= 0
                    tokens += np.bincount(row, minlength=m)
                    known += np.bincount(row[hit], minlength=m)
                    base += np.bincount(row[hit], value[place[hit]], m)
                    rare.append(hashes[~hit])
                    owner.append(row[~hit])
                    if s.at[0] == 0:
                        state = model.start(len(s.row))
                    bits[s.row] += model.cost(s, *state, params)
                    size[s.row] += s.size
                ends_at = np.r_[0, np.cumsum(np.bincount(np.concatenate(owner), minlength=m))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(rows, rows + m)), *map(pa.array, (tokens + 1, size, known, base, bits)), lists], names=names)
                rows += m

    names = ["doc_id", "uid", "n_tokens", "size", "head_known", "head_base", "bits", "rare"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    flat = docs.mapInArrow(releasing(run), f"doc_id {kind}, uid long, n_tokens long, size long, head_known long, head_base double, bits double, rare array<long>")
    with small_reads(docs.sparkSession):
        scored = materialize(flat, "lm-scores")  # the uid is that of this table
    shared.destroy()
    rare = scored.select("uid", F.explode("rare").alias("key")).join(words, "key")
    rare = rare.groupBy("uid").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 0.5) - math.log10(0.5)).alias("base"))
    out = scored.join(rare, "uid", "left")
    unit, none = math.log10(n + 0.5 * (v + 1)), math.log10(0.5)
    base = F.col("head_base") + F.size("rare") * none + F.coalesce("base", F.lit(0.0)) + math.log10(ends + 0.5) - F.col("n_tokens") * unit
    return out.select(
        "doc_id",
        (id_modulus("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.col("size")).alias("bits_per_byte"),
    )
