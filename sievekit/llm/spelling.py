"""Spelling variants: words one edit apart, found by products of letter-count matrices.

Words of one length, and within it of the same numbers of letters of each class, form a block. One edit moves these
numbers by one letter at most, so a block meets itself, its neighbours of the same length (a letter of one class for
one of another) and those a letter longer. Where two blocks meet, their words' letter counts are two NumPy
matrices, whose product gives all squared distances between counts: an inserted or deleted letter makes 1, a replaced one 2. Pairs at 1 or 2
are verified letter by letter. Large blocks are cut into chunks, and every pair of chunks meets in a task of its
own, so that no task holds more than two chunks. Each meeting passes on a row per word, not per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import LOWER, UPPER, drop, materialize


@dataclass(frozen=True)
class Params:
    """A word: least_length code points or more, least_count occurrences or more. drop_one_in: a run whose crc32 this divides loses
    a letter. ratio: a form occurs so many times as often. classes: of letters, that cut the blocks of a length. chunk, letters: about the most words and letters of a side of a product."""

    least_length: int = 6
    least_count: int = 5
    drop_one_in: int = 199
    ratio: int = 5
    classes: int = 3
    chunk: int = 2048
    letters: int = 1_000_000


#: Letters of a word after A-Z are lower-cased.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
_PLACE = np.zeros(0x100, np.int64)
_PLACE[[ord(c) for c in LETTERS]] = range(len(LETTERS))


def word_counts(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n) of all words of the documents' whole texts that occur often enough. A null text has none; a null id counts as empty text."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{params.least_length},}}"), F.lit(0))  # shorter runs never become words
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.transform(runs, lambda r: F.translate(r, UPPER, LOWER))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = own.withColumn("h", h).select(F.when(F.col("h") % params.drop_one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= params.least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= params.least_count)


def _block(params: Params) -> Column:
    """The numbers of letters of each class; letters are dealt to the classes in turn."""
    of = lambda c: F.length("word") - F.length(F.translate("word", LETTERS[c :: params.classes], ""))
    return F.array(*(of(c) for c in range(params.classes)))


def _directions(params: Params) -> list[list[int]]:
    """Where a block meets another, each pair of blocks once: itself, one letter more, one letter of an earlier class for one of a later."""
    n = params.classes
    one = lambda *moves: [sum(d for c, d in moves if c == k) for k in range(n)]
    return [one(), *(one((c, 1)) for c in range(n)), *(one((a, 1), (b, -1)) for a in range(n) for b in range(a + 1, n))]


CELL = ["a", "i", "b", "j"]


def meetings(words: DataFrame, params: Params) -> DataFrame:
    """(a, i, b, j, side, word, n): the words of chunk i of block a (side 0) and of chunk j of block b (side 1) for all chunks that meet; a chunk that meets itself has side 0 alone.

    Blocks are few (their number depends on the words' lengths, not on their count), their meetings a fixed number of times more.
    """
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / params.chunk, F.sum(F.length("word")) / params.letters))
    sizes = words.groupBy("block").agg(chunks.cast("int").alias("chunks"))
    sizes = materialize(sizes.withColumn("at", F.monotonically_increasing_id()), "spelling-blocks")
    moves = F.array(*(F.array(*map(F.lit, d)) for d in _directions(params)))
    there = sizes.select(F.col("at").alias("a"), "chunks", F.explode(F.transform(moves, lambda d: F.zip_with("block", d, lambda x, y: x + y))).alias("block"))
    pairs = there.join(sizes.select("block", F.col("at").alias("b"), F.col("chunks").alias("more")), "block")
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cells = pairs.select("a", "b", F.explode(count("chunks")).alias("i"), "more").select("a", "i", "b", F.explode(count("more")).alias("j")).filter("a <> b OR i <= j")
    end = lambda side, at, chunk: F.struct(F.lit(side).alias("side"), F.col(at).alias("at"), F.col(chunk).alias("chunk"))
    ends = F.when(F.expr("a = b AND i = j"), F.array(end(0, "a", "i"))).otherwise(F.array(end(0, "a", "i"), end(1, "b", "j")))
    cells = cells.select(*CELL, F.explode(ends).alias("e")).select(*CELL, "e.side", "e.at", "e.chunk")
    placed = words.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    return placed.join(cells, ["at", "chunk"]).select(*CELL, "side", "word", "n")


def codes(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row each."""
    return _PLACE[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(len(words), -1)


def letter_counts(coded: np.ndarray) -> np.ndarray:
    """In numbers that hold the squares exactly."""
    rows = np.arange(len(coded))[:, None] * len(LETTERS)
    kind = np.float32 if coded.shape[1] <= 2000 else np.float64
    return np.bincount((rows + coded).ravel(), minlength=len(coded) * len(LETTERS)).reshape(len(coded), -1).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two code matrices, of one length or b a letter longer, are exactly one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] == 0:
        return np.ones(len(a), bool)
    front = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of words of a and b one edit apart; b is of a's length or a letter longer. same: a meets itself, i < j."""
    left, right = codes(a), codes(b)
    x, y = letter_counts(left), letter_counts(right)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    i, j = np.nonzero((squared <= 2) & (squared > 0))
    if same:
        i, j = i[i < j], j[i < j]
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(i), 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        ok = one_edit(left[p], right[q])
        found.append(np.stack([p[ok], q[ok]], axis=1))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _best(words: list[str], n: list[int], others: list[str], m: list[int], i: np.ndarray, j: np.ndarray):
    """(word, near words, the most frequent of them, ties to the smallest, and its count) for each word with a near one."""
    many: dict[int, list] = {}
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        key = (-m[q], others[q])
        own = many.setdefault(p, [0, key])
        own[0] += 1
        own[1] = min(own[1], key)
    return [(words[p], c, key[1], -key[0]) for p, (c, key) in many.items()]


def neighbours(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n_near, best, best_n) of each word of (word, n) that has near words: one inserted, deleted or replaced code point."""
    blocked = materialize(words.withColumn("block", _block(params)), "spelling-words")

    def search(batches):
        key, held = None, []

        def out():
            """The meeting whose rows are held."""
            side = np.concatenate([h[0] for h in held])
            text, count = [w for h in held for w in h[1]], np.concatenate([h[2] for h in held]).tolist()
            cut = int((side == 0).sum())
            alone = key[:2] == key[2:]  # else a side may be empty
            a, n = text[:cut], count[:cut]
            b, m = (a, n) if alone else (text[cut:], count[cut:])
            i, j = near(a, b, alone) if a and b else ([], [])
            return _best(a, n, b, m, i, j) + _best(b, m, a, n, j, i) if len(i) else []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "c", "best", "best_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            starts = np.r_[0, 1 + np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)), len(cell)].tolist()
            side, n, rows = batch.column(4).to_numpy(), batch.column(6).to_numpy(), []
            for low, high in zip(starts, starts[1:]):
                own = cell[low].tolist()
                if own != key and held:
                    rows += out()
                    held = []
                key = own
                held.append((side[low:high], batch.column(5).slice(low, high - low).to_pylist(), n[low:high]))
            yield batch_of(rows)
        if held:
            yield batch_of(out())

    dealt = meetings(blocked, params).repartition(*CELL).sortWithinPartitions(*CELL, "side")
    found = dealt.mapInArrow(search, "word string, c long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n; words without repeats).

    form: the most frequent near word (ties: the smallest), where it occurs at least ratio times as often. root: the last
    of the forms of forms. Each form occurs more often than its word, so chains are short; each round of joins doubles
    the steps followed.
    """
    words = materialize(words.select("word", "n"), "spelling-counts")
    close = neighbours(words, params).withColumnRenamed("word", "_word")
    joined = words.join(close, F.col("word") == F.col("_word"), "left")
    fits = F.col("best_n") >= params.ratio * F.col("n")
    named = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = materialize(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = materialize(roots.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        drop(words.sparkSession, roots)
        roots = step.select("word", "root")
        if step.filter("moved").limit(1).count() == 0:
            break
    ends = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return named.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
