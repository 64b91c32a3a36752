"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is compressed with
each, in pieces, so that a long text leans on the dictionary throughout and not on itself; the difference of the two
summed sizes over their sum tells which kind it resembles, and a logistic calibration turns it into the probability
of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import id_modulus, map_rows

#: Rows with this remainder of crc32(id) mod FOLDS are held out and give no label.
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Params:
    """max_rows: labelled rows of each class that are used at most, the first in order of a hash of the id.
    max_bytes: a labelled text above this size is not used for fitting (it is scored like any other), so the sample has
    2 * max_rows * max_bytes bytes at most. piece: bytes that are compressed at a time."""

    max_rows: int = 3000
    max_bytes: int = 20_000
    piece: int = 8192
    dict_bytes: int = 64 << 10
    level: int = 3


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    trained: tuple[bool, bool]
    slope: float
    offset: float
    level: int
    piece: int

    def scorer(self):
        kinds = [zstandard.DICT_TYPE_FULLDICT if t else zstandard.DICT_TYPE_RAWCONTENT for t in self.trained]
        dicts = [zstandard.ZstdCompressionDict(d, dict_type=k) if d else None for d, k in zip((self.bad, self.good), kinds, strict=True)]
        for d in dicts:
            if d is not None:
                d.precompute_compress(level=self.level)
        own = [zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **({} if d is None else {"dict_data": d})) for d in dicts]

        def difference(text: str | None) -> float:
            data = (text or "").encode("utf-8", "replace")
            pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)] or [b""]
            bad, good = (sum(len(c.compress(p)) for p in pieces) for c in own)
            return (bad - good) / (bad + good)

        return difference

    def probability(self, difference):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(difference, float) + self.offset, -40, 40)))


def _dictionary(texts: list[bytes], size: int) -> tuple[bytes, bool]:
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes(), True
    except (zstandard.ZstdError, ValueError):  # too few samples to train: their own bytes serve as the dictionary
        share = max(256, size // max(1, len(texts)))
        return b"".join(t[:share] for t in texts)[-size:], False


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a weak pull of the slope to 0 and pseudo-counts at the class shares."""
    w = np.zeros(2)
    a = np.column_stack([x * 10, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + np.array([1e-2, 1e-3]) * w
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] * 10), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Learn from labelled rows outside the held-out fold.

    The sample is bounded by params and chosen by a hash of the id, so it does not depend on partitions.
    Half of it makes the dictionaries, the other half the calibration. Ids or labels that are null, and
    labels other than 0 and 1, teach nothing; an id with both labels teaches both. Without usable labels every score is 0.5; with one class the
    score is that class's share with a pseudo-count.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_modulus("doc_id", FOLDS) != HELD_OUT)).distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = usable.filter("quality = 0").orderBy(*order).limit(params.max_rows).unionByName(usable.filter("quality = 1").orderBy(*order).limit(params.max_rows))
    # at most 2 * max_rows ids, so the broadcast is bounded; repeated documents count once
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= params.max_bytes)
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()
    data = [(r["text"].encode("utf-8", "replace"), r["quality"]) for r in rows]
    by = {y: [t for t, q in data if q == y] for y in (0, 1)}
    if not data:
        return Model(b"", b"", (False, False), 0.0, 0.0, params.level, params.piece)
    if not by[0] or not by[1]:
        share = (len(by[1]) + 0.5) / (len(data) + 1)
        return Model(b"", b"", (False, False), 0.0, float(np.log(share / (1 - share))), params.level, params.piece)
    made, held = {}, []
    for y in (0, 1):
        made[y] = _dictionary(by[y][::2], params.dict_bytes)
        held += [(t, y) for t in (by[y][1::2] or by[y])]
    model = Model(made[0][0], made[1][0], (made[0][1], made[1][1]), 0.0, 0.0, params.level, params.piece)
    difference = model.scorer()
    x = np.array([difference(t.decode("utf-8", "replace")) for t, _ in held])
    slope, offset = _logistic(x, np.array([y for _, y in held], float))
    return Model(model.bad, model.good, model.trained, slope, offset, params.level, params.piece)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document, or its columns in keep), ``difference`` and ``score`` for each document; null and empty texts have a score like any other."""

    def setup():
        difference = model.scorer()

        def run(texts):
            found = [difference(t) for t in texts]
            return [found, model.probability(found).tolist()]

        return run

    return map_rows(docs, ["text"], setup, "difference double, score double", keep)


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted for each document, one row per input row (repeats included)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, params), ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), (id_modulus(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference"
    )


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents predicted to be good, with their own columns."""
    return score(docs, fit(docs, labels, params)).filter("score >= 0.5").select("row.*")
