"""The exact nearest rows of a set, with blocks ruled out by the triangle inequality.

Some rows of the set are pivots. Every row of the set belongs to its nearest pivot's cell, which has a radius. A row knows
its distances to all pivots, so a cell's rows are at least that less the radius away, and at most that plus the
radius. First each row meets the cell that promises the nearest rows; what it finds there, and the cells' most
distances, bound its k-th distance. Then it meets the cells alone that can hold something nearer. Rows meet cells in blocks,
as matrix products.

Angles and products are put into a space where this holds: unit vectors for cosines (up to sign for absolute
ones), and one more component for products, that makes all rows of the set equally long. A vector of zeros, which has no
direction, meets every cell and has a cell of its own that all meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import chance
from sievekit.functions.arrays import NUMPY_METRICS, norms, over, squared
from sievekit.operators import blocks
from sievekit.sources.tables import cut

#: Most pivots (each task holds them), rows of a block, and the slack that rounding needs.
PIVOTS, ROWS, SLACK = 256, 1000, 1e-6
GEOMETRIES = ("l2", "neg_cos", "abs_cos", "mean_dot")
_ZERO = -1


def _place(x: np.ndarray, metric: str, longest: float, chosen: bool) -> np.ndarray:
    """The rows in the space of the metric. longest: the largest norm of the set, for products."""
    if metric == "l2":
        return x
    if metric == "mean_dot":
        more = np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0)) if chosen else np.zeros(len(x))
        return np.concatenate([x, more[:, None]], axis=1)
    return over(x, norms(x)[:, None])


def _far(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances in that space."""
    if metric == "abs_cos":  # lines through the origin: the nearer of y and -y
        return np.sqrt(np.maximum(2 - 2 * np.abs(x @ y.T), 0))
    return np.sqrt(squared(x, y))


def _value(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """What is ranked: the metric's rounded distance, the negative product for mean_dot."""
    out = NUMPY_METRICS[metric](x, y)
    return -out if metric == "mean_dot" else out


class Cells:
    """What every task knows of the set: pivots, and each cell's rows, radius and blocks."""

    def __init__(self, pivots: np.ndarray, metric: str, longest: float):
        self.metric, self.longest = metric, longest
        self.raw = pivots
        self.pivots = _place(pivots, metric, longest, True)
        self.rows = np.zeros(len(pivots) + 1, np.int64)  # the last cell is that of zeros
        self.radius = np.zeros(len(pivots) + 1)
        self.blocks = np.zeros(len(pivots) + 1, np.int64)

    def distances(self, x: np.ndarray, chosen: bool = False) -> np.ndarray:
        return _far(_place(x, self.metric, self.longest, chosen), self.pivots, self.metric)

    def zero(self, x: np.ndarray) -> np.ndarray:
        return (norms(x) == 0) if self.metric in ("neg_cos", "abs_cos") else np.zeros(len(x), bool)

    def bounds(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: the least distance a cell's rows can have (rows x cells), the first cell to meet, and what k rows are surely within."""
        d = self.distances(x)
        full = self.rows[:-1] > 0
        low = np.where(full, d - self.radius[:-1], math.inf)
        high = np.where(full, d + self.radius[:-1], math.inf)
        first = low.argmin(axis=1)
        order = high.argsort(axis=1)
        many = self.rows[:-1][order].cumsum(axis=1)
        at = np.minimum((many < k).sum(axis=1), order.shape[1] - 1)
        sure = np.where(many[:, -1] >= k, np.take_along_axis(high, order, 1)[np.arange(len(x)), at], math.inf)
        zero = self.zero(x)
        low[zero] = np.where(full, 0.0, math.inf)
        sure[zero] = math.inf
        return low, first, sure

    def open(self, x: np.ndarray, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows x cells: whether a cell besides the first may hold something within a row's bound. That of zeros always may."""
        low = np.where(self.zero(x)[:, None], 0.0, self.distances(x) - self.radius[:-1])
        out = np.concatenate([low <= (bound * (1 + SLACK) + SLACK)[:, None], np.ones((len(x), 1), bool)], axis=1)
        out[np.arange(len(x)), first] = False
        return out & (self.rows > 0)


def _cells(chosen: DataFrame, metric: str, pivots: int, rows: int) -> tuple[DataFrame, Cells]:
    """The set (sample_id, vec), packed by cell, and what is known of the cells."""
    count = chosen.count()
    few = min(pivots, max(1, math.isqrt(count)))
    usable = chosen if metric not in ("neg_cos", "abs_cos") else chosen.filter(F.exists("vec", lambda x: x != 0))
    marks = [r["vec"] for r in usable.orderBy(*chance.order(0)).limit(few).select("vec").collect()]  # PIVOTS at most
    longest = chosen.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    marks = marks or [[0.0] * len(chosen.first()["vec"])]  # all are zeros
    cells = Cells(np.array(marks, float), metric, math.sqrt(longest))
    shared = chosen.sparkSession.sparkContext.broadcast(cells)

    def place(incoming):
        for batch in incoming:
            if batch.num_rows:
                x = blocks.matrix(batch.column(1))
                d = shared.value.distances(x, True)
                cell = np.where(shared.value.zero(x), _ZERO, d.argmin(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(np.where(cell == _ZERO, 0.0, d.min(axis=1)))], names=["sample_id", "vec", "cell", "away"])

    placed = cut(chosen.mapInArrow(place, "sample_id long, vec array<double>, cell long, away double"))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # a row per pivot
        cells.rows[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"] * (1 + SLACK) + SLACK
    cells.blocks[:] = -(-cells.rows // rows)
    return blocks.pack(placed, {"sample_id": "i8"}, ["cell"], rows), cells


def _first(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """queries (sample_id, vec) with the first cell to meet and the bound, written."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(incoming):
        for batch in incoming:
            if batch.num_rows:
                _, first, sure = shared.value.bounds(blocks.matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int64)), pa.array(sure)], names=["sample_id", "vec", "cell", "bound"])

    return cut(queries.mapInArrow(run, "sample_id long, vec array<double>, cell long, bound double"))


class _Best:
    """The k nearest so far of the rows of a block, those within a limit for each row."""

    def __init__(self, ids: np.ndarray, k: int, limit: np.ndarray):
        self.ids, self.k, self.limit = ids, k, np.array(limit)
        self.rows, self.near, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        """far: the values of these rows with these rows of the set."""
        limit = self.limit[rows]
        bounded = np.isfinite(limit).all()
        i, j = np.nonzero(far <= limit[:, None]) if bounded else _smallest(far, near, self.k)
        self.new.append((rows[i], near[j], far[i, j]))
        if not bounded or sum(len(i) for i, _, _ in self.new) > 4 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> None:
        rows, near, dist = (np.concatenate(x) for x in zip((self.rows, self.near, self.dist), *self.new, strict=True))
        order = np.lexsort((near, dist, rows))
        rows, near, dist = rows[order], near[order], dist[order]
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
        last = place == self.k - 1
        self.limit[rows[last]] = np.minimum(self.limit[rows[last]], dist[last])
        kept = place < self.k
        self.rows, self.near, self.dist, self.new = rows[kept], near[kept], dist[kept], []

    def batches(self):
        self.settle()
        yield from blocks.batches([self.ids[self.rows], self.near, self.dist], ["sample_id", "near_id", "dist"])


_FOUND = "sample_id long, near_id long, dist double"


def _met(asked: DataFrame, packed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(sample_id, near_id, dist), written: the k nearest of each asked row in each stripe of its cell; asked: packed by cell."""
    metric = cells.metric

    def work(_, a, b):
        for x in a:
            best = _Best(x["sample_id"], k, np.full(len(x["vec"]), math.inf))
            for y in b:
                best.add(np.arange(len(x["vec"])), y["sample_id"], _value(x["vec"], y["vec"], metric))
            yield from best.batches()

    return cut(blocks.tiles(asked, packed, {"sample_id": "i8"}, work, _FOUND, ["cell"]))


def _met_open(asked: DataFrame, packed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(sample_id, near_id, dist), written: the k nearest of each asked row in each stripe's cells that are open to it, as far as they are no farther than its kth; asked: packed by first cell, with bound and kth."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def work(_, a, b):
        known = shared.value
        for x in a:
            open_ = known.open(x["vec"], x["bound"], np.full(len(x["vec"]), x["cell"]))
            best = _Best(x["sample_id"], k, x["kth"])
            for y in b:
                rows = np.flatnonzero(open_[:, y["cell"]])
                if len(rows):
                    best.add(rows, y["sample_id"], _value(x["vec"] if len(rows) == len(x["vec"]) else x["vec"][rows], y["vec"], known.metric))
            yield from best.batches()

    columns = {"sample_id": "i8", "bound": "f8", "kth": "f8"}
    of = packed.withColumn("bound", F.lit(None).cast("binary")).withColumn("kth", F.lit(None).cast("binary"))
    out = cut(blocks.tiles(asked, of, columns, work, _FOUND, also=["cell"]))
    shared.destroy()
    return out


def _smallest(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k smallest of each row, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    far = far[:, order]
    if k == 1:
        return np.arange(len(far)), order[far.argmin(axis=1)]
    k = min(k, far.shape[1])
    last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    i, j = np.nonzero(far <= last)
    rank = np.lexsort((j, far[i, j], i))
    i, j = i[rank], j[rank]
    begin = np.r_[True, i[1:] != i[:-1]]
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(begin, np.arange(len(i)), 0))
    return i[place < k], order[j[place < k]]


def _best(found: DataFrame, k: int) -> DataFrame:
    if k == 1:
        return found.groupBy("sample_id").agg(F.min(F.struct("dist", "near_id")).alias("b")).select("sample_id", "b.near_id", "b.dist")
    order = Window.partitionBy("sample_id").orderBy("dist", "near_id")
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def _rest(bounded: DataFrame, cells: Cells) -> DataFrame:
    """The rows (sample_id, vec, cell, bound, kth) that cells besides the first may still hold one of the k nearest of, and pairs, the rows of these cells; written."""
    shared = bounded.sparkSession.sparkContext.broadcast(cells)

    def run(incoming):
        known = shared.value
        for batch in incoming:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                open_ = known.open(blocks.matrix(part.column(1)), part.column(3).to_numpy(zero_copy_only=False), part.column(2).to_numpy())
                pairs = open_ @ known.rows
                kept = pa.array(np.flatnonzero(pairs))
                yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in part.columns), pa.array(pairs[pairs > 0])], names=[*part.schema.names, "pairs"])

    return cut(bounded.mapInArrow(run, "sample_id long, vec array<double>, cell long, bound double, kth double, pairs long"))


def _bound_of(dist, metric: str, longest: float, norm):
    """The distance in the metric's space of a k-th value (rounded to nine decimals, so a little is added)."""
    d = dist + 1e-8
    if metric == "l2":
        return d
    if metric == "neg_cos":
        return F.sqrt(F.greatest(2 + 2 * d, F.lit(0.0)))
    if metric == "abs_cos":
        return F.sqrt(F.greatest(2 * d, F.lit(0.0)))
    return F.sqrt(F.greatest(norm * norm + longest * longest + 2 * d * F.size("vec"), F.lit(0.0)))  # d is the negative product over the width


def nearest(queries: DataFrame, chosen: DataFrame, k: int = 1, metric: str = "l2", pivots: int = PIVOTS, rows: int = ROWS, work: dict | None = None) -> DataFrame:
    """(sample_id, near_id, dist): the k rows of chosen nearest each query row (both sample_id, vec), fewer where there are fewer; ties to the smaller id.

    metric: one of GEOMETRIES; for mean_dot dist is the negative product over the width. Ids of queries must not repeat; null
    vectors take no part. work: takes ``pairs``, the products of rows that were made, and ``all``, those of every pair.
    """
    if metric not in GEOMETRIES:
        raise ValueError(f"no way to rule out blocks under {metric}")
    asked = queries.filter(F.col("vec").isNotNull()).select(F.col("sample_id").cast("long").alias("sample_id"), F.col("vec").cast("array<double>").alias("vec"))
    of = cut(chosen.filter(F.col("vec").isNotNull()).select(F.col("sample_id").cast("long").alias("sample_id"), F.col("vec").cast("array<double>").alias("vec")))
    if of.limit(1).count() == 0:
        return asked.sparkSession.createDataFrame([], "sample_id long, near_id long, dist double")
    packed, cells = _cells(of, metric, pivots, rows)
    begun = _first(asked, cells, k)
    first = blocks.pack(begun, {"sample_id": "i8"}, ["cell"], rows)
    near = _met(first, packed, cells, k)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    kth = _best(near, k).groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("far")).filter(F.col("c") >= k)
    joined = begun.join(kth.select(F.col("sample_id").alias("__id"), "far"), F.col("sample_id") == F.col("__id"), "left")
    better = F.when(F.col("far").isNotNull(), F.least("bound", _bound_of(F.col("far"), metric, cells.longest, norm))).otherwise(F.col("bound"))
    if metric in ("neg_cos", "abs_cos"):
        better = F.when(norm == 0, F.lit(math.inf)).otherwise(better)
    rest = _rest(joined.select("sample_id", "vec", "cell", better.alias("bound"), F.coalesce("far", F.lit(math.inf)).alias("kth")), cells)
    if work is not None:
        size = sum(r["n"] * int(cells.rows[r["cell"]]) for r in first.groupBy("cell").agg(F.sum("n").alias("n")).collect())
        work["pairs"], work["all"] = size + (rest.agg(F.sum("pairs")).first()[0] or 0), asked.count() * int(cells.rows.sum())
    open_ = blocks.pack(rest, {"sample_id": "i8", "bound": "f8", "kth": "f8"}, ["cell"], rows)
    return _best(near.unionByName(_met_open(open_, packed, cells, k)), k)
