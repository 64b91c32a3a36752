"""Greedy facility location: the rows that best stand for their class.

The similarity of two rows of a class is the class' largest squared distance less theirs; across classes it is
0. Each pick adds most to the sum of every row's best similarity to a pick. A class of at most CHUNK rows is
solved by one task. A larger one is solved lazily: gains only fall as picks are made, so a gain that was measured once
bounds the gain of now, and only candidates whose bound is at the top are measured again. The first bounds are exact gains
and need sums over the class alone; the class' rows stay packed in blocks that are written once. Where bounds are too high to settle a
pick (the first pick takes most of all gains), all gains of the class are measured anew at once, in tiles of blocks, instead of
some candidates a job. Both ways are the plain greedy, so the size of a class changes no pick.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import chance
from sievekit.operators import blocks
from sievekit.operators.represent import batch_mean
from sievekit.sources.tables import cut

#: Largest class of one task; candidates whose bounds are on the driver at once, and those of them measured in a pick's first jobs; candidates measured
#: for a pick after which all are; picks after which rows keep their best similarity.
CHUNK, POOL, MEASURED, RENEW, FOLD = 2000, 1024, 32, 256, 16
_PICKS = "label int, sample_id long, step int, gain double"


def greedy(x: np.ndarray, n: int) -> Iterator[tuple[int, float]]:
    """(row, gain) of n picks: each adds most to the sum of every row's best similarity; ties to the first row."""
    sq = (x * x).sum(1)
    d2 = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
    sim = d2.max() - d2
    best, free = np.zeros(len(x)), np.ones(len(x), bool)
    for _ in range(min(n, len(x))):
        gains = np.round(np.maximum(sim - best[:, None], 0).sum(0), 9)
        gains[~free] = -1
        at = int(gains.argmax())
        yield at, float(gains[at])
        free[at] = False
        best = np.maximum(best, sim[:, at])


def _whole(df: DataFrame, goals: DataFrame) -> DataFrame:
    """The picks of classes that fit a task."""

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id", ignore_index=True)
        found = list(greedy(np.stack(part["vec"].to_numpy()), int(part["budget"].iloc[0])))
        out = part.iloc[[i for i, _ in found]][["label", "sample_id"]].copy()
        out["step"], out["gain"] = range(1, len(found) + 1), [g for _, g in found]
        return out

    return df.join(F.broadcast(goals), "label").groupBy("label").applyInPandas(pick, _PICKS)


# --- large classes -----------------------------------------------------------------------------------------------


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out, product = (x * x).sum(1)[:, None] + (y * y).sum(1), x @ y.T
    product *= 2
    out -= product
    return np.maximum(out, 0, out=out)


def _sums(packed: DataFrame) -> dict[int, tuple[int, float, np.ndarray]]:
    """By class: its rows, the sum of their squared norms and the sum of their vectors. Each task adds up its blocks first."""

    def add(incoming):
        sums: dict = {}
        for batch in incoming:
            for row in batch.to_pylist():
                x = blocks.unpack(row, {})["vec"]
                n, square, total = sums.get(row["label"], (0, 0.0, 0.0))
                sums[row["label"]] = n + len(x), square + float((x * x).sum()), total + x.sum(0)
        yield pa.RecordBatch.from_pylist([{"label": k, "x": [float(n), s, *t]} for k, (n, s, t) in sums.items()], schema=pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))]))

    cells = packed.mapInArrow(add, "label int, x array<double>").select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    out: dict = {}
    for r in cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).collect():  # a row per class
        n, square, *total = (c["x"] for c in r["c"])
        out[r["label"]] = int(n), square, np.array(total)
    return out


def _diameters(packed: DataFrame, sums: dict) -> dict[int, float]:
    """The largest squared distance of two rows of each class.

    Two rows are at most the sum of their distances to the mean apart. A first pass finds the row farthest from the
    mean, a second the row farthest from that one; rows that can't be farther than this from any row don't meet others.
    """
    means = {y: t / n for y, (n, _, t) in sums.items()}
    far = packed.sparkSession.sparkContext.broadcast(means)

    def ends(incoming):
        for batch in incoming:
            for row in batch.to_pylist():
                x = blocks.unpack(row, {})["vec"]
                d = _squared(x, far.value[row["label"]][None, :])[:, 0]
                at = int(d.argmax())
                yield pa.RecordBatch.from_pylist([{"label": row["label"], "block": row["block"], "radius": float(np.sqrt(d[at])), "end": x[at].tolist()}], schema=pa.schema([("label", pa.int32()), ("block", pa.int64()), ("radius", pa.float64()), ("end", pa.list_(pa.float64()))]))

    radii = cut(packed.mapInArrow(ends, "label int, block long, radius double, end array<double>"))
    tips = {r["label"]: np.array(r["end"]) for r in radii.groupBy("label").agg(F.max_by("end", "radius").alias("end")).collect()}
    tip = packed.sparkSession.sparkContext.broadcast(tips)

    def reach(incoming):
        for batch in incoming:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"label": row["label"], "d": float(_squared(blocks.unpack(row, {})["vec"], tip.value[row["label"]][None, :]).max())}], schema=pa.schema([("label", pa.int32()), ("d", pa.float64())]))

    low = cut(packed.mapInArrow(reach, "label int, d double").groupBy("label").agg(F.max("d").alias("d")))  # a row per class
    widest_radius = {r["label"]: r["r"] for r in radii.groupBy("label").agg(F.max("radius").alias("r")).collect()}
    known = packed.sparkSession.sparkContext.broadcast({r["label"]: (widest_radius[r["label"]], r["d"]) for r in low.collect()})

    def outer(incoming):
        for batch in incoming:
            for row in batch.to_pylist():
                x = blocks.unpack(row, {})["vec"]
                widest, least = known.value[row["label"]]
                reach = np.sqrt(_squared(x, far.value[row["label"]][None, :])[:, 0]) + widest
                x = x[reach * reach * (1 + 1e-9) > least]
                if len(x):
                    yield pa.RecordBatch.from_pylist([{"label": row["label"], "block": row["block"], "n": len(x), "vec": x.tobytes()}], schema=pa.schema([("label", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("vec", pa.binary())]))

    def widest(key, a, b):
        top = max(float(_squared(own["vec"], other["vec"]).max()) for own, other, _ in blocks.couples(a, b))
        yield pa.RecordBatch.from_pylist([{"label": key[0], "d": top}], schema=pa.schema([("label", pa.int32()), ("d", pa.float64())]))

    rim = cut(packed.mapInArrow(outer, "label int, block long, n int, vec binary"), blocks.BATCH)
    met = cut(blocks.tiles(rim, None, {}, widest, "label int, d double", ["label"]))
    out = {r["label"]: r["d"] for r in low.unionByName(met).groupBy("label").agg(F.max("d").alias("d")).collect()}
    for shared in (far, tip, known):
        shared.destroy()
    return out


def _bounds(packed: DataFrame, sums: dict, tops: dict) -> DataFrame:
    """(label, sample_id, bound), written: the gain of each row as a first pick, which is linear in what the class sums up to, as no similarity is below 0."""
    shared = packed.sparkSession.sparkContext.broadcast({y: (*s, tops[y]) for y, s in sums.items()})

    def gains(incoming):
        for batch in incoming:
            for row in batch.to_pylist():
                own = blocks.unpack(row, {"sample_id": "i8"})
                n, square, total, top = shared.value[row["label"]]
                x = own["vec"]
                gain = np.round(n * top - square - n * (x * x).sum(1) + 2 * (x @ total), 9)
                yield from blocks.batches([np.full(len(x), row["label"], np.int32), own["sample_id"], gain], ["label", "sample_id", "bound"])

    return cut(packed.mapInArrow(gains, "label int, sample_id long, bound double"))


class _Lazy:
    """The picks of one class: a pool of candidates with bounds, the highest first, and the bound of what is outside it."""

    def __init__(self, budget: int):
        self.budget, self.picks, self.since, self.done = budget, [], [], False
        self.tried, self.when, self.stuck = 0, 0, False  # candidates measured for the next pick; picks when all bounds were measured; whether they must be again
        self.pool: dict[int, tuple[float, int]] = {}  # sample_id: bound, picks when it was measured
        self.vectors: dict[int, np.ndarray] = {}
        self.outside: tuple[float, int] | None = (math.inf, 0)

    def order(self) -> list[int]:
        return sorted(self.pool, key=lambda i: (-self.pool[i][0], i))

    def beyond(self, i: int) -> bool:
        """No row outside the pool can come before candidate i."""
        return self.outside is None or (-self.pool[i][0], i) < (-self.outside[0], self.outside[1])

    def advance(self) -> list[int]:
        """Take candidates whose gain is sure; the candidates to measure next, or none where the pool must grow or all is done."""
        while len(self.picks) < self.budget and self.pool:
            order = self.order()
            if not self.beyond(order[0]):
                return []
            bound, when = self.pool[order[0]]
            if when < len(self.picks):
                self.stuck = self.tried >= RENEW
                many = 0 if self.stuck else MEASURED if self.tried < MEASURED else RENEW - MEASURED
                wanted = [i for i in order[:many] if self.pool[i][1] < len(self.picks) and self.beyond(i)]
                self.tried += len(wanted)
                return wanted
            self.tried = 0
            self.picks.append((order[0], bound))
            self.since.append(self.vectors.pop(order[0]))
            del self.pool[order[0]]
        self.done = len(self.picks) >= self.budget or self.outside is None and not self.pool
        return []

    def restart(self) -> None:
        """All bounds are those of now."""
        self.pool, self.vectors, self.outside = {}, {}, (math.inf, 0)
        self.tried, self.when, self.stuck = 0, len(self.picks), False

    def most(self, rows: int, top: float) -> float:
        """What no later pick can gain more than: the last gain, and all that rows lack of the largest similarity."""
        least = min(self.picks[-1][1], rows * top - sum(g for _, g in self.picks)) if self.picks else math.inf
        return least * (1 + 1e-9) + 1e-6


def _measure(packed: DataFrame, asked: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """By class: the gains of candidates now. asked: the class' top, the picks since rows last kept their best, the candidates."""
    shared = packed.sparkSession.sparkContext.broadcast(asked)

    def gains(incoming):
        sums: dict[int, np.ndarray] = {}
        for batch in incoming:
            for row in batch.to_pylist():
                top, since, wanted = shared.value[row["label"]]
                own = blocks.unpack(row, {"best": "f8"})
                best = own["best"]
                if len(since):
                    best = np.maximum(best, top - _squared(own["vec"], since).min(1))
                gain = np.maximum(top - _squared(own["vec"], wanted) - best[:, None], 0).sum(0)
                sums[row["label"]] = gain + sums.get(row["label"], 0.0)
        yield pa.RecordBatch.from_pylist([{"label": k, "x": x.tolist()} for k, x in sums.items()], schema=pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))]))

    few = packed.filter(F.col("label").isin(list(asked))).mapInArrow(gains, "label int, x array<double>")
    cells = few.select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.round(F.sum("x"), 9).alias("x"))
    out = {y: np.zeros(len(wanted)) for y, (_, _, wanted) in asked.items()}
    for r in cells.collect():  # MEASURED rows a class
        out[r["label"]][r["i"]] = r["x"]
    shared.destroy()
    return out


def _gains(packed: DataFrame, now: dict[int, tuple[float, np.ndarray]]) -> DataFrame:
    """(label, sample_id, bound), written: the gains now of all rows of the classes in now (the class' top, the picks since rows last kept their best)."""
    shared = packed.sparkSession.sparkContext.broadcast(now)

    def work(key, a, b):
        top, since = shared.value[key[0]]
        sides, best, sums = [a] if b is None else [a, b], {}, {}
        for x in (x for side in sides for x in side):
            best[id(x)] = np.maximum(x["best"], top - _squared(x["vec"], since).min(1)) if len(since) else x["best"]
            sums[id(x)] = np.zeros(len(x["vec"]))
        for own, other, same in blocks.couples(a, b):
            sim = _squared(own["vec"], other["vec"])
            np.subtract(top, sim, out=sim)
            more = sim - best[id(other)]
            sums[id(own)] += np.maximum(more, 0, out=more).sum(1)
            if not same:
                sim -= best[id(own)][:, None]
                sums[id(other)] += np.maximum(sim, 0, out=sim).sum(0)
        for x in (x for side in sides for x in side):
            yield from blocks.batches([np.full(len(x["vec"]), key[0], np.int32), x["sample_id"], sums[id(x)]], ["label", "sample_id", "bound"])

    some = packed.filter(F.col("label").isin(list(now)))
    found = blocks.tiles(some, None, {"sample_id": "i8", "best": "f8"}, work, "label int, sample_id long, bound double", ["label"])
    out = cut(found.groupBy("label", "sample_id").agg(F.round(F.sum("bound"), 9).alias("bound")))
    shared.destroy()
    return out


def _keep_best(packed: DataFrame, picked: dict[int, tuple[float, np.ndarray]]) -> DataFrame:
    """packed, written anew with each row's best similarity to the picks so far."""
    shared = packed.sparkSession.sparkContext.broadcast(picked)
    at = packed.columns.index("best")

    def fold(incoming):
        for batch in incoming:
            best = []
            for row in batch.to_pylist():
                own = blocks.unpack(row, {"best": "f8"})
                top, since = shared.value.get(row["label"], (0.0, ()))
                best.append((np.maximum(own["best"], top - _squared(own["vec"], since).min(1)) if len(since) else own["best"]).tobytes())
            yield batch.set_column(at, "best", pa.array(best, pa.binary()))

    return cut(packed.mapInArrow(fold, packed.schema), blocks.BATCH)


def lazy(df: DataFrame, goals: dict[int, int], rows: int = blocks.ROWS, pool: int = POOL, measured: dict[int, int] | None = None, overall: int | None = None) -> DataFrame:
    """The picks of each class of df (label int, sample_id, vec), goals[label] of them at most, all classes in one job a round.

    A round takes what is sure, then measures the top candidates against all rows, brings more candidates to the pool, or measures all.
    overall: only the picks with so many largest gains of all classes are needed, so a class ends where no later pick can be one of them.
    measured: takes the number of candidates measured by class.
    """
    spark = df.sparkSession
    packed = blocks.pack(df.withColumn("best", F.lit(0.0)), {"sample_id": "i8", "best": "f8"}, ["label"], rows)
    sums = _sums(packed)
    tops = _diameters(packed, sums)
    bounds = _bounds(packed, sums, tops)
    classes = {y: _Lazy(budget) for y, budget in goals.items() if y in sums}
    width = len(next(iter(sums.values()))[2]) if sums else 0
    since = lambda c: np.array(c.since).reshape(-1, width)
    while True:
        asked = {y: c.advance() for y, c in classes.items() if not c.done}
        if overall is not None:
            gains = sorted((g for c in classes.values() for _, g in c.picks), reverse=True)
            for y, c in classes.items():
                if len(gains) >= overall and c.most(sums[y][0], tops[y]) < gains[overall - 1]:
                    c.done = True
        asked = {y: wanted for y, wanted in asked.items() if not classes[y].done}
        if not asked:
            break
        stuck = [y for y in asked if classes[y].stuck]
        short = [y for y, wanted in asked.items() if not wanted and not classes[y].stuck]
        if stuck:
            new = _gains(packed, {y: (tops[y], since(classes[y])) for y in stuck})
            picked = spark.createDataFrame([(y, i) for y in stuck for i, _ in classes[y].picks], "label int, sample_id long")
            new = new.join(F.broadcast(picked), ["label", "sample_id"], "left_anti")
            bounds = cut(bounds.filter(~F.col("label").isin(stuck)).unionByName(new))
            for y in stuck:
                classes[y].restart()
                if measured is not None:
                    measured[y] = measured.get(y, 0) + sums[y][0]
            for y in asked.keys() - set(stuck):
                classes[y].tried -= len(asked[y])
            continue
        if short:
            _fill(df, bounds, {y: classes[y] for y in short}, pool)
        asked = {y: wanted for y, wanted in asked.items() if wanted}
        if not asked or short:
            for y, wanted in asked.items():
                classes[y].tried -= len(wanted)
            continue
        if max(len(classes[y].since) for y in asked) >= FOLD:
            packed = _keep_best(packed, {y: (tops[y], np.array(c.since)) for y, c in classes.items() if c.since})
            for c in classes.values():
                c.since = []
        found = _measure(packed, {y: (tops[y], since(classes[y]), np.array([classes[y].vectors[i] for i in wanted])) for y, wanted in asked.items()})
        for y, wanted in asked.items():
            classes[y].pool |= {i: (float(g), len(classes[y].picks)) for i, g in zip(wanted, found[y].tolist(), strict=True)}
            if measured is not None:
                measured[y] = measured.get(y, 0) + len(wanted)
    out = [(y, i, step, gain) for y, c in classes.items() for step, (i, gain) in enumerate(c.picks, 1)]
    return spark.createDataFrame(out, _PICKS)


def _fill(df: DataFrame, bounds: DataFrame, classes: dict[int, _Lazy], pool: int) -> None:
    """Bring the next rows by bound into the pools, pool a class, and with them the bound of what stays outside."""
    spark = df.sparkSession
    ends = spark.createDataFrame([(y, *(c.outside or (-math.inf, 0))) for y, c in classes.items()], "label int, __last double, __at long")
    beyond = (F.col("bound") < F.col("__last")) | (F.col("bound") == F.col("__last")) & (F.col("sample_id") >= F.col("__at"))
    order = Window.partitionBy("label").orderBy(F.desc("bound"), "sample_id")
    rest = bounds.join(F.broadcast(ends), "label").filter(beyond).select("label", "sample_id", "bound", F.row_number().over(order).alias("__r"))
    found: dict[int, list] = {y: [] for y in classes}
    for r in rest.filter(F.col("__r") <= pool + 1).orderBy("label", "__r").collect():  # pool rows a class
        found[r["label"]].append(r)
    ids = spark.createDataFrame([(y, r["sample_id"]) for y, rows in found.items() for r in rows[:pool]], "label int, sample_id long")
    vectors: dict[tuple[int, int], np.ndarray] = {}
    for r in df.select("label", "sample_id", "vec").join(F.broadcast(ids), ["label", "sample_id"], "left_semi").collect():
        vectors[r["label"], r["sample_id"]] = np.array(r["vec"])
    for y, c in classes.items():
        rows = found[y]
        c.outside = (rows[pool]["bound"], rows[pool]["sample_id"]) if len(rows) > pool else None
        c.vectors |= {r["sample_id"]: vectors[y, r["sample_id"]] for r in rows[:pool]}
        c.pool |= {r["sample_id"]: (r["bound"], c.when) for r in rows[:pool]}


# --- operators ---------------------------------------------------------------------------------------------------


def sequence(df: DataFrame, budgets: DataFrame, chunk: int = CHUNK, overall: int | None = None) -> DataFrame:
    """(label, sample_id, step, gain): the picks of each class in order, budgets (label, budget) of them at most. Ids must not repeat in a class.

    overall: large classes may leave out picks that are not among so many with the largest gains of all classes.
    """
    rows = df.select(F.col("label").cast("int").alias("label"), F.col("sample_id").cast("long").alias("sample_id"), "vec").filter("label IS NOT NULL AND vec IS NOT NULL")
    goals = budgets.select(F.col("label").cast("int").alias("label"), F.col("budget").cast("int").alias("budget")).filter("budget > 0")
    sizes = cut(rows.groupBy("label").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(goals), "label"))  # a row per class
    small, large = (rows.join(F.broadcast(sizes.filter(c).select("label")), "label", "left_semi") for c in (F.col("c") <= chunk, F.col("c") > chunk))
    out = _whole(small, goals)
    wanted = {r["label"]: r["budget"] for r in sizes.filter(F.col("c") > chunk).collect()}
    return out.unionByName(lazy(cut(large), wanted, overall=overall)) if wanted else out


def per_class(df: DataFrame, budgets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return sequence(df, budgets, chunk)


def supervised(df: DataFrame, budget: int, chunk: int = CHUNK) -> DataFrame:
    """budget picks over all classes, the largest gain first.

    Classes don't touch each other and gains only fall, so the classes' own sequences are merged by gain; a class ends where its
    later picks can't be among them.
    """
    classes = df.select("label").distinct().withColumn("budget", F.lit(budget))
    return sequence(df, classes, chunk, budget).orderBy(F.col("gain").desc(), "label", "step").limit(budget)


def per_batch(df: DataFrame, budget: int, batch: int, seed: int = 0) -> DataFrame:
    """All rows of the ceil(budget / batch) mini-batches whose means stand best for all batches."""
    means = batch_mean(df, batch, seed).select(F.lit(0).alias("label"), F.col("batch").alias("sample_id"), "vec")
    goal = df.sparkSession.createDataFrame([(0, math.ceil(budget / batch))], "label int, budget int")
    chosen = sequence(means, goal).select(F.col("sample_id").alias("batch"))
    rows = chance.dense_index(df, seed, "_p").withColumn("batch", F.floor(F.col("_p") / batch)).drop("_p")
    return rows.join(F.broadcast(chosen), "batch")


def active(df: DataFrame, budgets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sequence with the predicted label in place of the label."""
    return sequence(df.withColumn("label", F.col("predicted")), budgets, chunk)
