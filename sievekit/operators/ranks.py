"""Places of rows in an order, and the first rows of it, without a task that sees them all.

Rows are sorted in ranges and written; a row's place is its place in its range behind the ranges before. Only the
counts of the ranges (a row each) meet in one task. A request for at most FEW rows is an ordinary top-n, which
gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.sources.tables import cut

FEW = 10_000
_PLACE, _RANGE, _BEFORE = "__place", "__range", "__before"


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted, with the number of its range and of its row there; written, so that both stay as they are."""
    placed = cut(df.orderBy(*order).withColumn(_PLACE, F.monotonically_increasing_id()))
    return placed.withColumn(_RANGE, F.shiftright(_PLACE, 33)).withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1)))


def numbered(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """df with its place (from 0) in the order, which must not have ties."""
    placed = in_ranges(df, order)
    counts = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias(_BEFORE))
    before = counts.select(_RANGE, (F.sum(_BEFORE).over(Window.orderBy(_RANGE)) - F.col(_BEFORE)).alias(_BEFORE))
    return placed.join(F.broadcast(before), _RANGE).withColumn(name, F.col(_BEFORE) + F.col(_PLACE)).drop(_RANGE, _PLACE, _BEFORE)


def first(df: DataFrame, order: list[Column], n: int, few: int = FEW) -> DataFrame:
    """The first n rows in the order."""
    if n <= few:
        return df.orderBy(*order).limit(max(n, 0))
    return numbered(df, order, "__n").filter(F.col("__n") < n).drop("__n")


def within(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """df with its place (from 1) in the order among the rows that share column by (null is a value): its place among all less that of the first."""
    all_ = cut(numbered(df, [F.col(by), *order], "__n"))
    start = all_.groupBy(F.col(by).alias("__by")).agg(F.min("__n").alias("__start"))  # a row per class
    return all_.join(F.broadcast(start), F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col("__n") - F.col("__start") + 1).drop("__n", "__by", "__start")


def running_sum(df: DataFrame, by: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before it in its class: those of its range, and the ranges' sums before."""
    placed = in_ranges(df, [F.col(by), *order])
    sums = placed.groupBy(by, _RANGE).agg(F.sum(value).alias(_BEFORE))
    before = sums.select(F.col(by).alias("__by"), F.col(_RANGE).alias("__r"), (F.sum(_BEFORE).over(Window.partitionBy(by).orderBy(_RANGE)) - F.col(_BEFORE)).alias(_BEFORE))
    own = Window.partitionBy(_RANGE, by).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(before), F.col(by).eqNullSafe(F.col("__by")) & (F.col(_RANGE) == F.col("__r")))
    return joined.withColumn(name, F.col(_BEFORE) + F.coalesce(F.sum(value).over(own), F.lit(0))).drop(_RANGE, _PLACE, _BEFORE, "__by", "__r")


# --- the first rows of each class, without a sort ------------------------------------------------------------------

#: Bins of a counting pass, and rows of a class' boundary that are ranked by a window instead of another pass.
BINS, BOUNDARY = 4096, 10_000


def _last_rows(rows: DataFrame, keys: int, quota: dict, boundary: int, span: tuple[int, int] | None = None) -> dict:
    """By class the keys of its quota-th row, and how many rows with just these keys are within the quota.

    rows: (by, k0, k1, ...), whole numbers. Each pass counts the rows of every class in bins of one key, and goes on in the bin
    that the quota ends in, with the key's least and largest value there; a bin of one value leads to the next
    key. Only a row for each class comes to the driver. span: what the first key lies in, where that is known.
    """
    spark, found = rows.sparkSession, {}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    low, high = span or (-(2**63), 2**63 - 1)
    state = {by: {"left": n, "level": 0, "fixed": [0] * keys, "lo": low, "hi": high, "n": math.inf} for by, n in quota.items() if n > 0}
    fresh = span is None
    while state:
        shape = ", ".join([f"s_by {kinds['by']}", "s_left long", "s_level int", *(f"f{i} long" for i in range(keys)), "s_lo long", "s_hi long"])
        table = spark.createDataFrame([(by, s["left"], s["level"], *s["fixed"], s["lo"], s["hi"]) for by, s in state.items()], shape)
        inside = [F.when(F.col("s_level") > i, F.col(f"k{i}") == F.col(f"f{i}")).when(F.col("s_level") == i, F.col(f"k{i}").between(F.col("s_lo"), F.col("s_hi"))).otherwise(True) for i in range(keys)]
        open_ = rows.join(F.broadcast(table), F.col("by").eqNullSafe(F.col("s_by")))
        deepest = max(s["level"] for s in state.values())
        for c in inside[: deepest + 1]:
            open_ = open_.filter(c)
        key = F.lit(None).cast("long")
        for i in range(deepest + 1):
            key = F.when(F.col("s_level") == i, F.col(f"k{i}")).otherwise(key)
        open_ = open_.withColumn("key", key)
        if fresh:  # nothing is known of the first key's range
            spans = open_.groupBy("by").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
            for r in spans:
                state[r["by"]] |= {"lo": r["lo"], "hi": r["hi"], "n": r["n"]}
            for by in [b for b, s in state.items() if s["n"] == math.inf]:
                del state[by]  # no such class
            for s in state.values():
                s["left"] = min(s["left"], s["n"])
            fresh = False
            continue
        few = [by for by, s in state.items() if s["n"] <= boundary]
        if len(few) == len(state):
            order = Window.partitionBy("by").orderBy(*(f"k{i}" for i in range(keys)))
            ranked = open_.withColumn("r", F.row_number().over(order)).withColumn("same", F.struct(*(f"k{i}" for i in range(keys))))
            last = ranked.groupBy("by", "s_left", "same").agg(F.min("r").alias("from"), F.max("r").alias("to")).filter("s_left BETWEEN `from` AND `to`")
            for r in last.collect():
                found[r["by"]] = (tuple(r["same"]), r["s_left"] - r["from"] + 1, r["to"] - r["from"] + 1)
            return found
        wide = F.col("s_hi").cast("double") - F.col("s_lo").cast("double")
        near = F.col("s_hi").cast("decimal(38,0)") - F.col("s_lo") < F.lit(1 << 62)
        offset = F.when(near, F.try_subtract("key", "s_lo").cast("double")).otherwise(F.col("key").cast("double") - F.col("s_lo").cast("double"))
        span = F.when(near, F.try_subtract("s_hi", "s_lo").cast("double")).otherwise(wide)
        bin_ = F.least(F.floor(F.try_divide(offset, span) * BINS), F.lit(BINS - 1))
        counts = open_.groupBy("by", "s_left", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("by").orderBy("bin")))
        whole = running.withColumn("want", F.least("s_left", F.sum("n").over(Window.partitionBy("by"))))
        ends = whole.filter("upto >= want AND upto - n < want").collect()
        for by in state.keys() - {r["by"] for r in ends}:
            del state[by]  # no such class
        for r in ends:
            s = state[r["by"]]
            s |= {"left": r["want"] - (r["upto"] - r["n"]), "lo": r["lo"], "hi": r["hi"], "n": r["n"]}
            if r["lo"] == r["hi"]:
                s["fixed"][s["level"]] = r["lo"]
                s["level"] += 1
                if s["level"] == keys:  # rows alike in all keys
                    found[r["by"]] = (tuple(s["fixed"]), s["left"], s["n"])
                    del state[r["by"]]
                else:
                    s |= {"lo": -(2**63), "hi": 2**63 - 1}
        fresh = any(s["lo"] == -(2**63) and s["level"] for s in state.values())
    return found


def last_row(rows: DataFrame, keys: int, n: int, boundary: int = BOUNDARY, span: tuple[int, int] | None = None) -> tuple | None:
    """The keys (columns k0, k1, ...) of the n-th row in their order, of the last one where there are fewer; none for no rows or n = 0."""
    found = _last_rows(rows.select(F.lit(0).alias("by"), *(f"k{i}" for i in range(keys))), keys, {0: n}, boundary, span)
    return found[0][0] if found else None


def within_quota(df: DataFrame, by: Column, keys: list[Column], quota: dict, boundary: int = BOUNDARY, span: tuple[int, int] | None = None) -> DataFrame:
    """The first quota[class] rows of each class in the order of the keys (whole numbers, not null); classes without a quota have none.

    A null class is a class. Of rows alike in all keys some are taken where the quota ends among them, so that it is kept exactly.
    df is read once or more, and neither sorted nor written: its rows are compared with their class' last one.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    marked = df.select("*", by.alias("__class"), *(k.cast("long").alias(n) for k, n in zip(keys, names, strict=True)))
    rows = marked.select(F.col("__class").alias("by"), *(F.col(n).alias(n[2:]) for n in names))
    found = _last_rows(rows, len(keys), quota, boundary, span)
    shape = ", ".join([f"__of {marked.schema['__class'].dataType.simpleString()}", *(f"__c{i} long" for i in range(len(keys))), "__take long", "__all long"])
    table = df.sparkSession.createDataFrame([(c, *last, take, many) for c, (last, take, many) in found.items()], shape)
    mine, last = F.struct(*names), F.struct(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(names)))
    joined = marked.join(F.broadcast(table), F.col("__class").eqNullSafe(F.col("__of")))  # a row per class
    if all(take == many for _, take, many in found.values()):
        return joined.filter(mine <= last).select(*df.columns)
    before = joined.filter((mine < last) | (mine == last) & (F.col("__take") == F.col("__all")))
    tied = joined.filter((mine == last) & (F.col("__take") < F.col("__all")))
    tied = tied.withColumn("__r", F.row_number().over(Window.partitionBy("__class").orderBy(*names))).filter(F.col("__r") <= F.col("__take"))
    return before.select(*df.columns).unionByName(tied.select(*df.columns))
