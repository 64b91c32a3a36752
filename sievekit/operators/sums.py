"""Sums of arrays over all rows: each task adds up its own and passes on one array a key, not a row for each component of each row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of all tasks' arrays up to which they are added up on the driver; beyond, tasks' arrays meet by component first.
SMALL = 32 << 20
_SHAPE = pa.schema([("key", pa.int64()), ("x", pa.list_(pa.float64()))])


def collect(rows: DataFrame, of: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], numbers: int, small: int = SMALL) -> dict[int, np.ndarray]:
    """{key: sum of arrays} over of(batches) of all tasks; the arrays of a key are equally long, numbers in all keys together at most.

    rows: a written frame, whose columns of() reads in Arrow batches.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for key, x in of(batches):
            sums[key] = sums[key] + x if key in sums else np.array(x, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], _SHAPE.field("x").type)], schema=_SHAPE)

    parts = rows.mapInArrow(run, "key long, x array<double>")
    out: dict[int, np.ndarray] = {}
    if 8 * numbers * rows.rdd.getNumPartitions() <= small:
        for r in parts.collect():
            out[r["key"]] = out[r["key"]] + np.array(r["x"]) if r["key"] in out else np.array(r["x"])
        return out
    cells = parts.select("key", F.posexplode("x").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x"))
    for r in cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).collect():  # a row per key
        out[r["key"]] = np.array([c["x"] for c in r["c"]])
    return out
