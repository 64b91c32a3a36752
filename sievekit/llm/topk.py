"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are small integers. Candidates lie in ranges of their id; a range is cut into blocks, and each block
keeps the largest and smallest value of each term (dimension). For a query the block's bound is the sum over
terms of the better of the two products. Blocks are visited in falling order of bounds, scored through their
forward index (the block's matrix), and the visit ends when no bound reaches the k-th best score so far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import materialize


@dataclass(frozen=True)
class Params:
    """chunk: candidates of a range; block: of a block; queries: of a batch of queries; batch_bytes: batches that travel to
    every task at a time, at most (one at least); scale: integers per 1.0."""

    k: int = 5
    every: int = 50
    scale: int = 256
    chunk: int = 16384
    block: int = 64
    queries: int = 1024
    batch_bytes: int = 32 << 20


def quantise(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """vec_id and v (array of long); rows with a null id, a null vector, or a null or non-finite component are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * params.scale).cast("long")).alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows in order of id to (dim, ids, data): matrices of at most size rows of one length. Rows alike in id and vector count once."""
    ordered = rows.withColumn("dim", F.size("v")).repartitionByRange(F.col("vec_id")).sortWithinPartitions("vec_id", "dim", "v")

    def pack(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        before = None

        def out(dim):
            got = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in got], np.int64).tobytes()], pa.binary()), pa.array([b"".join(b for _, b in got)], pa.binary())], names=["dim", "ids", "data"]
            )

        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(batch.column("dim").to_numpy(zero_copy_only=False))
            for i, dim, end in zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), ends.tolist(), strict=True):
                row = (i, flat[end - dim : end].tobytes())
                if row == before:
                    continue
                before = row
                held.setdefault(dim, []).append(row)
                if len(held[dim]) >= size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return ordered.mapInArrow(pack, "dim int, ids binary, data binary")


def nobody_yet(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best so far of each query: none."""
    return np.full((queries, k), -(1 << 62)), np.full((queries, k), NOBODY)


NOBODY = np.iinfo(np.int64).max


def best_in_range(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, data: np.ndarray, before: tuple[np.ndarray, np.ndarray], params: Params):
    """The k best of each query among those found before and a range, as (scores, ids): ties to the smaller id, the query's own id left out.

    A k-th score from ranges before prunes this one's blocks from the start.
    """
    n, k = len(ids), params.k
    # products are exact in doubles below 2^53; beyond that integers are used
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if bound < 2**52 else np.int64
    q, data = q.astype(kind), data.astype(kind)
    starts = np.arange(0, n, params.block)
    high, low = np.maximum.reduceat(data, starts, axis=0), np.minimum.reduceat(data, starts, axis=0)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    bounds = positive @ high.T + negative @ low.T  # summed term maxima
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor, nobody = -(1 << 62), NOBODY
    best, who = before[0].astype(kind), before[1].copy()
    alive = np.arange(len(q))
    for step in range(len(starts)):
        block = order[alive, step]
        going = (bounds[alive, block] >= best[alive, -1]) | (who[alive, -1] == nobody)
        alive, block = alive[going], block[going]
        if not len(alive):
            break
        by = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(block[by]) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows, at = alive[by[a:b]], int(starts[block[by[a]]])
            end = min(n, at + params.block)
            scores = q[rows] @ data[at:end].T
            own = q_ids[rows][:, None] == ids[None, at:end]
            cand_s = np.concatenate([best[rows], np.where(own, floor, scores)], axis=1)
            cand_i = np.concatenate([who[rows], np.where(own, nobody, np.broadcast_to(ids[at:end], scores.shape))], axis=1)
            rank = np.lexsort((cand_i, -cand_s), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(cand_s, rank, 1), np.take_along_axis(cand_i, rank, 1)
    return best.astype(np.int64), who


def search(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by params.every, its k best other rows.

    The ranges of candidates stay in their tasks and the queries come to them, in batches, as many at a time as
    batch_bytes allows; a task keeps each query's best from range to range and passes on k of them in the end. A query
    meets only candidates of its own length. Rows alike in id and vector count once.
    """
    rows = quantise(vectors, params)
    ranges = materialize(_pack(rows, params.chunk), "topk-ranges")
    numbered = _pack(rows.filter(F.col("vec_id") % params.every == 0), params.queries).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.monotonically_increasing_id().alias("batch"))
    batches = materialize(numbered, "topk-queries")
    rounds, room = [[]], 0
    for r in batches.select("batch", (F.length("q_ids") + F.length("q_data")).alias("size")).orderBy("batch").toLocalIterator():  # a row for each 1024 queries
        if rounds[-1] and room + r["size"] > params.batch_bytes:
            rounds.append([])
            room = 0
        rounds[-1].append(r["batch"])
        room += r["size"]

    def score(pairs):
        held: dict[int, list] = {}
        for group in pairs:
            for row in group.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                data, q = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dim"]), np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), row["dim"])
                before = held[row["batch"]][1] if row["batch"] in held else nobody_yet(len(q_ids), params.k)
                held[row["batch"]] = [q_ids, best_in_range(q_ids, q, ids, data, before, params)]
        for q_ids, (best, who) in held.values():
            hit = who.ravel() != NOBODY
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q_ids, params.k)[hit], who.ravel()[hit], best.ravel()[hit])], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = None
    for some in rounds:
        pairs = ranges.join(F.broadcast(batches.filter(F.col("batch").between(some[0], some[-1]) if some else F.lit(False))), "dim")
        found = materialize(pairs.select("dim", "ids", "data", "batch", "q_ids", "q_data").mapInArrow(score, "query_id long, vec_id long, score long"), "topk-found", 8)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
