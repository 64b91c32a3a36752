"""Spectral clustering on a sparse neighbour graph: eigenvectors of the normalised affinity by orthogonal iteration.

Each row is linked to its most similar rows. A step multiplies the affinity with a few vectors, which stand beside the
rows as one array each: a join over the links and a sum. The vectors are made orthonormal again by the triangular
factor of their small Gram matrix, the only thing that comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions import chance
from sievekit.operators import blocks, sums
from sievekit.operators.nearest import nearest
from sievekit.sources.tables import cut


def neighbour_graph(df: DataFrame, m: int = 20, sigma: float = 1.0) -> DataFrame:
    """(i, j, w): absolute cosine over sigma for each row and its m most similar others (ties: smaller id), and the same the other way round."""
    near = nearest(df, df, m + 1, "abs_cos").filter("sample_id <> near_id")
    near = near.select(F.col("sample_id").alias("i"), F.col("near_id").alias("j"), ((1 - F.col("dist")) / sigma).alias("w"))
    # where a row has m + 1 rows as near as itself, one link more than m may be left: the farthest, with the largest id
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("w")).filter("w > 0")


def degrees(graph: DataFrame) -> DataFrame:
    """(sample_id, degree): the sum of each row's links."""
    return graph.groupBy(F.col("i").alias("sample_id")).agg(F.sum("w").alias("degree"))


def normalised(graph: DataFrame) -> DataFrame:
    """(i, j, w) with each link over the roots of both ends' degrees, written."""
    d = cut(degrees(graph))
    own = d.select(F.col("sample_id").alias("i"), F.col("degree").alias("di"))
    other = d.select(F.col("sample_id").alias("j"), F.col("degree").alias("dj"))
    return cut(graph.join(own, "i").join(other, "j").select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w")))


def _times(q: Column, matrix: np.ndarray) -> Column:
    """The array q times a small matrix."""
    return F.array(*(sum((F.get(q, F.lit(r)) * float(matrix[r, c]) for r in range(len(matrix))), F.lit(0.0)) for c in range(matrix.shape[1])))


def _multiply(graph: DataFrame, now: DataFrame, k: int, of: str, to: str) -> DataFrame:
    """now with column to: the affinity plus one times column of. The one keeps all eigenvalues above 0, so that the largest come first."""
    pulled = graph.join(now.select(F.col("sample_id").alias("j"), F.col(of).alias("x")), "j").groupBy("i").agg(*(F.sum(F.col("w") * F.get("x", F.lit(c))).alias(f"c{c}") for c in range(k)))
    z = F.array(*(F.coalesce(f"c{c}", F.lit(0.0)) + F.get(of, F.lit(c)) for c in range(k)))
    return now.join(pulled, F.col("sample_id") == F.col("i"), "left").select(*now.columns, z.alias(to))


def _grams(written: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y'y, q'z and the sum of q over the rows (sample_id, q, z, y)."""

    def of(batches):
        for b in batches:
            if b.num_rows:
                q, z, y = (blocks.matrix(b.column(i)) for i in (1, 2, 3))
                yield 0, np.concatenate([(y.T @ y).ravel(), (q.T @ z).ravel(), q.sum(0)])

    x = sums.collect(written, of, 2 * k * k + k).get(0, np.zeros(2 * k * k + k))
    return x[: k * k].reshape(k, k), x[k * k : 2 * k * k].reshape(k, k), x[2 * k * k :]


def eigenvectors(df: DataFrame, k: int, m: int = 20, sigma: float = 1.0, iterations: int = 100, tol: float = 1e-6, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((sample_id, vec), values): the k largest eigenvalues of the normalised affinity of the neighbour graph, and each row's components in their vectors.

    An iteration multiplies twice. Ends when no value moves by tol, or after so many iterations, one at least. At most as many vectors as rows are found. A vector's sign makes its sum positive.
    """
    rows = cut(df.select(F.col("sample_id").cast("long").alias("sample_id"), "vec").filter("vec IS NOT NULL"))
    k = min(k, rows.count())
    if not k:
        return rows.select("sample_id", "vec"), []
    graph = normalised(neighbour_graph(rows, m, sigma))
    start = F.array(*(chance.uniform(seed + 1 + c) - 0.5 for c in range(k)))
    step = cut(rows.select("sample_id", start.alias("q")).select("*", F.col("q").alias("z"), F.col("q").alias("y")))
    gram, last = _grams(step, k)[0], None
    for _ in range(iterations):
        right = np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(k)).T)
        now = cut(step.select("sample_id", _times(F.col("y"), right).alias("q")))
        step = cut(_multiply(graph, _multiply(graph, now, k, "q", "z"), k, "z", "y"))
        gram, h, total = _grams(step, k)
        values = np.linalg.eigvalsh((h + h.T) / 2)
        if last is not None and np.abs(values - last).max() < tol:
            break
        last = values
    values, rotation = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(values)[::-1]
    rotation = rotation[:, order]
    rotation *= np.where(total @ rotation < 0, -1, 1)
    return step.select("sample_id", _times(F.col("q"), rotation).alias("vec")), (values[order] - 1).tolist()
