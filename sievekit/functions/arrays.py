"""The distances of functions.vec on whole matrices, for tasks that hold rows packed: rows by centres, rounded alike.

A vector of zeros has cosine 0 with every vector, so its angular distances are 1 (neg_cos: 0), here and in functions.vec.
"""

from __future__ import annotations

import numpy as np


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(1))


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def squared(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by one product; those of nearly equal rows, which a difference of large numbers would blur, row by row."""
    x, y = (a * a).sum(1)[:, None], (c * c).sum(1)
    out, product = x + y, a @ c.T
    product *= 2
    out -= product
    np.maximum(out, 0, out=out)
    if not out.size or out.min() >= 1e-6 * (x.max() + y.max()):
        return out
    i, j = np.nonzero(out < 1e-6 * (x + y))
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        out[p, q] = ((a[p] - c[q]) ** 2).sum(1)
    return out


def cosine(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, x, y = a @ c.T, norms(a), norms(c)
    if out.size and x.min() * y.min() > 0:
        return np.divide(out, x[:, None] * y, out=out)
    return over(out, x[:, None] * y)


def _abs_cos(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = cosine(a, c)
    return np.subtract(1, np.abs(out, out=out), out=out)


def _l2(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = squared(a, c)
    return np.sqrt(out, out=out)


def _nine(x: np.ndarray) -> np.ndarray:
    return np.round(x, 9, out=x)


def _flat(a: np.ndarray) -> np.ndarray:
    return over(np.abs(a).sum(1), norms(a))


NUMPY_METRICS = {
    name: lambda a, c, f=f: _nine(f(a, c))
    for name, f in {
        "l2": _l2,
        "abs_cos": _abs_cos,
        "abs_cos_by_norm": lambda a, c: 1 - over(np.abs(a @ c.T), norms(a)[:, None]),
        "neg_cos": lambda a, c: -cosine(a, c),
        "abs_dot": lambda a, c: 1 - np.abs(a @ c.T),
        "mean_dot": lambda a, c: a @ c.T / max(a.shape[1], 1),
        "cross": lambda a, c: 1 - _flat(a)[:, None] * _flat(c) / max(a.shape[1], 1) ** 2,
    }.items()
}
