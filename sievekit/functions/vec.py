"""Array expressions over vectors and logits; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(x) -> Column:
    return F.transform(x, lambda e: e.cast("double"))


def bind(x, f) -> Column:
    """f(x) with x computed once, however often f uses it (inside a lambda an expression is computed at each use)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def scale(a, by) -> Column:
    return F.transform(a, lambda x: x * by)


def standardize(x, mean, std) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda e, m: e - m), std, lambda e, s: e / s)


def softmax(z) -> Column:
    """Shifted by the maximum, so that no exponential overflows."""
    exps = lambda z: bind(F.array_max(z), lambda top: F.transform(z, lambda e: F.exp(e - top)))
    return bind(bind(z, exps), lambda s: bind(total(s), lambda t: F.transform(s, lambda e: e / t)))


def log_softmax(z) -> Column:
    def of(z):
        log_sum = lambda top: top + F.log(total(F.transform(z, lambda e: F.exp(e - top))))
        return bind(bind(F.array_max(z), log_sum), lambda t: F.transform(z, lambda e: e - t))

    return bind(z, of)


def argmax(z) -> Column:
    """The first position of the maximum, from 0."""
    return bind(z, lambda z: (F.array_position(z, F.array_max(z)) - 1).cast("int"))


def top2_gap(z) -> Column:
    return bind(F.reverse(F.array_sort(z)), lambda o: F.element_at(o, 1) - F.element_at(o, 2))


def onehot(label, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def outer(h, g) -> Column:
    """The flattened product of two vectors, row by row of the first."""
    return bind(g, lambda g: F.flatten(F.transform(h, lambda a: F.transform(g, lambda b: a * b))))


def take(vec, indices: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(vec, i))


# --- distances between two vectors -----------------------------------------------------------------------------
# A vector of zeros has cosine 0 with every vector, and a share of it is 0, so its angular distances are 1 (neg_cos: 0).


def over(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def abs_cos(a, b) -> Column:
    return 1 - over(F.abs(dot(a, b)), norm(a) * norm(b))


def abs_cos_by_norm(a, b) -> Column:
    """As abs_cos, but the second vector keeps its length."""
    return 1 - over(F.abs(dot(a, b)), norm(a))


def neg_cos(a, b) -> Column:
    return -over(dot(a, b), norm(a) * norm(b))


def abs_dot(a, b) -> Column:
    return 1 - F.abs(dot(a, b))


def cross(a, b) -> Column:
    """1 minus the product of the sums of the absolute unit vectors over the squared length."""
    flat = lambda v: over(total(F.transform(v, lambda e: F.abs(e))), norm(v))
    return 1 - flat(a) * flat(b) / (F.size(a) * F.size(a))


def l2_blocks(a, b) -> Column:
    """Mean over blocks of the squared distance."""
    per = F.zip_with(a, b, lambda x, y: total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    return total(per) / F.size(a)


def _over(blocks, f) -> Column:
    """The sum of f over the blocks."""
    return total(F.transform(blocks, f))


def abs_cos_blocks(a, b, n_blocks: int | None = None, by_norm: bool = False) -> Column:
    """1 minus the absolute cosine over all blocks together.

    n_blocks: the product and the second norm go over the first so many blocks only, the first norm over all.
    by_norm: the second vector keeps its length.
    """
    if n_blocks is None and not by_norm:
        return abs_cos(F.flatten(a), F.flatten(b))
    own, other = (a, b) if n_blocks is None else (F.slice(a, 1, n_blocks), F.slice(b, 1, n_blocks))
    product = F.abs(total(F.zip_with(own, other, dot)))
    norms = F.sqrt(_over(a, lambda x: dot(x, x)))
    return 1 - over(product, norms if by_norm else norms * F.sqrt(_over(other, lambda x: dot(x, x))))


def abs_cos_each_block(a, b, n_blocks: int | None = None, by_norm: bool = False) -> Column:
    """The same for each block by itself, under the norms over all of them: an array."""
    own, other = (a, b) if n_blocks is None else (F.slice(a, 1, n_blocks), F.slice(b, 1, n_blocks))
    norms = F.sqrt(_over(a, lambda x: dot(x, x)))
    by = norms if by_norm else norms * F.sqrt(_over(other, lambda x: dot(x, x)))
    return F.zip_with(own, other, lambda x, y: 1 - over(F.abs(dot(x, y)), by))


def cross_blocks(a, b) -> Column:
    """1 minus the mean over blocks of the products of the sums of the absolute unit vectors."""
    flat = lambda v: over(total(F.transform(v, lambda e: F.abs(e))), norm(v))
    return 1 - total(F.zip_with(a, b, lambda x, y: flat(x) * flat(y))) / F.size(a)


def mean_dot(a, b) -> Column:
    """A similarity: the product over the width."""
    return dot(a, b) / F.size(a)


#: name -> distance of two columns; register adds to it.
METRICS = {f.__name__: f for f in (l2, abs_cos, abs_cos_by_norm, neg_cos, abs_dot, cross, l2_blocks, abs_cos_blocks, cross_blocks, mean_dot)}


def register(name: str, distance) -> None:
    """Add a distance of two columns under a name that operators take as their metric."""
    if name in METRICS:
        raise ValueError(f"there is a metric {name} already")
    METRICS[name] = distance


# --- losses per sample -----------------------------------------------------------------------------------------


def cross_entropy(z, label) -> Column:
    return -F.get(log_softmax(z), label)


def l1_loss(z, label, k: int) -> Column:
    return total(F.zip_with(softmax(z), onehot(label, k), lambda p, t: F.abs(p - t)))


def soft_bootstrap(z, label, beta: float = 0.95) -> Column:
    """Cross-entropy with the target mixed with the model's own probabilities."""
    return beta * cross_entropy(z, label) - (1 - beta) * dot(softmax(z), log_softmax(z))


def hard_bootstrap(z, label, beta: float = 0.95) -> Column:
    """Cross-entropy with the target mixed with the model's own choice."""
    return beta * cross_entropy(z, label) + (1 - beta) * cross_entropy(z, argmax(z))


def uncertainty(z) -> Column:
    """-sum of logit times log-probability: the logits themselves are the soft target."""
    return bind(z, lambda z: -dot(z, log_softmax(z)))


def ce_gradient(z, label, k: int) -> Column:
    """Gradient of the cross-entropy by the logits: probabilities less the one-hot label."""
    return F.zip_with(softmax(z), onehot(label, k), lambda p, t: p - t)
