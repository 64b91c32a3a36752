"""SimHash fingerprints and near-duplicate components by BK-trees.

Fingerprints within the radius agree on some of their blocks of bits (pigeonhole), so each block value is a
shard with its own BK-tree: children are keyed by their integer Hamming distance to the parent, and a search
follows only the edges within the radius. A large shard is cut into several trees, and every pair of trees
meets. Trees travel by shuffle, not by broadcast, because shards grow with the data. Each search reports
linked groups as stars; the stars are joined to components by rounds of DataFrame joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import drop, map_rows, materialize


@dataclass(frozen=True)
class Params:
    """blocks: 64 bits are cut into so many; each choice of blocks - radius of them is a key. More blocks make
    smaller shards and more copies of a fingerprint (6 for over 10^9 texts). tree: most fingerprints of a tree."""

    words: int = 3
    radius: int = 3
    blocks: int = 4
    tree: int = 4096
    seed: int = 42


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, params: Params = Params()) -> int:
    """Bit j is 1 if it is set in over half the shingles' hashes; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: just A-Z and the six white spaces
    if not words:
        return 0
    k = params.words
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    digest, seed = xxhash.xxh64_intdigest, params.seed
    return majority(np.array([digest(s, seed) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: bit j is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += (np.bincount((part + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``row`` (without the text) and fp (the fingerprint as a signed long). Null and empty texts have 0."""

    def setup():
        return lambda texts: [pa.array(np.array([fingerprint(t, params) for t in texts], np.uint64).view(np.int64))]

    return map_rows(docs, ["text"], setup, "fp long", [c for c in docs.columns if c != "text"])


# --- trees ---------------------------------------------------------------------------------------------------


class Forest:
    """BK-trees of several groups at once; built and searched level by level with arrays."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """fp: unsigned fingerprints; group: ascending group numbers, each with its own tree."""
        self.fp = fp
        n = len(fp)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        rest = np.flatnonzero(~first)
        node = self.root[rest]
        while len(rest):
            key = np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
            order = np.lexsort((rest, key, node))
            rest, node, key = rest[order], node[order], key[order]
            lead = np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])]
            parent[rest[lead]], edge[rest[lead]] = node[lead], key[lead]
            child = rest[lead][np.cumsum(lead) - 1]
            rest, node = rest[~lead], child[~lead]
        own = np.flatnonzero(parent >= 0)
        code = parent[own] * 128 + edge[own]
        order = np.argsort(code, kind="stable")
        self.code, self.child = code[order], own[order]

    def within(self, query: np.ndarray, radius: int):
        """Pairs (query, other) within the radius, where both are positions of this forest, in the query's own tree."""
        q, node = query, self.root[query]
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            yield q[hit], node[hit]
            low = np.searchsorted(self.code, node * 128 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.code, node * 128 + np.minimum(d + radius, 64), "right")
            many = high - low
            some = many > 0
            low, many, q = low[some], many[some], q[some]
            total = int(many.sum())
            offset = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            node, q = self.child[np.repeat(low, many) + offset], np.repeat(q, many)


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a and b pairwise: labels become the smallest position of each set."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(labels, np.maximum(x, y), low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def stars(fp: np.ndarray, group: np.ndarray, radius: int, pairs: int = 1 << 22):
    """(fp, centre) for every fingerprint that is linked, within its group, to a set with another centre."""
    forest, labels = Forest(fp, group), np.arange(len(fp))
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(fp)])
    cost = np.cumsum(np.repeat(sizes, sizes))  # a search visits its group at most
    at = 0
    while at < len(fp):
        base = cost[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(cost, base + pairs, "right")))
        for a, b in forest.within(np.arange(at, end), radius):
            union(labels, a, b)
        at = end
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[moved], fp[labels[moved]]


def _keys(params: Params) -> list[Column]:
    """The shard keys of fp: the bits of each choice of blocks, with the choice's number mixed in by a column of its own."""
    edges = [64 * i // params.blocks for i in range(params.blocks + 1)]
    masks = []
    for chosen in combinations(range(params.blocks), params.blocks - params.radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)]


def links(nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """(a, b): stars that connect all distinct fingerprints (column fp) which are within the radius of each other."""
    if params.radius >= params.blocks:
        raise ValueError("blocks must exceed the radius")
    keyed = nodes.select("fp", F.explode(F.array(*_keys(params))).alias("key")).select("fp", "key.k", "key.bits")
    counted = keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    counted = counted.select("k", "bits", F.ceil(F.col("c") / params.tree).cast("int").alias("trees"))
    cells = keyed.join(counted, ["k", "bits"])  # fingerprints alone in their shard have no link there
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    cells = cells.withColumn("own", own).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    cells = cells.select("k", "bits", F.least("own", "u").alias("lo"), F.greatest("own", "u").alias("hi"), "fp")
    names = ["k", "bits", "lo", "hi"]

    def search(batches):
        """Whole groups, in pieces of about 50 000 rows; a group has two trees at most."""
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool):
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            start = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)])
            cut = len(cols[0]) if last else int(start[-1])
            number = np.zeros(cut, np.int64)
            number[start[start < cut]] = 1
            got = stars(cols[4][:cut].view(np.uint64), np.cumsum(number), params.radius) if cut else (np.zeros(0, np.uint64),) * 2
            held[:] = [[c[cut:] for c in cols]]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
                rows += batch.num_rows
            if rows >= 50_000:
                yield flush(False)
                rows = len(held[0][0])
        if rows:
            yield flush(True)

    ordered = cells.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names)
    return ordered.select(*names, "fp").mapInArrow(search, "a long, b long").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each a of edges (a, b) has one b, which is no a itself."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"))))
    seen = edges.select(ends.alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return seen.filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint in edges (a, b), root the smallest of its component.

    Rounds of large-star and small-star, until only stars are left, which a round would not change. Their number
    grows with the logarithm of the components' size. Each half of a round leaves a written table, so that nothing
    is computed twice and plans stay small: planning is most of what the rounds take of the driver's memory.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not are_stars(now):
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = now.select(both.alias("e")).groupBy(F.col("e.a").alias("b")).agg(F.least(F.min("e.b"), F.col("b")).alias("m"))
        large = materialize(now.join(low, "b").select("a", F.col("m").alias("b")), "links")
        drop(edges.sparkSession, now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct(), "links")
        drop(edges.sparkSession, large)
    return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def group(prints: DataFrame, params: Params = Params()) -> DataFrame:
    """component_id for each distinct fp of prints (doc_id, fp): the smallest doc_id reachable by links.

    Null ids are passed over where the component has another id. Equal fingerprints count once in the search,
    so a group of copies costs as much as one text.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, params))
    linked = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def cluster(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document."""
    flat = fingerprints(docs.select("doc_id", "text"), params).select(F.col("row.doc_id").alias("doc_id"), "fp")
    prints = materialize(flat, "simhash-prints")
    found = group(prints, params)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
