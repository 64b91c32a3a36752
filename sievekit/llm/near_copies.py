"""One document of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Near-dedup by SimHash: each text has a fingerprint of its shingles, and BK-trees find the fingerprints within the radius
(see simhash). What they connect is compared by exact sets. A radius that finds every pair at 0.8 (about ten bits differ) is
no filter for BK-trees, so the pairs beyond the radius come from MinHash: texts that agree on all rows of a band meet,
which pairs at 0.8 miss with a chance of 7 in a million and closer pairs less. Those are compared by their exact sets too
(see links), unless they are connected already. Links join documents to components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import simhash
from sievekit.llm.common import FEW_ROWS, drop, join_counted, join_per_key, map_rows, materialize, releasing, scratch, small_reads
from sievekit.llm.simhash import components, union


@dataclass(frozen=True)
class Params:
    """words: of a shingle. per_mille: least Jaccard similarity in thousandths, so that it is compared exactly.
    radius: bits by which fingerprints that BK-trees find differ at most. bands of rows hashes each. block, block_shingles: about the most texts and shingles of a block."""

    words: int = 5
    per_mille: int = 800
    radius: int = 3
    bands: int = 30
    rows: int = 5
    block: int = 512
    block_shingles: int = 500_000
    seed: int = 42


def shingles(text: str | None, params: Params = Params()) -> np.ndarray:
    """Ascending distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: just A-Z and the six white spaces
    if not words:
        return np.zeros(0, np.uint64)
    k, digest = params.words, xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    return np.unique(np.array([digest(s, params.seed) for s in parts], np.uint64))


def band_keys(params: Params = Params()):
    """A function from a set of hashes to the keys of its bands; an empty set has none."""
    rng = np.random.default_rng(params.seed)
    n = params.bands * params.rows
    times, flip = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    mix = rng.integers(0, 1 << 63, params.rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(n, np.iinfo(np.uint64).max)
        for i in range(0, len(hashes), 512):
            np.minimum(least, ((hashes[i : i + 512, None] ^ flip) * times).min(axis=0), out=least)
        return (least.reshape(params.bands, params.rows) * mix).sum(axis=1, dtype=np.uint64).view(np.int64)

    return keys


def sketches(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, text_hash, sid (of the set), size, fp (the set's fingerprint as a signed long) and keys, one row per document. The sets themselves stay behind."""

    def setup():
        keys = band_keys(params)

        def run(texts):
            sets = [shingles(t, params) for t in texts]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), params.seed) for s in sets], np.uint64).view(np.int64)
            fp = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            return pa.array(sid), [len(s) for s in sets], pa.array(fp), [keys(s) for s in sets]

        return run

    slim = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    flat = map_rows(slim, ["text"], setup, "sid long, size long, fp long, keys array<long>", ["doc_id", "text_hash"])
    return flat.select("row.doc_id", "row.text_hash", "sid", "size", "fp", "keys")


def sets_of(docs: DataFrame, wanted: DataFrame, params: Params = Params()) -> DataFrame:
    """(sid, hashes): the packed set of one text for each row of wanted (a written table: sid, of: the hash of its text)."""

    def setup():
        return lambda texts: [[shingles(t, params).tobytes() for t in texts]]

    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    if wanted.count() <= FEW_ROWS:
        once = texts.join(F.broadcast(wanted), F.col("text_hash") == F.col("of")).groupBy("sid").agg(F.first("text").alias("text"))
    else:  # copies go before anything is shuffled, so no key is hot
        once = texts.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, F.col("text_hash") == F.col("of"))
    return map_rows(once, ["text"], setup, "hashes binary", ["sid"]).select("row.sid", "hashes")


def similar(sets: list[np.ndarray], per_mille: int, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, whose Jaccard similarity is per_mille thousandths or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many > 1
    number = np.cumsum(shared) - 1
    stay = shared[place]
    owner, place = owner[stay], number[place[stay]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24 are exact
    for at in range(0, int(shared.sum()), columns):
        low, high = np.searchsorted(place, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        common += part @ part.T
    whole = np.triu(common, 1).astype(np.int64)
    i, j = np.nonzero(whole)
    both = whole[i, j]
    near = 1000 * both >= per_mille * (sizes[i] + sizes[j] - both)
    return i[near], j[near]


def met_groups(nodes: DataFrame) -> DataFrame:
    """(key, sid, size, hub, hub_size): the sets that meet another in a band, by the band's key; hub is the smallest of the key's."""
    keyed = nodes.select("sid", "size", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("sid", "size")).alias("h")).filter("c > 1")
    return keyed.join(hubs.select("key", F.col("h.sid").alias("hub"), F.col("h.size").alias("hub_size")), "key").select("key", "sid", "size", "hub", "hub_size")


def fingerprint_spokes(nodes: DataFrame, params: Params) -> DataFrame:
    """(sid, hub), a written table: each set whose fingerprint is connected to others by BK-trees, and the smallest set of that component, if their sizes fit."""
    whole = nodes.filter("size > 0").select("sid", "size", "fp")
    found = materialize(simhash.links(whole.select("fp").distinct(), simhash.Params(words=params.words, radius=params.radius)), "near-stars", 200)
    roots = components(found)
    named = whole.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    hubs = named.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("sid", "size")).alias("h")).filter("c > 1")
    hubs = hubs.select("root", F.col("h.sid").alias("hub"), F.col("h.size").alias("hub_size"))
    fits = 1000 * F.least("size", "hub_size") >= params.per_mille * F.greatest("size", "hub_size")
    out = materialize(named.join(hubs, "root").filter((F.col("sid") != F.col("hub")) & fits).select("sid", "hub"), "near-spokes")
    drop(nodes.sparkSession, found, roots)
    return out


def _hashes(packed) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def alike(edges: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """Those edges (sid, hub), a written table, whose sets (sid, hashes) are similar enough.

    A hub's edges are dealt to cells of about params.block; its set comes first in each, and the others stream past it.
    """
    cells = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / params.block).cast("int").alias("cells"))
    spokes = edges.join(cells, "hub").select("hub", F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("turn"), "sid")
    own = cells.select("hub", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("turn"), F.col("hub").alias("sid"))
    most = 2 * edges.count()  # no hub has more cells than edges
    rows = join_counted(sets, spokes.unionByName(own), "sid", rows=most).select("hub", "cell", "turn", "sid", "hashes")

    def compare(batches):
        at, whole = None, None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for hub, cell, turn, sid, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                part = _hashes(packed)
                if turn == 0:
                    at, whole = (hub, cell), part
                elif at == (hub, cell):
                    place = np.minimum(np.searchsorted(whole, part), len(whole) - 1)
                    both = int((whole[place] == part).sum())
                    if 1000 * both >= params.per_mille * (len(whole) + len(part) - both):
                        found[0].append(sid)
                        found[1].append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    ordered = rows.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "turn")
    return ordered.mapInArrow(releasing(compare), "a long, b long")


def alike_within(groups: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """(a, b): stars that connect all sets of a group (key, sid, size) which are similar enough. Large groups are cut into blocks, and every pair of blocks meets."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / params.block, F.sum("size") / params.block_shingles)).cast("int")
    cells = groups.join(groups.groupBy("key").agg(blocks.alias("blocks")), "key")
    cells = cells.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "u").alias("lo"), F.greatest("own", "u").alias("hi"), "sid")
    cells = join_counted(sets, cells, "sid").select("key", "lo", "hi", "sid", "hashes")
    names = ["key", "lo", "hi"]

    def search(batches):
        at, sids, found = None, [], []

        def out():
            labels = np.arange(len(sids))
            union(labels, *similar(found, params.per_mille))
            moved = np.flatnonzero(labels != np.arange(len(sids)))
            ids = np.array(sids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[labels[moved]])], names=["a", "b"])

        for batch in batches:
            for *key, sid, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != at:
                    if len(sids) > 1:
                        yield out()
                    at, sids, found = key, [], []
                sids.append(sid)
                found.append(_hashes(packed))
        if len(sids) > 1:
            yield out()

    ordered = cells.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names)
    return ordered.mapInArrow(releasing(search), "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """(a, b): a written table of stars that connect all sets (by sid) which are similar enough and have near fingerprints or share a band.

    First each set against the smallest one that BK-trees connect its fingerprint to. Then, for pairs beyond the radius,
    three passes, each over what the ones before left unconnected: each set against the smallest hub of its bands,
    then against its other hubs, then the sets that aren't hubs against each other inside their bands' groups.
    Sets that are connected already aren't compared again, so a large group of near copies costs a comparison a member.
    Pairs whose sizes alone rule them out are dropped before any set travels.
    """
    groups = materialize(met_groups(nodes), "near-groups")
    fits = 1000 * F.least("size", "hub_size") >= params.per_mille * F.greatest("size", "hub_size")
    spokes = materialize(groups.filter((F.col("sid") != F.col("hub")) & fits).select("sid", "hub").distinct(), "near-spokes")
    by_print = fingerprint_spokes(nodes, params)
    met = groups.select("sid").unionByName(by_print.select("sid")).unionByName(by_print.select(F.col("hub").alias("sid"))).distinct()
    wanted = nodes.join(met, "sid").select("sid", F.col("text_hash").alias("of"))
    sets = materialize(sets_of(docs, materialize(wanted, "near-wanted"), params), "near-sets", 200)
    close = materialize(alike(by_print, sets, params), "near-links", 200)
    roots = roots_of(close)
    apart = materialize(_apart(spokes, roots).select("sid", "hub"), "near-spokes")
    drop(docs.sparkSession, by_print, close, spokes)
    spokes = apart
    first = materialize(spokes.groupBy("sid").agg(F.min("hub").alias("hub")), "near-first")
    found = materialize(_stars(roots).unionByName(alike(first, sets, params)), "near-links", 200)
    drop(docs.sparkSession, roots)
    roots = roots_of(found)
    # what is left of the spokes
    rest = spokes.join(first, ["sid", "hub"], "left_anti")
    rest = materialize(_apart(rest, roots).select("sid", "hub"), "near-spokes")
    more = materialize(_stars(roots).unionByName(alike(rest, sets, params)), "near-links", 200)
    drop(docs.sparkSession, found, roots, spokes, first, rest)
    roots = roots_of(more)
    others = groups.filter("sid <> hub").select("key", "sid", "size").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = others.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("sid")).alias("x")).filter("lo <> hi")
    once = mixed.groupBy("c", "x").agg(F.min("key").alias("key")).select("key")  # bands with the same members
    open_ = materialize(groups.filter("sid <> hub").select("key", "sid", "size").join(once, "key"), "near-open")
    out = materialize(_stars(roots).unionByName(alike_within(open_, sets, params)), "near-links", 200)
    drop(docs.sparkSession, groups, sets, more, roots, open_)
    return out


def roots_of(edges: DataFrame) -> DataFrame:
    """(sid, root) of the sets in edges, written; what led to it is dropped."""
    return components(edges).withColumnRenamed("fp", "sid")


def _stars(roots: DataFrame) -> DataFrame:
    """Links (a, b) that connect what roots (sid, root) has connected."""
    return roots.select(F.col("sid").alias("a"), F.col("root").alias("b"))


def _apart(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges (sid, hub) whose ends have different roots (a set without one is its own)."""
    named = edges.join(roots.withColumnRenamed("root", "ra"), "sid", "left").join(roots.select(F.col("sid").alias("hub"), F.col("root").alias("rb")), "hub", "left")
    return named.filter(F.coalesce("ra", "sid") != F.coalesce("rb", "hub"))


def group(docs: DataFrame, prints: DataFrame, params: Params = Params()) -> DataFrame:
    """component_id for each distinct sid of prints (a written table of the sketches of docs): the smallest doc_id reachable by links.

    Null ids are passed over where the component has another id. Equal sets count once in the search.
    """
    nodes = prints.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "near-nodes")
    linked_by = links(docs, nodes, params)
    roots = roots_of(linked_by)
    drop(docs.sparkSession, linked_by)
    linked = nodes.select("sid", "first_id").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.select("sid", "root").join(smallest, "root").select("sid", "component_id")


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns.

    Rows that repeat a kept id leave one row, the first by a hash of the text. Rows without an id stay, unless
    their component has a document with one.
    """
    with scratch(docs.sparkSession) as used, small_reads(docs.sparkSession):
        prints = materialize(sketches(docs, params), "near-prints")
        grouped = prints.select("doc_id", "text_hash", "sid").join(group(docs, prints, params), "sid").drop("sid")
        found = used.keep(materialize(grouped, "near-found"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = F.col("row.doc_id")
    ids = materialize(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("rows")), "near-kept")
    kept = join_counted(packed, ids.filter("rows = 1").select("of"), own == F.col("of"), "left_semi")
    again = materialize(ids.filter("rows > 1").select("of"), "near-again")
    some = join_per_key(packed.filter(own.isNotNull()), own, again, "of", [F.xxhash64("row.text")], "inner")
    kept = kept.unionByName(some.groupBy("of").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), F.col("row.text"))).alias("row")).select("row"))
    alone = materialize(found.filter("doc_id IS NULL AND component_id IS NULL").select(F.col("text_hash").alias("of")).distinct(), "near-alone")
    nameless = packed.filter(own.isNull())
    nameless = join_per_key(nameless, F.xxhash64(F.coalesce("row.text", F.lit(""))), alone, "of", [F.monotonically_increasing_id()], "left_semi")
    return kept.unionByName(nameless).select("row.*")
