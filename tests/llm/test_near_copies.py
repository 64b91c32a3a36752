"""Near copies against brute-force Jaccard similarity."""

import random
from collections import Counter

import corpus_pipeline as P


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def texts():
    """Texts with edits that leave similarities on both sides of 0.8, chains of copies, and short ones."""
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.randint(4, 300))]
        rows.append(words)
        rows += [edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(4)]
        rows.append(edited(rng, rows[-1], 0.01))
    return [(i, " ".join(w), "s") for i, w in enumerate(rows)] + [(1000, "", "s"), (1001, None, "s"), (1002, "A b", "s"), (1003, "a B", "s"), (1004, "a c", "s")]


def want(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 10 * both >= 8 * (len(a) + len(sets[j]) - both):
                links[both < 0.9 * (len(a) + len(sets[j]) - both)] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert links[True] > 50  # pairs between 0.8 and 0.9
    return {rows[find(i)][0] for i in range(len(rows))}


def test_stage_keeps_one_of_each_by_exact_similarity(spark):
    rows = texts()
    got = P.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert Counter(r.doc_id for r in got.collect()) == Counter(want(rows))


def test_blocks_agree_with_the_whole(spark):
    from sievekit.llm import near_copies

    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in near_copies.keep_one(docs, near_copies.Params(block=2)).collect()} == want(rows)


def test_cells_agree_with_the_whole(spark):
    """A hub whose edges fill many cells, and groups that need the third pass: near copies whose hub is alike to none or a few."""
    from sievekit.llm import near_copies

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.005, 0.03, 0.08]))), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (1024, 7):
        assert {r.doc_id for r in near_copies.keep_one(docs, near_copies.Params(block=block)).collect()} == want(rows)


def test_recall_on_documents(spark):
    """Of all pairs of different texts of documents at 0.8 or more, found by brute force, at least 0.99 end in one component."""
    from sievekit.llm import near_copies
    from sievekit.llm.common import materialize, table

    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    prints = materialize(near_copies.sketches(docs), "test-prints")
    of = {r.sid: r.component_id for r in near_copies.group(docs, prints).collect()}
    sid = {r.doc_id: r.sid for r in prints.collect()}
    sets = {sid[r.doc_id]: shingles(r.text) for r in docs.collect()}
    where, shared = {}, Counter()
    for k, one in sets.items():
        for x in one:
            where.setdefault(x, []).append(k)
    for owners in where.values():
        shared.update((a, b) for i, a in enumerate(owners) for b in owners[:i])
    near = [(a, b) for (a, b), n in shared.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    assert near and sum(of[a] == of[b] for a, b in near) >= 0.99 * len(near)


def test_scratch_goes(spark):
    """What keep_one wrote on its way is dropped, and its result can still be read."""
    import os

    from sievekit.llm import common, near_copies

    docs = spark.createDataFrame(texts(), "doc_id long, text string, source string")
    with common.scratch(spark) as used:
        got = near_copies.keep_one(docs)
        left = [p for p in used.paths if os.path.exists(p.removeprefix("file://"))]
        assert len(used.paths) > 15 and len(left) <= 5 and got.count()
    assert not any(os.path.exists(p.removeprefix("file://")) for p in used.paths)


def test_fingerprints_and_trees_find_the_closest(spark):
    """Near copies whose fingerprints are within the radius come from SimHash and BK-trees: each stands beside a set of its component of fingerprints."""
    from sievekit.llm import near_copies
    from sievekit.llm.common import materialize

    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = materialize(near_copies.sketches(docs), "test-prints").filter("size > 0").dropDuplicates(["sid"])
    fp = {r.sid: r.fp & (1 << 64) - 1 for r in prints.collect()}
    got = {(r.sid, r.hub) for r in near_copies.fingerprint_spokes(prints, near_copies.Params()).collect()}
    near = {(a, b) for a in fp for b in fp if b < a and (fp[a] ^ fp[b]).bit_count() <= 3}
    size, root = {r.sid: r.size for r in prints.collect()}, {s: s for s in fp}
    for a, b in near:
        x, y = root[a], root[b]
        root = {s: min(x, y) if r in (x, y) else r for s, r in root.items()}
    assert len(got) > 20
    assert got == {(s, r) for s, r in root.items() if s != r and 1000 * min(size[s], size[r]) >= 800 * max(size[s], size[r])}


def test_components_plan_little(spark):
    """Components are those of a plain search; edges that are stars already cost no round, and a long path and a dense graph few jobs."""
    from sievekit.llm.simhash import components

    rng = random.Random(4)
    stars = [(10 * i + k, 10 * i) for i in range(40) for k in range(1, 9)]
    path = [(k + 1, k) for k in range(1000, 1200)]
    mess = [(rng.randrange(-500, 0), rng.randrange(-500, 0)) for _ in range(700)] + [(-7, -7), (-8, -9), (-9, -8)]
    sc = spark.sparkContext
    for edges, most in ((stars, 6), (stars + path + mess, 80), ([], 6)):
        root = {v: v for e in edges for v in e}
        for a, b in edges:
            x, y = root[a], root[b]
            root = {v: min(x, y) if r in (x, y) else r for v, r in root.items()} if x != y else root
        rows = spark.createDataFrame(rng.sample(edges, len(edges)), "a long, b long").repartition(5)
        sc.setJobGroup(f"components-{most}-{len(edges)}", "")
        got = components(rows)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"components-{most}-{len(edges)}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert Counter((r.fp, r.root) for r in got.collect()) == Counter((v, r) for v, r in root.items() if v != r)
        assert 0 < jobs <= most
