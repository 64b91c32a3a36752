"""Each stage of the pipeline against a brute-force version of it, on what the stage before has kept."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline as P
from sievekit.llm import quality_classifier
from sievekit.llm import queries as Q
from sievekit.llm.common import join_per_key, materialize, table
from tests.llm.test_queries import WORDS, same_rows, water

COLUMNS = ("doc_id", "source", "text")


@pytest.fixture(scope="module", params=["sf", "odd"])
def stages(request, spark, sf, odd):
    """The folder, and the rows that go into each stage and come out of the last one."""
    folder = {"sf": sf, "odd": odd}[request.param]
    docs = table(spark, folder, "documents")
    names, seen = docs.columns, []
    for name, stage in P.STAGES:
        seen.append([tuple(r) for r in docs.select(*COLUMNS).collect()])
        docs = materialize(stage(spark, docs, folder), f"test-{name}")
        assert name == P.STAGES[-1][0] or docs.columns == names
    return folder, seen, [tuple(r) for r in docs.collect()]


def test_quality_classifier(spark, stages):
    folder, seen, _ = stages
    model = quality_classifier.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    difference = model.scorer()
    same_rows(seen[1], [r for r in seen[0] if model.probability(difference(r[2])) >= 0.5])


def fails(text):
    words = WORDS(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    return len(words) < 10 or 100 * len(again) > 20 * len(words)


def test_quality_rules(stages):
    _, seen, _ = stages
    bad = [fails(t) for _, _, t in seen[1]]
    n, failed = Counter(s for _, s, _ in seen[1]), Counter(s for (_, s, _), b in zip(seen[1], bad, strict=True) if b)
    total = sum(n.values())
    mean = sum(failed.values()) / total
    spread = sum(n[s] * (failed[s] / n[s]) ** 2 for s in n) / total - mean**2
    strength = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1), 1e6) if len(n) > 1 and 0 < mean < 1 else 1
    same_rows(seen[2], [r for r, b in zip(seen[1], bad, strict=True) if not b and (failed[r[1]] + mean * strength) / (n[r[1]] + strength) <= 0.6])


def test_simhash_dedup(stages):
    """One document of each component of texts whose five-word shingles have a similarity of 0.8 or more."""
    from tests.llm.test_near_copies import shingles

    _, seen, _ = stages
    texts = sorted({t or "" for _, _, t in seen[2]})
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (a and sets[j] and 10 * both >= 8 * (len(a) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, _, t in seen[2]:
        if d is not None:
            least[of[t or ""]] = min(least.get(of[t or ""], d), d)
    assert Counter(d for d, _, _ in seen[3] if d is not None) == Counter(dict.fromkeys(set(least.values()), 1))
    same_rows([r for r in seen[3] if r[0] is None], [r for r in seen[2] if r[0] is None and of[r[2] or ""] not in least])
    assert not Counter(seen[3]) - Counter(seen[2])


def test_mixing(stages):
    _, seen, _ = stages
    size, taken, most = Counter(), Counter(), defaultdict(int)
    for _, s, t in seen[3]:
        size[s] += len(WORDS(t or ""))
        most[s] = max(most[s], len(WORDS(t or "")))
    for _, s, t in seen[4]:
        taken[s] += len(WORDS(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], Fraction(3, 2)), strict=True))
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in order)
    whole = Counter(seen[3])
    assert all(k <= 2 * whole[r] for r, k in Counter(seen[4]).items())


def test_bpe(stages):
    from tokenizers import Tokenizer

    _, seen, out = stages
    library = Tokenizer.from_file(Q.tokenizer_path())
    library.no_padding()
    library.no_truncation()
    want = []
    for d, s, t in seen[4]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, s, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    same_rows([(d, s, n, hashlib.sha256(bytes(i)).hexdigest()) for d, s, n, i in out], want)


def test_run(spark, stages):
    folder, _, out = stages
    same_rows([(*r[:3], bytes(r[3])) for r in P.run(spark, folder).collect()], [(*r[:3], bytes(r[3])) for r in out])


def test_empty(spark, empty):
    assert P.run(spark, empty).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join(spark, how):
    """Broadcast and salted joins agree, with a hot key, null keys and keys without a row."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, "hot" if i % 3 else [None, "a", "none"][i % 9 // 3]) for i in range(600)], "id long, source string")
    per_key = materialize(spark.createDataFrame([("hot", 1), (None, 2), ("a", 3), ("b", 4)], "of string, x int"), "test-keys")
    got = [join_per_key(rows, F.col("source"), per_key, "of", [F.col("id")], how, few_rows=few) for few in (10, 0)]
    assert got[0].columns == got[1].columns
    same_rows(got[0].collect(), got[1].collect())
