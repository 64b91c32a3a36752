"""Spelling variants against a plain computation over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sievekit.llm import queries as Q
from sievekit.llm import spelling
from sievekit.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def edits(w):
    """All keys that two words share if and only if they are one edit apart or equal: one letter left out, or blanked."""
    return {(i, w[:i] + "?" + w[i + 1 :]) for i in range(len(w))}, {w[:i] + w[i + 1 :] for i in range(len(w))}


def expected(n):
    blanked, near = {}, {w: set() for w in n}
    for w in n:
        swaps, cuts = edits(w)
        for key in swaps:
            blanked.setdefault(key, []).append(w)
        for other in cuts & n.keys():
            near[w].add(other)
            near[other].add(w)
    for group in blanked.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "odd"])
def test_query_equals_all_pairs(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    want = expected(counted([(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]))
    got = Q.op11_spelling(spark, folder).collect()
    assert len(got) == len(want) and rows(spark.createDataFrame(got, "word string, form string, root string, n long, n_near long, form_n long")) == want


def vocabulary():
    """Families of words around common ones: chains of forms, ties, anagrams, neighbours across lengths and letters above ASCII."""
    rng = random.Random(4)
    letters = "abcdeéÿß×Àé"
    n = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        n[w] = rng.choice([5, 25, 125, 125, 700])
        for _ in range(8):
            x = list(rng.choice(list(n)[-3:]))
            at = rng.randrange(len(x))
            kind = rng.randrange(4)
            if kind == 0:
                x[at] = rng.choice(letters)
            elif kind == 1 and len(x) > 6:
                del x[at]
            elif kind == 2:
                x.insert(at, rng.choice(letters))
            else:
                x[at], x[at - 1] = x[at - 1], x[at]
            n.setdefault("".join(x), rng.choice([5, 6, 24, 25, 26, 125]))
    for i in range(12):  # a chain longer than two rounds of joins
        n["chain" + "x" * i + "yz"] = 5 * 5**i
    n["q" * 3000], n["q" * 2999] = 5, 25
    return n


@pytest.mark.parametrize("params", [{}, {"chunk": 7}, {"chunk": 3, "classes": 1}, {"classes": 5}])
def test_blocks_and_chunks_change_nothing(spark, params):
    n = vocabulary()
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.variants(words, spelling.Params(**params))) == expected(n)


def test_one_edit():
    import numpy as np

    of = lambda *w: spelling.codes(list(w))
    assert spelling.one_edit(of("abcd", "abcd", "abcd"), of("abce", "abdc", "abcd")).tolist() == [True, False, False]
    assert spelling.one_edit(of("abcd", "abcd", "aaaa", "abcd"), of("xabcd", "abcdd", "aaaaa", "abxdc")).tolist() == [True, True, True, False]
    assert np.array_equal(spelling.letter_counts(of("aab")).sum(), 3)


def test_empty(spark, empty):
    assert Q.op11_spelling(spark, empty).collect() == []
