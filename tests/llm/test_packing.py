"""Packing: every id in one piece, windows full, whole results on odd and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievekit.llm import packing
from sievekit.llm import queries as Q
from sievekit.llm.common import table


def check(lengths, windows, params):
    covered = defaultdict(list)
    for window in windows:
        total = sum(n for _, _, n in window)
        assert 0 < total <= params.window and total & (total - 1) == 0
        for doc, start, n in window:
            assert n > 0
            covered[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, part in sorted(covered[doc]):
            assert start == at
            at += part
        assert at == n


@pytest.mark.parametrize("kind", ["mixed", "short", "long", "powers", "one", "same"])
def test_windows_hold_everything_once(kind):
    rng = random.Random(kind)
    draw = {"mixed": lambda: int(rng.paretovariate(0.7) * 30), "short": lambda: rng.randint(1, 40), "long": lambda: rng.randint(500, 9000), "powers": lambda: 1 << rng.randrange(13), "one": lambda: 1, "same": lambda: 700}[kind]
    params = packing.Params()
    for count in (0, 1, 2, 3, 10, 1000):
        lengths = [draw() for _ in range(count)]
        windows = packing.pack(lengths, params)
        check(lengths, windows, params)
        short = sum(sum(n for _, _, n in w) < params.least for w in windows)
        assert short <= 6  # only the last window of a cell is split below the shortest tier
        cuts = sum(map(len, windows)) - sum(max(1, -(-n // params.window)) for n in lengths)
        assert cuts <= len(windows) + 10  # one cut a window at most


def test_tiers_and_gaps():
    params = packing.Params(window=16, least=4)
    assert [packing.tier(n, params) for n in (1, 4, 5, 8, 9, 16)] == [4, 4, 8, 8, 16, 16]
    # 10 opens a window of 16, its gap of 6 takes 5 and then cuts 1 off the shortest that is longer; what is left fills itself
    assert packing.pack([10, 5, 3], params) == [[(0, 0, 10), (1, 0, 5), (2, 0, 1)], [(2, 1, 2)]]
    assert packing.pack([40], params) == [[(0, 0, 16)], [(0, 16, 16)], [(0, 32, 8)]]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "odd"])
def test_query_keeps_every_id_once(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    want = Counter((d, np.array(i, "<u4").tobytes()) for (d, _), i in zip(docs, library_ids([t for _, t in docs]), strict=True))
    got = [r.asDict() for r in Q.op12_packing(spark, folder).collect()]
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r)
    padding = 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and {r["context"] for r in own} == {at} and len({r["step"] for r in own}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    ids = defaultdict(list)
    for (d, i), times in want.items():
        ids[d, len(i) // 4].append((i, times))
    pieces = defaultdict(Counter)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
    assert pieces.keys() == ids.keys()
    for key, own in pieces.items():
        assert sum(n * c for (_, n, _), c in own.items()) == key[1] * sum(t for _, t in ids[key])
        for (start, n, crc), c in own.items():
            fits = sum(t for i, t in ids[key] if zlib.crc32(i[4 * start : 4 * (start + n)]) == crc)
            assert 0 < c <= fits


def test_steps_are_even(spark, sf):
    params = packing.Params(step_tokens=4096, cell_tokens=20_000)
    docs = table(spark, sf, "documents").repartition(5)
    made = packing.pack_documents(docs, Q.tokenizer_path(), params).collect()
    tokens, contexts = Counter(), defaultdict(set)
    for r in made:
        assert len(r.ids) == 4 * r.length and r.row.lang is not None and "text" not in r.row
        tokens[r.context, r.step] += r.length
        contexts[r.context].add(r.step)
    for context, own in contexts.items():
        assert own == set(range(len(own)))
        assert all(tokens[context, s] == 4096 for s in own if s != max(own))
    assert len({(r.sequence_id, r.offset) for r in made}) == len(made)


def test_empty(spark, empty):
    assert Q.op12_packing(spark, empty).collect() == []
