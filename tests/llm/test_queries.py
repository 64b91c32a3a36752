"""Each query against a plain computation, on a small table and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
import zstandard

from sievekit.llm import quality_classifier
from sievekit.llm import queries as Q

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=["sf", "odd"])
def folder(request, sf, odd):
    return {"sf": sf, "odd": odd}[request.param]


def documents(spark, folder, *more):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *more).collect()]


def same_rows(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def remainder(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def test_op1(spark, folder):
    docs = documents(spark, folder)
    got = Q.op1_quality_classifier(spark, folder).collect()
    same_rows([(r.doc_id, r.held_out) for r in got], [(d, remainder(d, 3) == 1) for d, _ in docs])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    again = Q.op1_quality_classifier(spark, folder).collect()
    same_rows(got, again)
    model = quality_classifier.fit(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
    packers = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    want = []
    for d, text in docs:
        data = (text or "").encode()
        parts = [data[i : i + 8192] for i in range(0, max(1, len(data)), 8192)]
        bad, good = (sum(len(p.compress(x)) for x in parts) for p in packers)
        want.append((d, round(1 / (1 + math.exp(-(model.slope * (bad - good) / (bad + good) + model.offset))), 9)))
    same_rows([(r.doc_id, round(r.score, 9)) for r in got], want)


def test_op1_learns(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in Q.op1_quality_classifier(spark, folder).collect() if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in rows if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if labels[r.doc_id] == 0])
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.92


def test_op2(spark, folder):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for d, text in documents(spark, folder):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        at, labels = [], set()
        for p, label in phrases.items():
            k = len(p.split())
            found = [i for i in range(len(words) - k + 1) if words[i : i + k] == p.split()]
            at += found
            labels |= {label} if found else set()
        want.append((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = Q.op2_license_scan(spark, folder).collect()
    same_rows([r[:6] for r in got], want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert all((r.labels == "") == (r.score == 0) for r in got)


def test_op3(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.tokenizer_path())
    library.no_padding()
    library.no_truncation()
    want = []
    for d, text in documents(spark, folder):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same_rows(Q.op3_bpe(spark, folder).collect(), want)


def test_op4(spark, folder):
    rows = {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows[r.vec_id, tuple(math.floor(256 * x) for x in v)] = None
    want = []
    for q, a in rows:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(b) == len(a))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    same_rows(Q.op4_topk(spark, folder).collect(), want)


def test_op5(spark, folder):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        turns[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    turns[-7] = [(True, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    want = []
    for c, own in turns.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        want.append((c, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = Q.op5_chat_format(spark, folder).collect()
    same_rows([r[:5] for r in got], want)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def prints(text):
    words = WORDS((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for j in range(64):
            ones[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(shingles))


def test_op6(spark, folder):
    docs = [(d, prints(t)) for d, t in documents(spark, folder)]
    fps = np.array(sorted({f for _, f in docs}), np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 3).tolist():
            label[root(j)] = root(i)
    at = {int(f): root(i) for i, f in enumerate(fps)}
    low = {}
    for d, f in docs:
        if d is not None:
            low[at[f]] = min(low.get(at[f], d), d)
    same_rows(Q.op6_simhash(spark, folder).collect(), [(d, f"{f:016x}", low.get(at[f])) for d, f in docs])


def test_op7(spark, folder):
    want = []
    for d, text in documents(spark, folder):
        text = text or ""
        words = WORDS(text)
        lines = [x for x in text.split("\n") if WORDS(x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        want.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(words) < 10 or 100 * len(again) > 20 * len(words)))
    got = Q.op7_quality_rules(spark, folder).collect()
    same_rows([r[:7] for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)
    assert sum(r.kept for r in got) >= 0.9 * sum(not r.base_failed for r in got)


def test_op8(spark, folder):
    docs = documents(spark, folder)
    split = {i: WORDS((t or "").translate(LOW)) for i, (_, t) in enumerate(docs)}
    counts = Counter()
    for i, (d, _) in enumerate(docs):
        if remainder(d, 5) != 1:
            counts.update([*split[i], None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, (d, _) in enumerate(docs):
        tokens = [*split[i], None]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want.append((-1 if d is None else d, remainder(d, 5) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    got = Q.op8_lm_score(spark, folder).collect()
    exact = lambda rows: sorted((tuple(r)[:5], round(r[5], 4)) for r in rows)
    for a, b in zip(exact([(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got]), exact(want), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    seen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert not seen or np.mean([r.bits_per_byte for r in seen]) < 6


def water(sizes, weights, share=Fraction(3, 2), cap=2):
    """Share by weight, stop at the cap, share the excess again."""
    budget, target, open_ = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (budget - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        for i in over or open_:
            target[i] = cap * sizes[i] if over else level * weights[i]
        open_ -= over or open_
    return target


def test_op9(spark, folder):
    docs = documents(spark, folder, "source")
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(WORDS(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    got = Q.op9_mixing(spark, folder).collect()
    same_rows([(r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got], [(d, len(WORDS(t or "")), size[s], round(float(goal[s]), 3)) for d, t, s in docs])
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    taken, most = defaultdict(int), defaultdict(int)
    from sievekit.llm import mixing

    for r in mixing.plan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")).collect():
        taken[r.source] += r.copies * r.mass
        most[r.source] = max(most[r.source], r.mass)
    assert sum(taken.values()) == sum(r.taken for r in got)
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in order)
    same_rows(got, Q.op9_mixing(spark, folder).collect())


def test_op10(spark, folder):
    docs = documents(spark, folder)
    got = Q.op10_sharding(spark, folder).collect()
    same_rows([r[:3] for r in got], [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs])
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(load.values()) / 24, max(r.size for r in got)
    assert all(abs(load[k] - mean) <= max(largest, 0.05 * mean) for k in range(24))


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == (1 if name.startswith("op5") else 0)


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_sql(spark, folder, odd, name):
    from tests.oracle import compare, connect

    compare(Q.QUERIES[name](spark, folder), connect(folder), Q.ORACLES[name])
