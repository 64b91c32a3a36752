"""The language model against a plain mixer, and what its scores must not depend on."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.llm import lm

ALL = (1 << 64) - 1
SMALL = lm.Params(segment=64)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "Q"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    chain = {w: rng.sample(vocabulary, 3) for w in vocabulary}
    out = [rng.choice(vocabulary)]
    for _ in range(n - 1):
        out.append(rng.choice(chain[out[-1]]))
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    sample = [prose(1, 200)[i : i + 300].encode("utf-8", "ignore") for i in range(0, 1200, 300)]
    code = lm.Code.of(sample, replace(SMALL, tree_rows=20))
    table = np.zeros((1 << 11, 16), np.uint32)
    for s in lm.slices(pa.array([prose(1, 3000), None, "", "x"]), SMALL):
        lm.count_turns(s, code, table, 14)
    return lm.fit(code, 14, lm.states(*lm.turns_of(table)), sample, SMALL)


def costs(model, texts, params=SMALL):
    out, state = np.zeros(len(texts)), None
    for s in lm.slices(pa.array(texts), params):
        if s.at[0] == 0:
            state = model.start(len(s.row))
        out[s.row] += model.cost(s, *state, params)
    return out


def plain_cost(model, text):
    """One bit after the other, each context hashed anew."""
    d = [lm.END] * lm.PAD + list(text.encode()) + [lm.END]
    total = lambda b: sum(int(lm.SYMBOL[x]) * pow(lm.BASE, j, 1 << 64) for j, x in enumerate(b)) & ALL
    start = lambda i: max([j for j in range(max(1, i - 60), i + 1) if lm.WHITE[d[j - 1]]], default=0)
    weights, refined, cost, seg = model.weights.astype(float).copy(), model.refined.astype(float).copy(), 0.0, 0
    slope, many = np.zeros_like(weights), np.zeros(lm.GATES)
    errors, spreads = np.zeros(lm.BUCKETS), np.zeros(lm.BUCKETS)
    for at in range(len(d) - lm.PAD):
        if at == lm.bound(seg + 1, SMALL):
            weights += 0.5 * slope / (many + 200)
            refined += errors / (spreads + 20)
            for x in (slope, many, errors, spreads):
                x[:] = 0
            seg += 1
        i = at + lm.PAD
        tree = int(model.code.tree[d[i - 2] * 256 + d[i - 1]])
        tree = int(model.code.deep[lm.three_bytes(np.array([(d[i - 3] << 16) + (d[i - 2] << 8) + d[i - 1]], np.uint32))[0]]) or tree
        s = start(i)
        kind = 0
        if i - s <= lm.REACH:
            kind = (total(d[max(start(s - 1), s - 1 - lm.REACH) : s - 1]) * int(lm.MIX) & ALL) >> (64 - lm.KINDS)
        contexts = [total(d[i - k : i]) for k in lm.ORDERS] + [total(d[max(s, i - lm.WORD) : i]), kind]
        path, length = int(model.code.code[tree * 256 + d[i]]), int(model.code.length[tree * 256 + d[i]])
        for k in range(length):
            turn = path >> (31 - k) & 1
            g = k // 3 * 3
            done = (1 << g) + (path >> (32 - g) if g else 0)
            inside = (1 << (k - g)) + (path >> (32 - k) & ((1 << (k - g)) - 1) if k > g else 0)
            found = []
            for p, c in enumerate(contexts):
                h = (c + tree * int(lm.MIX) + done * int(lm.STEP) + int(lm.OWN[p])) * int(lm.MIX) & ALL
                found.append(int(model.table[(h >> (64 - model.bits + 3) << 3) + inside]))
            x = np.array([model.maps[p][f] for p, f in enumerate(found)], float)
            gate = int(lm.KNOWN[found[0]] * 4 + lm.KNOWN[found[1]])
            z = float(weights[:, gate] @ x)
            bucket = int(min(max(z + 12, 0), lm.BUCKETS - 1))
            chance = 1 / (1 + math.exp(-min(max(z + refined[bucket], -16), 16)))
            cost -= math.log2(chance if turn else 1 - chance)
            slope[:, gate] += (turn - chance) * x
            many[gate] += 1
            errors[bucket] += turn - chance
            spreads[bucket] += chance * (1 - chance)
    return cost


def test_plain_mixer(model):
    texts = [prose(1, 150), prose(3, 80), "", "q", "  \n two  blanks\té", "z" * 300, "The the THE " * 40]
    got = costs(model, texts)
    want = [plain_cost(model, t) for t in texts]
    assert np.allclose(got, want, rtol=2e-3, atol=0.05), (got, want)


def test_parts_of_long_texts_cost_what_whole_ones_do(model):
    texts = [prose(1, 4000), "w" * 9000, prose(5, 30)]
    assert np.allclose(costs(model, texts), costs(model, texts, replace(SMALL, slice_bytes=500)), rtol=1e-4)
    words = [sorted(h for s, _, hashes in lm.whole_words(lm.slices(pa.array(texts), replace(SMALL, slice_bytes=n))) for h in hashes.tolist()) for n in (1 << 19, 500, 77)]
    assert words[0] == words[1] == words[2] and len(set(words[0])) == len({w.lower() for t in texts for w in t.split(" ")})


def test_turns_are_counted_as_they_are_looked_up():
    """The sums over places are what counting each turn in its slot gives."""
    code = lm.Code.of([prose(1, 300).encode()], replace(SMALL, tree_rows=20))
    table, plain = np.zeros((1 << 9, 16), np.uint32), np.zeros((2, 1 << 12), np.int64)
    for s in lm.slices(pa.array([prose(1, 500), "éx" * 50, ""]), SMALL):
        lm.count_turns(s, code, table, 12)
        contexts, tree = s.contexts(code)
        here = lm.spread(s.begin, s.size)
        symbol = tree[here] + s.data[here]
        by = np.argsort(-code.length[symbol].astype(int), kind="stable")
        for _, turn, slots in lm.steps(contexts[:, here[by]], code.code[symbol[by]], code.length[symbol[by]], 12):
            for slot in slots:
                np.add.at(plain, (turn, slot), 1)
    zero, one = lm.turns_of(table)
    assert (zero == plain[0]).all() and (one == plain[1]).all() and one.sum() > 1000


def test_it_learns_while_it_codes(model):
    """A text that has a habit the training texts haven't costs less than with the start's weights throughout."""
    text = "Q9 " * 600
    assert costs(model, [text])[0] < costs(model, [text], replace(SMALL, segment=1 << 20))[0]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, prose(1, 250)[i * 7 :] if i % 3 else prose(1, 200)[i * 3 :]) for i in range(190)] + [(190, None), (191, ""), (192, prose(1, 9000))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_do_not_depend_on_partitions(corpus):
    params = lm.Params(task_bytes=1 << 16)  # several counting tasks
    got = [{r.doc_id: tuple(r) for r in lm.score(corpus.repartition(n), params).collect()} for n in (2, 9)]
    assert got[0].keys() == got[1].keys()
    for i, a in got[0].items():
        assert a[:5] == got[1][i][:5] and np.allclose(a[5:], got[1][i][5:], rtol=1e-6)


def test_words_in_another_order_score_worse(spark, corpus):
    rng, rows = random.Random(2), []
    for i in range(20):
        words = prose(1, 400)[i * 50 :].split(" ")
        rows.append((10_000 + 2 * i, " ".join(words)))
        rng.shuffle(words)
        rows.append((10_001 + 2 * i, " ".join(words)))
    both = corpus.unionByName(spark.createDataFrame([r for r in rows if r[0] % 2 == 1], "doc_id long, text string"))
    both = both.unionByName(spark.createDataFrame([r for r in rows if r[0] % 2 == 0], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.score(both).filter(F.col("doc_id") >= 10_000).collect()}
    assert sum(got[i] > got[i + 1] for i in range(10_000, 10_040, 2)) >= 18


def test_words_that_are_joined_count_as_broadcast_ones_do(corpus):
    """The base score does not depend on which words travel to every task."""
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(corpus, lm.Params(head=h)).collect()} for h in (500_000, 3))
    assert a == b


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 5000))
    order = np.argsort(keys.view(np.uint64))
    place = lm.Lookup(keys)(np.r_[keys[order], keys + 1])
    assert (place[: len(keys)] == np.arange(len(keys))).all() and (place[len(keys) :] == -1).all()
    assert (lm.Lookup(keys[:0])(keys[:3]) == -1).all()


def test_all_training_texts_teach_code_and_start(spark):
    """Long texts, copies and those beyond any sample: code and start are what sums over every training text give."""
    rows = [prose(i, 1000) for i in range(12)] + [prose(50, 20)] * 3 + ["zq" * 200, ""] * 2 + [f"{i} {prose(2, 9)}" for i in range(900)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").select(F.xxhash64("text").alias("key"), "text")
    assert min(len(t.encode()) for t in rows[:12]) > 4000
    params = lm.Params(task_bytes=1 << 15)  # several tasks
    got, _ = lm.train(docs, params)
    code = lm.Code.of([t.encode() for t in rows], params)
    for a, b in ((got.code.tree, code.tree), (got.code.deep, code.deep), (got.code.code, code.code), (got.code.length, code.length)):
        assert (a == b).all()
    halves = [[r["text"] for r in docs.collect() if r["key"] & 1 == h] for h in (0, 1)]
    tables = []
    for texts in halves:
        table = np.zeros((1 << got.bits >> 3, 16), np.uint32)
        for s in lm.slices(pa.array(texts), params):
            lm.count_turns(s, code, table, got.bits)
        tables.append(table)
    assert (got.table == lm.states(*lm.turns_of(tables[0] + tables[1]))).all()
    looked_up = [lm.states(*lm.turns_of(t)) for t in tables]
    one, many = np.zeros((2, lm.PREDICTORS, lm.STATES))
    for texts, table in zip(halves, looked_up[::-1], strict=True):
        for s in lm.slices(pa.array(texts), params):
            contexts, tree = s.contexts(code)
            here = lm.spread(s.begin, s.size)
            symbol = tree[here] + s.data[here]
            by = np.argsort(-code.length[symbol].astype(int), kind="stable")
            for _, turn, slots in lm.steps(contexts[:, here[by]], code.code[symbol[by]], code.length[symbol[by]], got.bits):
                for p, slot in enumerate(slots):
                    np.add.at(one[p], table[slot], turn)
                    np.add.at(many[p], table[slot], 1)
    share = 1 / (1 + np.exp(-got.maps))
    often = many > 200
    often[:, 0] = False
    assert often.sum() > 20 and np.allclose(share[often], (one / np.maximum(many, 1))[often], atol=0.01)


def test_many_turns_are_looked_up_in_one_go(model):
    """A text's turns come in one array, from one fetch of each context's block, and are what single slots hold."""
    part = next(lm.slices(pa.array([prose(1, 500), "éx" * 50, "", "\x00\x01" * 9]), SMALL))
    contexts, tree = part.contexts(model.code)
    here = lm.spread(part.begin, part.size)
    at, code, length = model.code.sorted(here, tree[here] + part.data[here])
    contexts = [c[at] for c in contexts]
    assert (np.diff(length.astype(int)) <= 0).all() and length[0] > 6
    assert lm.longer(length) == [int((length > k).sum()) for k in range(length[0] + 1)]
    sizes, turns, found = lm.looked_up(contexts, code, length, model.bits, model.table)
    single = list(lm.steps(contexts, code, length, model.bits))
    assert sizes == [n for s in single for n in s[0]] and sum(sizes) == length.sum() == len(turns)
    assert (turns == np.concatenate([s[1] for s in single])).all()
    for p in range(lm.PREDICTORS):
        assert found[p].dtype == np.uint8 and (found[p] == model.table[np.concatenate([s[2][p] for s in single])]).all()


def test_a_block_of_bytes_takes_one_fetch_for_each_predictor(model):
    """However many turns the longest path has, and with the same bytes as the slots of single steps."""
    fetches = []

    class Counted(np.ndarray):
        def take(self, *args, **kwargs):
            fetches.append(1)
            return super().take(*args, **kwargs)

    part = next(lm.slices(pa.array([prose(1, 300), "\x00\x01" * 9]), SMALL))
    contexts, tree = part.contexts(model.code)
    here = lm.spread(part.begin, part.size)
    at, code, length = model.code.sorted(here, tree[here] + part.data[here])
    contexts = [c[at] for c in contexts]
    _, _, found = lm.looked_up(contexts, code, length, model.bits, model.table.view(Counted))
    assert len(fetches) == lm.PREDICTORS and length[0] > 6
    for p in range(lm.PREDICTORS):
        assert (found[p] == model.table[np.concatenate([s[2][p] for s in lm.steps(contexts, code, length, model.bits)])]).all()


def test_counts_of_words_are_merged():
    rng = np.random.default_rng(4)
    some = [np.unique(rng.integers(-50, 50, n), return_counts=True) for n in (300, 0, 20)]
    some.append((np.array([-(1 << 63), (1 << 63) - 1]), np.array([2, 3])))
    keys, counts = lm.merged(*([x[i] for x in some] for i in (0, 1)))
    want = {}
    for k, c in some:
        for a, b in zip(k.tolist(), c.tolist()):
            want[a] = want.get(a, 0) + b
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (keys[1:] > keys[:-1]).all()
    assert [len(x) for x in lm.merged([keys[:0]], [counts[:0]])] == [0, 0]
