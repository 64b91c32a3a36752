"""Conversation repair against a search over all edits, and a plain search that keeps whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sievekit.llm import queries as Q
from sievekit.llm import repair
from sievekit.llm.common import table

WHITE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """(role, text, blank or duplicate, truncated) of each row in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        blank, again = not text.strip(WHITE), (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and text.rstrip(WHITE)[-1] not in ".!?"
        out.append((role, text, blank, again and not blank, cut))
    return out


GOOD = re.compile("(s?(ua)+)?")


def every_edit(marked):
    """The cheapest (cost, audit, repaired turns) by trying all edits with up to two inserts in each place."""
    best, names = None, {"u": "user", "a": "assistant"}
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    for edits in itertools.product("DKua", repeat=len(marked)):
        if any((m[2] or m[3]) and e != "D" for m, e in zip(marked, edits, strict=True)):
            continue
        cost = sum({"D": 3, "K": 0}.get(e, 2) + (m[4] and e != "D") for m, e in zip(marked, edits, strict=True))
        if best is not None and cost > best[0]:
            continue
        for places in itertools.product(inserts, repeat=len(marked) + 1):
            total = cost + 2 * sum(map(len, places))
            if best is not None and total > best[0]:
                continue
            turns, audit = [(names[i], "") for i in places[0]], "I" * len(places[0])
            for m, e, after in zip(marked, edits, places[1:], strict=True):
                if e != "D":
                    turns.append((m[0] if e == "K" else names[e], m[1]))
                audit += (e if e in "DK" else "R") + "I" * len(after)
                turns += [(names[i], "") for i in after]
            if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                found = (total, audit, "\n".join(f"{r}:{t}" for r, t in turns))
                best = found if best is None or found < best else best
    return best


def plain(marked):
    """The same by a search row by row that keeps whole audits, each with its repaired turns."""
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    now = {0: (0, "", [])}

    def inserted(held):
        for _ in range(3):
            for state, (cost, audit, turns) in list(held.items()):
                for i, name in (("u", "user"), ("a", "assistant")):
                    to = move.get((state, i))
                    new = (cost + 2, audit + "I", [*turns, (name, "")])
                    if to is not None and (to not in held or new[:2] < held[to][:2]):
                        held[to] = new
        return held

    for role, text, blank, again, cut in marked:
        after = {}

        def put(state, new, after=after):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, turns) in inserted(now).items():
            put(state, (cost + 3, audit + "D", turns))
            if not (blank or again):
                to = move.get((state, role[:1]))
                if to is not None:
                    put(to, (cost + cut, audit + "K", [*turns, (role, text)]))
                for i, name in (("u", "user"), ("a", "assistant")):
                    to = move.get((state, i))
                    if to is not None:
                        put(to, (cost + 2 + cut, audit + "R", [*turns, (name, text)]))
        now = after
    cost, audit, turns = min((v for s, v in inserted(now).items() if s in (0, 3)), key=lambda v: v[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)


def drawn(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "u", "", "system", "user"]), rng.choice(["a.", "b", "c!", " d ", "e", "f", f"{i}.", f"{i}"]), rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.3) for i in range(n)]


def test_plain_search_equals_every_edit():
    rng = random.Random(1)
    for _ in range(60):
        marked = drawn(rng, rng.randint(0, 3))
        assert plain(marked) == every_edit(marked)


@pytest.mark.parametrize("every", [1, 3, 64])
def test_forgetting_changes_nothing(every):
    rng = random.Random(2)
    for _ in range(400):
        marked = drawn(rng, rng.choice([0, 1, 2, 5, 9, 40]))
        walk = repair.Repair(every)
        for role, text, blank, again, cut in marked:
            walk.add(role, text, blank or again, cut)
        cost, audit, turns = plain(marked)
        assert walk.end() == (cost, audit, hashlib.sha256(turns.encode()).hexdigest())


def test_memory_is_what_is_open():
    walk, most = repair.Repair(), 0
    for i in range(20_000):
        walk.add(("user", "assistant")[i % 2] if i % 7 else "user", f"{i}.", i % 11 == 0, i % 5 == 0)
        most = max(most, walk.open)
    assert most <= 128 and len(walk.audit) > 19_000


def expected(rows):
    out = set()
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marked = faults(own)
        turns = sorted({r[1] for r in own} - {None})
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = plain(marked)
        out.add((conv, gaps, *(sum(m[k] for m in marked) for k in (2, 3, 4)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "odd"])
def test_query_equals_plain_search(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in Q.op13_repair(spark, folder).collect()} == expected(rows)


def test_rows_that_repeat_far_apart(spark):
    """One conversation of many rows in several batches: repeats, ties of turns, null turns and null roles, and one without rows left."""
    rng = random.Random(3)
    rows = [(1, rng.choice([None, *range(400)]), rng.choice(["user", "assistant", None, "system"]), rng.choice(["yes.", "no", None, f"text {i}."])) for i in range(900)]
    gone = next(i for i in range(10, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "x."), (None, 3, "user", "hi."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in repair.repair_damaged(df).collect()}
    assert got == expected(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_empty(spark, empty):
    assert Q.op13_repair(spark, empty).collect() == []
