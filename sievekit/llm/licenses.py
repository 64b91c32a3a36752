"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased, cut into words and laid out as " word  word ": every word has a blank on each side, so
that a rule that begins and ends with a blank matches whole words and neighbours never share a blank. Rules
(license_rules, written by hand) are gated by keywords, taken from their patterns, of which the text must contain
one. What the rules match are intervals; an interval is dropped if another of the same or a higher priority
contains it, and of equal intervals the first rule's stays.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.license_rules import LATER, SIGNATURES, UNDER, VERSION

#: The plain phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: What is no word: everything below 0x80 but digits and small letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Priorities of rules: what says so itself, names with a version or the like, plain names.
PRIORITIES = 3


@dataclass(frozen=True)
class Rule:
    rank: int
    keywords: list[str]
    pattern: str
    label: str
    priority: int
    weight: float


def _spaced(pattern: str) -> str:
    """A pattern over words in the layout with two blanks between words and one at each end."""
    return " (?:" + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + ") "


def _alternatives(pattern: str) -> list[str]:
    """The pattern's parts between bars that are in no group."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _literals(pattern: str) -> list[list[str]]:
    """For each alternative of a spaced pattern, the pieces of the layout that all its matches contain: what lies outside groups, classes and optional letters."""
    found = []
    for part in _alternatives(pattern[4:-2]):
        fixed = re.sub(r"\[[^]]*\][?+]?|\.\{[0-9,]+\}|\w\?", "\0", part)
        while "(" in fixed:
            fixed = re.sub(r"\([^()]*\)\??", "\0", fixed)
        found.append(f" {fixed} ".split("\0"))
    return found


def _keywords(pattern: str) -> list[str]:
    """The longest literal of each alternative."""
    return [max(runs, key=lambda r: len(r.strip())) for runs in _literals(pattern)]


def signature_rules() -> list[Rule]:
    """The rules in order, the more certain ones of a priority first."""
    lines = [line.split(" ", 3) for line in SIGNATURES.strip().split("\n")]
    lines.sort(key=lambda x: (int(x[1]), -float(x[2])))
    rules = []
    for rank, (label, priority, weight, shape) in enumerate(lines):
        pattern = shape.replace("{v}", VERSION).replace("{l}", LATER).replace("{u}", UNDER)
        rules.append(Rule(rank, _keywords(_spaced(pattern)), _spaced(pattern), label, int(priority), float(weight)))
    return rules


#: Words too common to tell a license from other text.
COMMON = set("a an and any are as at be by can file for from has have in is it may must no not of on or org public same shall software terms that the this to under use version with you".split())


def _pieces(runs: list[str]) -> set[str]:
    """What may serve as the cue of an alternative with these literals."""
    pieces = {p for r in runs for p in re.findall(r" ?[^ ]+ ?", r)}
    longest = max(runs, key=len)
    rare = {p for p in pieces if len(p.strip()) > 2 and p.strip() not in COMMON}
    return rare or {f"{a}  {b}" for a, b in zip(longest.split(), longest.split()[1:])} or {longest}


def cues(rules: list[Rule]) -> list[str]:
    """A few words, or parts of one, of which every match of any rule contains one: the one that most open alternatives have comes first.

    Two words together are a cue where an alternative has common words only.
    """
    open_ = [_pieces(runs) for rule in rules for runs in _literals(rule.pattern)]
    found = []
    while open_:
        many = Counter(p for pieces in open_ for p in pieces)
        best = max(many, key=lambda p: (many[p], len(p), p))
        found.append(best)
        open_ = [pieces for pieces in open_ if not any(best in p for p in pieces)]
    return [c for c in found if not any(o != c and o in c for o in found)]


def _keywords_by_cue(rules: list[Rule]) -> dict[str, list[str]]:
    """For each cue the keywords of the alternatives whose matches all contain it; each alternative counts under one cue."""
    found = {c: set() for c in cues(rules)}
    for rule in rules:
        for keyword, runs in zip(rule.keywords, _literals(rule.pattern), strict=True):
            found[next(c for c in found if any(c in p for p in _pieces(runs)))].add(keyword)
    return {c: sorted(words) for c, words in found.items()}


#: Characters that Unicode's lower case turns into a-z, and a letter that it leaves alone.
KELVIN, DOTTED_I, LEFT_ALONE = "\u212a", "\u0130", "\u0138"
#: Put around matches; no word has them.
BEGIN, END = "\x01", "\x02"


def words_column(text: Column) -> Column:
    """The array of words, A-Z in lower case.

    Letters beyond A-Z may be lower-cased as well: no rule and no phrase has one, and they are parts of words either way.
    """
    lower = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(LEFT_ALONE)), F.lit(DOTTED_I), F.lit(LEFT_ALONE)))
    return F.array_remove(F.split(lower, NO_WORD, -1), "")


def _count_words(laid: Column) -> Column:
    """Words in a piece of the layout, which begins and ends with one blank: each word has two blanks."""
    return ((F.octet_length(laid) - F.octet_length(F.replace(laid, F.lit(" "), F.lit("")))) / 2).cast("long")


def _marked(text: Column, pattern: Column) -> Column:
    """What lies between the matches of a pattern and the matches, in turns; one piece if there is none."""
    return F.split(F.regexp_replace(text, pattern, F.lit(f"{BEGIN}$0{END}")), f"[{BEGIN}{END}]", -1)


def _intervals(text: Column, rule: Column) -> Column:
    """(start, minus end, priority, rank, label, weight) of every match of a rule, by the lengths of the pieces."""
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    placed = F.aggregate(
        _marked(text, rule["pattern"]),
        state,
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            (~acc["match"]).alias("match"),
            F.when(acc["match"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + F.length(piece)).alias("e"))))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return F.transform(placed, lambda i: F.struct(i["s"].alias("start"), (-i["e"]).alias("minus_end"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight")))


def _suppressed(raw: Column) -> Column:
    """The places of the detections, in order of start, that no other of the same or a higher priority contains; of equal ones the first stays."""
    ends = [f"e{p}" for p in range(PRIORITIES)]

    def step(acc, x):
        end, own = -x["minus_end"], x["priority"]
        free = F.lit(True)
        for p, e in enumerate(ends):
            free = free & ((own < p) | (acc[e] < end))
        return F.struct(
            *(F.when(own == p, F.greatest(acc[e], end)).otherwise(acc[e]).alias(e) for p, e in enumerate(ends)),
            F.when(free, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(raw, F.struct(*(F.lit(0).alias(e) for e in ends), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i")), step)["at"]


def detect(docs: DataFrame, rules: list[Rule] | None = None, gated: bool = True) -> DataFrame:
    """``row`` (the document) with n_words, the base places and the detections that stay.

    Null and empty texts have no words and no detection. Every place counts, however long the text. A text with
    none of the cues can match no rule; of the others only those rules run of which the text has a keyword (all run everywhere if not gated, with the same result).
    detections: array of (start, minus_end, priority, rank, label, weight), in order of start; the positions are
    characters of the layout.
    """
    rules = signature_rules() if rules is None else rules
    schema = "array<struct<rank:int,keywords:array<string>,pattern:string,label:string,priority:int,weight:double>>"
    listed = F.from_json(F.lit(json.dumps([r.__dict__ for r in rules])), schema)
    base_pattern = " (?:" + "|".join(p.replace(" ", "  ") for p, _ in BASE) + ") "
    laid, none = F.col("laid"), F.array().cast("array<string>")
    by_cue = _keywords_by_cue(rules)
    whole = [c for c in by_cue if re.fullmatch(" [^ ]+ ", c)]
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    has = lambda pieces: reduce(or_, (F.contains(laid, F.lit(p)) for p in pieces), F.lit(False))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    df = df.withColumn("words", words_column(F.col("row.text")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("laid", F.when(F.col("n_words") == 0, "").otherwise(F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))))
    last_words = strings(sorted({p.split()[-1] for p, _ in BASE}))
    df = df.withColumn("parts", F.when(F.arrays_overlap("words", last_words), _marked(laid, F.lit(base_pattern))).otherwise(none))
    # cues that are whole words are looked up among the words, the others in the layout; a keyword only where its cue was found
    some = F.arrays_overlap("words", strings(c.strip() for c in whole)) | has(c for c in by_cue if c not in whole)
    listed_cues = F.array(*(F.struct(F.lit(c).alias("cue"), strings(words).alias("keywords")) for c, words in by_cue.items()))
    wanted = F.array_distinct(F.flatten(F.transform(F.filter(listed_cues, lambda c: F.contains(laid, c["cue"])), lambda c: c["keywords"])))
    hits = F.filter(wanted, lambda w: F.contains(laid, w))
    df = df.withColumn("hits", F.when(some, hits).otherwise(none) if gated else F.array(F.lit("")))
    running = F.filter(listed, lambda r: F.arrays_overlap(r["keywords"], F.col("hits"))) if gated else listed
    df = df.withColumn("raw", F.when(F.size("hits") > 0, F.array_sort(F.flatten(F.transform(running, lambda r: _intervals(laid, r))))))
    df = df.withColumn("detections", F.transform(_suppressed(F.col("raw")), lambda i: F.get("raw", i)))
    phrase = F.create_map(*(F.lit(x) for p, label in BASE for x in (" " + p.replace(" ", "  ") + " ", label)))
    df = df.withColumn("found", F.filter("parts", lambda x, i: i % 2 == 1))
    return df.select(
        "row",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.when(F.size("found") > 0, _count_words(F.get("parts", F.lit(0)))).alias("first_word"),
        F.when(F.size("found") > 0, F.col("n_words") - _count_words(F.element_at("parts", -1)) - _count_words(F.element_at("found", -1))).alias("last_word"),
        F.transform(F.array_distinct("found"), lambda m: F.element_at(phrase, m)).alias("base_found"),
        "detections",
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places, labels and score, one row per document.

    score is the largest weight of a detection that stays; a base place alone weighs 0.6, nothing 0. No label: "".
    """
    got = detect(docs.select("doc_id", "text"))
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("detections", lambda d: d["label"]), none)
    weight = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return got.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_found", names)), ",").alias("labels"),
        F.greatest(weight, F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"),
    )
