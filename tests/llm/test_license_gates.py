"""The gates of the license rules drop no text that a rule matches."""

import itertools
import re

from pyspark.sql import functions as F

from sievekit.llm import licenses

SHORT = {"MPL 2.0": "mpl", "CC BY-SA 4.0": "cc-by-sa", "CC0 1.0": "cc0", "CDDL 1.0": "cddl", "BSD 3": "bsd", "https://joinup.ec.europa.eu/collection/eupl": "eupl", "https://cdla.io": "cdla"}
SHORT |= {"https://creativecommons.org/licenses/by/4.0": "cc-by", "https://creativecommons.org/publicdomain/zero/1.0": "cc0", "licensed under Creative Commons Attribution Non-Commercial": "cc-by-nc", "licensed under Creative Commons Attribution NonCommercial": "cc-by-nc"}


def parts(tree):
    """A few strings of a parsed pattern: every branch once, optional parts left out and in."""
    out = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            got = [chr(value)]
        elif kind == "IN":
            got = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        elif kind == "ANY":
            got = ["x"]
        elif kind == "BRANCH":
            got = [s for b in value[1] for s in parts(b)]
        elif kind == "SUBPATTERN":
            got = parts(value[-1])
        else:
            got = ([""] if value[0] == 0 else []) + parts(value[2])
        n = max(len(out), len(got))
        out = [a + b for a, b in itertools.islice(zip(itertools.cycle(out), itertools.cycle(got)), n)] if len(out) * len(got) > 64 else [a + b for a in out for b in got]
    return out


def samples():
    for rule in licenses.signature_rules():
        for s in parts(re._parser.parse(rule.pattern)):
            yield rule, s


def test_keywords_and_cues_are_implied_by_the_patterns():
    n, cues = 0, licenses.cues(licenses.signature_rules())
    assert len(cues) < 90 and all(c.strip() for c in cues)
    for rule, s in samples():
        assert re.fullmatch(rule.pattern, s), (rule, s)
        assert any(w in s for w in rule.keywords) and any(c in s for c in cues), (rule, s)
        n += 1
    assert n > 1000


def test_gated_and_ungated_detections_agree(spark):
    some = {}
    for rule, s in samples():
        some.setdefault(rule.rank, s)
    texts = [*SHORT, *(" ".join(s.split()) for s in some.values())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rules = licenses.signature_rules()
    got, want = ({r.i: r.detections for r in licenses.detect(docs, rules, gated).select(F.col("row.doc_id").alias("i"), "detections").collect()} for gated in (True, False))
    assert got == want and all(got.values())
    for i, label in enumerate(SHORT.values()):
        assert label in {d.label for d in got[i]}, (texts[i], got[i])


def test_keywords_are_looked_for_where_their_cue_is():
    """Every match of an alternative has its cue and, under that, its keyword; no cue is found wherever another one is; few keywords hang on one word."""
    rules = licenses.signature_rules()
    by_cue = licenses._keywords_by_cue(rules)
    assert {w for words in by_cue.values() for w in words} == {w for r in rules for w in r.keywords}
    assert not any(a != b and a in b for a in by_cue for b in by_cue)
    for rule, s in samples():
        assert any(c in s and any(w in s and w in rule.keywords for w in words) for c, words in by_cue.items()), (rule, s)
    assert len(by_cue[" mit "]) < 20


def test_words_and_layout(spark):
    """Words at the edges, none at all, and blanks that are no word."""
    texts = ["--MIT, license--", "", None, " \n", "é-1", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in docs.orderBy("doc_id").select(licenses.words_column(F.col("text"))).collect()]
    assert got == [(["mit", "license"],), ([],), ([],), ([],), (["é", "1"],), (["a"],)]
    assert [r.n_words for r in licenses.scan(docs).orderBy("doc_id").collect()] == [2, 0, 0, 0, 2, 1]
