"""The license scan against plain regular expressions, and the rules one by one."""

import re

import pytest
from pyspark.sql import functions as F

from sievekit.llm import licenses
from sievekit.llm import queries as Q
from tests.llm.test_queries import LOW, documents, folder, same_rows  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ZLIB = "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
LABELLED = {
    MIT: "mit",
    BSD: "bsd",
    ISC: "isc",
    ZLIB: "zlib",
    GPL: "gpl",
    "SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: EPL-2.0": "epl",
    "SPDX-License-Identifier: Zlib": "zlib",
    "SPDX-License-Identifier: BSL-1.0": "boost",
    "SPDX-License-Identifier: Artistic-2.0": "artistic",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "Code is MPL 2.0": "mpl",
    "WTFPL 2": "wtfpl",
    "CC0 1.0": "cc0",
    "BSD 3": "bsd",
    "CDDL 1.0": "cddl",
    "ISC 1": "isc",
    "CC BY 4.0": "cc-by",
    "CC BY-NC 4.0": "cc-by,cc-by-nc",
    "CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Creative Commons Attribution 4.0": "cc-by",
    "creative commons attribution (sharealike) 4.0": "cc-by-sa",
    "Open RAIL-M 1": "rail",
    "from MIT text the file": "",
    "permit a limit": "",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache",
    "placed in the public domain": "public-domain",
}


def plain(text, rules=None):
    """(start, end, priority, rank, label, weight) of the detections that stay: all rules run, each pair of matches compared."""
    words = WORD.findall((text or "").translate(LOW))
    laid = "".join(f" {w} " for w in words)
    found = [(m.start(), m.end(), r.priority, r.rank, r.label, r.weight) for r in rules or licenses.signature_rules() for m in re.finditer(r.pattern, laid)]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    return [a for a in found if not any(b != a and b[2] <= a[2] and inside(a, b) and (a[:2] != b[:2] or b[2:4] < a[2:4]) for b in found)]


def test_same_as_plain_expressions(spark, folder):  # noqa: F811
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for d, text in documents(spark, folder):
        if len(text or "") > 20_000:
            continue  # too slow here; test_op2 has its base columns
        words = " ".join(WORD.findall((text or "").translate(LOW)))
        own = {label for p, label in base.items() if f" {p} " in f" {words} "}
        stay = plain(text)
        want.append((d, ",".join(sorted(own | {x[4] for x in stay})), max([x[5] for x in stay] + [0.6] * bool(own), default=0.0)))
    got = Q.op2_license_scan(spark, folder)
    long = spark.read.parquet(f"{folder}/documents.parquet").filter(F.length("text") > 20_000).select("doc_id")
    same_rows([(r.doc_id, r.labels, r.score) for r in got.join(long, "doc_id", "left_anti").collect()], want)
    assert sum(bool(w[1]) for w in want) >= 3


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_known_texts(spark):
    assert dict(zip(LABELLED, scanned(spark, LABELLED), strict=True)) == LABELLED


def test_letters_that_only_unicode_lower_cases(spark):
    """The Kelvin sign is no k and the dotted I no i."""
    assert scanned(spark, ["MİT LİCENSE", "do what the fucK you want to public license", "É MIT LICENSE É"]) == ["", "", "mit"]


def test_containment_and_priority(spark):
    """A more certain detection suppresses what it contains; a weaker one that contains it does not; overlaps stay."""
    rule = lambda rank, priority, pattern, label: licenses.Rule(rank, licenses._keywords(licenses._spaced(pattern)), licenses._spaced(pattern), label, priority, 0.9)
    rules = [rule(0, 0, "b c", "inner"), rule(1, 2, "a b c d", "weak outer"), rule(2, 1, "c", "inside"), rule(3, 1, "c d e", "overlap"), rule(4, 0, "b c", "same"), rule(5, 2, "d", "in both")]
    docs = spark.createDataFrame([(0, "A b-c d e"), (1, "c"), (2, "x a b c d y d")], "doc_id long, text string")
    got = {r.i: [d.label for d in r.detections] for r in licenses.detect(docs, rules).select(F.col("row.doc_id").alias("i"), "detections").collect()}
    assert got == {0: ["weak outer", "inner", "overlap"], 1: ["inside"], 2: ["weak outer", "inner", "in both"]}
    for i, text in enumerate(["A b-c d e", "c", "x a b c d y d"]):
        assert sorted(x[4] for x in plain(text, rules)) == sorted(got[i])


@pytest.mark.parametrize("text", [None, "", " \n", "license " * 30_000])
def test_odd_texts(spark, text):
    assert scanned(spark, [text]) == [""]
