import random

import pytest
from pyspark.sql import functions as F

LICENSES = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3", "CC BY-NC 4.0", "SPDX-License-Identifier: BSD-3-Clause"


def odd_documents():
    """Null and empty texts, ties, repeated rows, null ids and sources, control strings, a very long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéßñ漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(0, "", "en", "b"), (1, None, "en", "b"), (2, " \n\t \x0b\x0c\r", None, None), (3, "x", "en", "a"), (4, "Mit license mit license MIT-License", "en", "a")]
    rows += [(5, "<|endoftext|> it's <|endoftext|>x  y z 　 12½ ", "en", "a"), (6, "a\x00b \x00 c\x1cd\x85e", "en", "a"), (7, "Ａ Ⅷ ² ͸ \U000323b0 \U0001f600", "en", "é")]
    rows += [(8, prose(40_000) + " " + "mit license " * 3000, "en", "a"), (9, "q" * 3000 + " end", "en", "a"), (None, prose(30), "en", "a"), (None, prose(30), "en", None)]
    same = prose(60)
    rows += [(i, same, "en", "hot") for i in range(10, 40)] + [(40, same + " one", "en", "hot"), (41, same.upper(), "en", "hot")]
    rows += [(i, prose(rng.randint(1, 300)) + "\n" + rng.choice(LICENSES), "en", rng.choice("abcdhhh")) for i in range(50, 150)]
    rows += [rows[-1], rows[-1], (151, "same line\n\nsame line\n same line\n" * 4, "en", "a"), (152, "a b c d e f a b c d e f g a b c d e", "en", "a"), (-3, prose(20), "en", "zz")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of small tables with awkward rows and columns whose names clash."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("row", "fp", "size", "score", "n_words", "label", "shard", "source_size", "key", "n"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 3 and 1, 0, "x") for i in range(50, 150)] + [(50, 1, 0, "x"), (None, 1, 0, "x"), (60, None, 0, "x"), (9999, 1, 0, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
    rng = random.Random(7)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(0, 260)]
    vectors += [(i, [0.5] * 8, 0) for i in range(300, 420)] + [(500, None, 0), (501, [1.0, None], 0), (502, [float("nan")] * 8, 0), (550, [float("inf")] * 8, 0), (600, [], 0), (650, [], 0)]
    vectors += [(700, [1e6] * 3, 0), (701, [-1e6, 2.0, 1e6], 0), (-50, [0.25] * 8, 0), vectors[0], (None, [0.1] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s> \\ [/INST] [ROLE=x] </s>"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", ""), (3, 5, "tool]\\", "x\\"), (3, 2, "user", " a "), (3, 2, "user", " a "), (4, None, "assistant", "é퟿\n\n\x00"), (None, 0, "assistant", "[INST")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("payload", F.lit("p")).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at
