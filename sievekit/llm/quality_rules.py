"""Host-level quality rules.

Each document is held against a few counted rules. Failures are added up by host (the document's source),
each host's failure rate is shrunk towards the corpus by a beta prior fitted to the hosts themselves, and
the host's verdict is joined back: a document goes if it fails the base rules, or if its host as a whole is
beyond the allowed rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import join_per_key, map_rows, materialize

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Params:
    """max_host_rate: a host whose shrunk failure rate is above this loses all its documents."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.6


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window found at least twice, the first one included.

    Windows are grouped by a rolling hash; those that share a hash are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    member = np.zeros(n, bool)
    member[order[1:][same]] = True
    member[order[:-1][same]] = True
    starts: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(member).tolist():
        starts.setdefault(tuple(words[i : i + window]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int32)
    for at in starts.values():
        if len(at) > 1:
            a = np.array(at)
            np.add.at(edges, a, 1)
            np.add.at(edges, a + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None, params: Params) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows just the six ASCII white spaces
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, params.window),
    )


def annotate(docs: DataFrame, params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document, or its columns in keep) with the counts and ``base_failed``. A null text counts as empty."""

    def setup():
        return lambda texts: list(zip(*(measure(t, params) for t in texts), strict=True))

    counted = map_rows(docs, ["text"], setup, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", keep)
    return counted.withColumn("base_failed", (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words")))


def host_verdicts(failures: DataFrame, params: Params = Params()) -> DataFrame:
    """host, n, failed, rate (shrunk) and host_kept, from frames with ``host`` and ``base_failed``.

    The beta prior has the corpus' failure rate as its mean, and its strength is found from the variance of
    the hosts' rates by the method of moments. Hosts that all agree make a strong prior; a single host makes
    a prior worth one document. Documents without a host form a host of their own.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("sn"), F.sum("failed").alias("sf"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n"), 2)).alias("sq"))
    mean = F.col("sf") / F.col("sn")
    spread = F.greatest(F.col("sq") / F.col("sn") - mean * mean, F.lit(1e-9))
    strength = F.when((F.col("k") > 1) & (mean > 0) & (mean < 1), F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1.0)
    prior = total.select((mean * strength).alias("prior_failed"), strength.alias("prior_n"))
    # one row, joined as such
    judged = hosts.join(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("prior_failed")) / (F.col("n") + F.col("prior_n")))
    return judged.select("host", "n", "failed", "rate", (F.col("rate") <= params.max_host_rate).alias("host_kept"))


def judge(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, the counts, base_failed, the host's rate and kept: one row per document."""
    flat = annotate(docs.select("doc_id", "text", "source"), params, ["doc_id", "source"])
    flat = flat.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("host"), *flat.columns[1:])
    stats = materialize(flat, "quality-rules")
    verdicts = materialize(host_verdicts(stats, params).select(F.col("host").alias("of"), "rate", "host_kept"), "quality-hosts")
    out = join_per_key(stats, F.col("host"), verdicts, "of", [F.col("doc_id"), F.col("word_chars")])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.round("rate", 6).alias("host_rate"))


def keep_passing(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that pass the base rules and whose host passes, with their own columns."""
    marked = materialize(annotate(docs, params).select("row", "base_failed", "word_chars"), "quality-marked")
    bad = host_verdicts(marked.select(F.col("row.source").alias("host"), "base_failed"), params)
    bad = materialize(bad.filter(~F.col("host_kept")).select(F.col("host").alias("of")), "quality-hosts")
    passing = marked.filter(~F.col("base_failed"))
    return join_per_key(passing, F.col("row.source"), bad, "of", [F.col("row.doc_id"), F.col("word_chars")], "left_anti").select("row.*")
