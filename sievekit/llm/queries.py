"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, chat, licenses, lm, mixing, packing, quality_classifier, quality_rules, repair, sharding, simhash, spelling, topk
from sievekit.llm.common import materialize, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, ["doc_id"])
    back = bpe.decode(coded.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "token_ids"), path)
    return back.select(
        "row.doc_id", "row.n_tokens", F.sha2("row.token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    made = chat.format_records(chat.conversation_records(rows.unionByName(extra)))
    flat = made.select(F.col("row.conv_id").alias("conv_id"), "formatted", "loss_spans")
    return chat.read_back(flat).select("row.conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    slim = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.steps(materialize(slim, "pack-pieces")).select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_bpe, op4_topk, op5_chat_format, op6_simhash, op7_quality_rules, op8_lm_score, op9_mixing, op10_sharding, op11_spelling, op12_packing, op13_repair)}

ORACLES: dict[str, str] = {}

ORACLES["op4_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES["op5_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
      length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + 2 * CAST(list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '[ROLE=', '[/ROLE]'], lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS BIGINT) AS body,
      CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\]]', '', 'g')) END AS marks FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + marks) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

ORACLES["op7_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c, lead(a, 3) OVER s AS e, lead(a, 4) OVER s AS f FROM x WINDOW s AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE f IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c, e, f) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(p.n, 0) > 20 * len(w) AS base_failed FROM w LEFT JOIN p USING (rid)),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM m GROUP BY source),
a AS (SELECT sum(n) AS sn, sum(failed) / sum(n) AS mean, count(*) AS k, sum(n * (failed / n) * (failed / n)) AS sq FROM h),
b AS (SELECT mean, CASE WHEN k > 1 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / greatest(sq / sn - mean * mean, 1e-9) - 1, 1.0), 1e6) ELSE 1.0 END AS strength FROM a),
j AS (SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.6 AS kept, round(rate, 6) AS host_rate
FROM m JOIN j ON m.source IS NOT DISTINCT FROM j.source
"""

# crc32 of a text, byte by byte through the table of the reflected polynomial; near words share a key: a letter blanked at one place, or left out
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE t0(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t0 WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS tab FROM t0 WHERE k = 8),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT))), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS h FROM d, t),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM h GROUP BY 1),
w AS (SELECT word, CAST(n AS BIGINT) AS n FROM c WHERE length(word) >= 6 AND n >= 5),
p AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT x.word, y.word AS other FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT x.word, w.word FROM p x JOIN w ON x.a || x.b = w.word UNION SELECT w.word, x.word FROM p x JOIN w ON x.a || x.b = w.word),
g AS (SELECT e.word, count(*) AS n_near, min((-w.n, e.other)) AS best FROM e JOIN w ON w.word = e.other GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN g USING (word)),
s(word, root) AS (SELECT word, coalesce(form, word) FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.root AND f.form IS NOT NULL),
z AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root AND f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN z USING (word)
"""
