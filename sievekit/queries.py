"""The registered queries of the library, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import vec
from sievekit.operators import cluster, distance, facility, metrics, nearest, represent, reweight, select, spectral, splits
from sievekit.plans import frames as P
from sievekit.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives of the labelled vectors, split into training and meta rows."""
    v = P.vectors(spark, sf_dir)
    ids = select.select_representatives(v, 20, 10)
    return splits.split_train_meta(v.withColumn("clean_label", F.col("label")), ids).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def r6(c):
    return F.round(c, 6)


def ids_of(df: DataFrame, every: int) -> DataFrame:
    return df.filter(F.col("sample_id") % every == 0)


# --- sources -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def s2_manifest(spark, sf):
    return tables.read_manifest(P.table(spark, sf, "labels").select("doc_id", "quality"), P.table(spark, sf, "documents"), "doc_id")


@query("SELECT d.doc_id AS sample_id, coalesce(l.toxic, 2) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def s3_overlay(spark, sf):
    docs = P.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.lit(2).alias("label"))
    return tables.overlay_labels(docs, P.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("label")))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 25.5) / 14.4, 6) AS a, round((l_discount - 0.05) / 0.03, 6) AS b FROM lineitem")
def s6_standardize(spark, sf):
    v = F.array("l_quantity", "l_discount")
    done = vec.standardize(v, F.array(F.lit(25.5), F.lit(0.05)), F.array(F.lit(14.4), F.lit(0.03)))
    return P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", done.alias("d")).select("l_orderkey", "l_linenumber", r6(F.col("d")[0]).alias("a"), r6(F.col("d")[1]).alias("b"))


# --- splits --------------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 9 ELSE label END AS label FROM l WHERE sample_id % 10 = 0 OR sample_id % 15 = 0")
def p1_subset(spark, sf):
    l = P.labelled(spark, sf).select("sample_id", "label")
    ids = l.filter("sample_id % 10 = 0 OR sample_id % 15 = 0")
    return splits.subset(l, ids, l.filter("sample_id % 2 = 0").withColumn("label", F.lit(9)))


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN label ELSE 4 - label END AS label, CASE WHEN sample_id % 7 = 0 THEN 'meta' ELSE 'train' END AS split FROM l")
def p2_split_train_meta(spark, sf):
    l = P.labelled(spark, sf).select("sample_id", (4 - F.col("label")).alias("label"), F.col("label").alias("clean_label"))
    return splits.split_train_meta(l, ids_of(l, 7)).select("sample_id", "label", "split")


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id FROM l ORDER BY {P.sql_ticket(3)}, sample_id LIMIT 500")
def p3_holdout_count(spark, sf):
    return splits.holdout_count(P.labelled(spark, sf), 500, 3).select("sample_id")


@query(f"WITH {P.SQL_LABELLED}, r AS (SELECT sample_id, row_number() OVER (ORDER BY {P.sql_ticket(4)}, sample_id) AS k FROM l) SELECT sample_id FROM r WHERE k <= floor((SELECT count(*) FROM l) * 0.1)")
def p4_holdout_rate(spark, sf):
    return splits.holdout_rate(P.labelled(spark, sf), 0.1, 4).select("sample_id")


_BY_CLASS = f"r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {P.sql_ticket(5)}, sample_id) AS k FROM l)"


@query(f"""WITH {P.SQL_LABELLED}, {_BY_CLASS}, c AS (SELECT label, count(*) AS c FROM l GROUP BY 1),
q AS (SELECT label, CAST(floor(333 * c / sum(c) OVER ()) AS BIGINT) AS q FROM c),
f AS (SELECT label, CASE WHEN label = max(label) OVER () THEN 333 - sum(q) OVER () + q ELSE q END AS quota FROM q)
SELECT sample_id, label FROM r JOIN f USING (label) WHERE k <= quota""")
def p5_holdout_by_class(spark, sf):
    return splits.holdout_by_class(P.labelled(spark, sf).select("sample_id", "label"), 333, 5)


@query(f"""WITH {P.SQL_LABELLED}, {_BY_CLASS}, q AS (SELECT label, CAST(floor(333 / count(*) OVER ()) AS BIGINT) AS q FROM (SELECT DISTINCT label FROM l)),
f AS (SELECT label, CASE WHEN label = max(label) OVER () THEN 333 - sum(q) OVER () + q ELSE q END AS quota FROM q)
SELECT sample_id, label FROM r JOIN f USING (label) WHERE k <= quota""")
def p5_holdout_equal(spark, sf):
    return splits.holdout_by_class(P.labelled(spark, sf).select("sample_id", "label"), 333, 5, equal=True)


@query(f"WITH {P.SQL_LABELLED}, {_BY_CLASS} SELECT sample_id, label FROM r WHERE k <= 45")
def p6_cap_per_class(spark, sf):
    return splits.cap_per_class(P.labelled(spark, sf).select("sample_id", "label"), 45, 5)


@query(f"""WITH {P.SQL_LABELLED}, {_BY_CLASS}, c AS (SELECT label, count(*) AS c FROM l GROUP BY 1),
q AS (SELECT label, floor(min(c) OVER () * pow(20.0, -(row_number() OVER (ORDER BY label) - 1) / (count(*) OVER () - 1))) AS quota FROM c)
SELECT sample_id, label FROM r JOIN q USING (label) WHERE k <= quota""")
def p7_long_tail(spark, sf):
    return splits.long_tail(P.labelled(spark, sf).select("sample_id", "label"), 20.0, 5)


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, label FROM l WHERE label = 0 UNION ALL SELECT sample_id, label FROM l WHERE label < 2")
def p8_concat(spark, sf):
    l = P.labelled(spark, sf).select("sample_id", "label")
    return splits.concat(l.filter("label = 0"), l.filter("label < 2"))


@query(f"""WITH {P.SQL_VECTORS}, i AS (SELECT i FROM (SELECT unnest(range(0, 64)) AS i) ORDER BY {P.sql_ticket(6, 'i')}, i LIMIT 8), k AS (SELECT list(i ORDER BY i) AS ks FROM i)
SELECT sample_id, round(list_sum(list_transform(ks, lambda j: vec[j + 1])), 6) AS total, round(vec[ks[1] + 1], 6) AS head FROM v, k""")
def p9_sample_columns(spark, sf):
    d = splits.sample_columns(P.vectors(spark, sf), 8, 64, 6)
    return d.select("sample_id", r6(vec.total(F.col("vec"))).alias("total"), r6(F.col("vec")[0]).alias("head"))


@query(f"""WITH {P.SQL_VECTORS}, i AS (SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY md5('6:' || b || ':' || i), i) AS r FROM (SELECT unnest(range(0, 2)) AS b), (SELECT unnest(range(0, 32)) AS i))
SELECT sample_id, round(sum(vec[32 * b + i + 1]) FILTER (b = 0), 6) AS first, round(sum(vec[32 * b + i + 1]) FILTER (b = 1), 6) AS second FROM v, i WHERE r <= 5 GROUP BY 1""")
def p9_sample_block_columns(spark, sf):
    v = P.vectors(spark, sf).withColumn("blocks", F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32)))
    d = splits.sample_block_columns(v, 5, [32, 32], 6)
    return d.select("sample_id", r6(vec.total(F.col("blocks")[0])).alias("first"), r6(vec.total(F.col("blocks")[1])).alias("second"))


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id FROM l WHERE sample_id % 3 <> 0 ORDER BY {P.sql_ticket(7)}, sample_id LIMIT 100")
def p10_fill_random(spark, sf):
    l = P.labelled(spark, sf)
    return splits.fill_random(l, ids_of(l, 3), 100, 7).select("sample_id")


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, CAST(label >= 2 AS INTEGER) AS label FROM l")
def p11_binarize(spark, sf):
    return splits.binarize_label(P.labelled(spark, sf)).select("sample_id", "label")


# --- label corruption ----------------------------------------------------------------------------------------

_HIT = f"h AS (SELECT sample_id, label, row_number() OVER (ORDER BY {P.sql_ticket(8)}, sample_id) <= floor((SELECT count(*) FROM l) * 0.2) AS hit FROM l)"


@query(f"WITH {P.SQL_LABELLED}, {_HIT} SELECT sample_id, CASE WHEN hit THEN CAST(floor({P.sql_uniform(9)} * 4) AS INTEGER) ELSE label END AS label FROM h")
def n1_flip_random(spark, sf):
    return splits.flip_random(P.labelled(spark, sf), 0.2, 5, 8).select("sample_id", "label")


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, CAST(least(len(list_filter(list_transform(range(1, 6), lambda j: round(0.06 * j + CASE WHEN j > label THEN 0.7 ELSE 0 END, 12)), lambda c: c <= {P.sql_uniform(8)})), 4) AS INTEGER) AS label FROM l")
def n2_flip_matrix(spark, sf):
    return splits.flip_matrix(P.labelled(spark, sf), splits.uniform_matrix(5, 0.3), 8).select("sample_id", "label")


@query(f"WITH {P.SQL_LABELLED}, {_HIT} SELECT sample_id, CASE WHEN hit THEN CAST((label + 1 + floor({P.sql_uniform(9)} * 4)) % 5 AS INTEGER) ELSE label END AS label FROM h")
def n3_flip_other(spark, sf):
    return splits.flip_other(P.labelled(spark, sf), 0.2, 5, 8).select("sample_id", "label")


@query(f"WITH {P.SQL_LABELLED}, {_HIT} SELECT sample_id, CASE WHEN hit THEN [3, 0, 4, 1, 2][label + 1] ELSE label END AS label FROM h")
def n4_flip_permute(spark, sf):
    return splits.flip_permute(P.labelled(spark, sf), 0.2, [3, 0, 4, 1, 2], 8).select("sample_id", "label")


# --- distances -----------------------------------------------------------------------------------------------

_NORM = "sqrt(list_inner_product({0}, {0}))"
_FLAT = "list_sum(list_transform({0}, lambda x: abs(x))) / " + _NORM
_DIST = {
    "l2": "sqrt(list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "abs_cos": f"1 - abs(list_inner_product(v.vec, c.vec)) / ({_NORM.format('v.vec')} * {_NORM.format('c.vec')})",
    "abs_cos_by_norm": f"1 - abs(list_inner_product(v.vec, c.vec)) / {_NORM.format('v.vec')}",
    "neg_cos": f"-list_inner_product(v.vec, c.vec) / ({_NORM.format('v.vec')} * {_NORM.format('c.vec')})",
    "abs_dot": "1 - abs(list_inner_product(v.vec, c.vec))",
    "cross": f"1 - ({_FLAT.format('v.vec')}) * ({_FLAT.format('c.vec')}) / 4096",
}
_CENTERS = "c AS (SELECT CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INTEGER) AS cluster_id, vec FROM (SELECT * FROM v ORDER BY sample_id LIMIT 10))"


def _pairs(metric: str) -> str:
    return f"d AS (SELECT v.sample_id, v.label, c.cluster_id, round({_DIST[metric]}, 9) AS dist FROM v, c)"


def _distance(name: str, metric: str):
    def run(spark, sf):
        v = P.vectors(spark, sf)
        return distance.pairs(v, cluster.first_seeds(v, 10), metric).select("sample_id", "cluster_id", "dist")

    run.__name__ = name
    query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs(metric)} SELECT sample_id, cluster_id, dist FROM d")(run)


for _name, _metric in (("d1_l2", "l2"), ("d3_abs_cos", "abs_cos"), ("d3_abs_cos_by_norm", "abs_cos_by_norm"), ("d5_neg_cos", "neg_cos"), ("d6_abs_dot", "abs_dot"), ("d7_cross", "cross")):
    _distance(_name, _metric)


@query(f"""WITH {P.SQL_VECTORS} SELECT v.sample_id, c.sample_id AS chosen_id, round((SELECT avg(x) FROM (SELECT unnest([
list_sum(list_transform(list_zip(v.vec[1:32], c.vec[1:32]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), list_sum(list_transform(list_zip(v.vec[33:64], c.vec[33:64]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))]) AS x)), 9) AS dist
FROM v, v c WHERE c.sample_id < 5""")
def d2_l2_blocks(spark, sf):
    v = P.vectors(spark, sf).withColumn("vec", F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32)))
    chosen = v.filter("sample_id < 5").select(F.col("sample_id").alias("chosen_id"), "vec")
    return distance.pairs(v, chosen, "l2_blocks", "chosen_id").select("sample_id", "chosen_id", "dist")


_NEAREST = "n AS (SELECT sample_id, label, arg_min(cluster_id, (dist, cluster_id)) AS cluster_id, min(dist) AS dist FROM d GROUP BY 1, 2)"


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST} SELECT sample_id, cluster_id, dist FROM n")
def d12_assign(spark, sf):
    v = P.vectors(spark, sf)
    return distance.assign(v, cluster.first_seeds(v, 10)).select("sample_id", "cluster_id", "dist")


_COVER = f"c AS (SELECT sample_id AS cluster_id, vec FROM v WHERE sample_id % 25 = 0), {_pairs('abs_cos')}, g AS (SELECT sample_id, min(dist) AS dist FROM d GROUP BY 1)"


@query(f"WITH {P.SQL_VECTORS}, {_COVER} SELECT sample_id, dist FROM g")
def d13_coverage(spark, sf):
    v = P.vectors(spark, sf)
    return distance.coverage(v, ids_of(v, 25)).select("sample_id", "dist")


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, r AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY sample_id ORDER BY dist, cluster_id))
SELECT cluster_id, max(dist) AS max_own, min(nxt) AS min_second FROM r WHERE r = 1 GROUP BY 1""")
def d15_cluster_spread(spark, sf):
    v = P.vectors(spark, sf)
    s = distance.cluster_spread(distance.pairs(v, cluster.first_seeds(v, 10), "abs_cos"))
    return s.select("cluster_id", "max_own", "min_second")


@query(f"""WITH {P.SQL_VECTORS}, d AS (SELECT a.label, a.sample_id AS id_a, b.sample_id AS id_b, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d2
FROM v a JOIN v b ON a.label = b.label AND a.sample_id < b.sample_id) SELECT label, id_a, id_b, round(max(d2) OVER (PARTITION BY label) - d2, 9) AS sim FROM d""")
def d10_class_similarity(spark, sf):
    return distance.class_similarity(P.vectors(spark, sf)).withColumn("sim", F.round("sim", 9))


@query(f"WITH {P.SQL_LINES}, {_CENTERS}, {_pairs('l2')}, {_NEAREST} SELECT sample_id, cluster_id, dist FROM n")
def d12_assign_lines(spark, sf):
    v = P.lines(spark, sf)
    return distance.assign(v, cluster.first_seeds(v, 10), "l2").select("sample_id", "cluster_id", "dist")


@query(f"WITH {P.SQL_LINES}, c AS (SELECT sample_id AS cluster_id, vec FROM v WHERE sample_id < 160), {_pairs('l2')}, g AS (SELECT sample_id, min(dist) AS dist FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY dist DESC, sample_id) AS r FROM g) SELECT sample_id, dist FROM r WHERE r <= floor((SELECT count(*) FROM v) / 4)")
def l11_farthest_lines(spark, sf):
    v = P.lines(spark, sf)
    return select.farthest_fraction(v, v.filter("sample_id < 160"), metric="l2")


@query(f"""WITH {P.SQL_LINES}, {_CENTERS}, {_pairs('l2')}, {_NEAREST},
m AS (SELECT cluster_id, i, avg(vec[i]) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)
SELECT c.cluster_id, CAST(k.i - 1 AS INTEGER) AS i, round(coalesce(m.x, c.vec[k.i]), 6) AS x FROM c CROSS JOIN (SELECT unnest(range(1, 5)) AS i) k LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.i = k.i""")
def c3_step_lines(spark, sf):
    v = P.lines(spark, sf)
    out = cluster.kmeans(v, cluster.first_seeds(v, 10), "l2", max_iter=1)
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


# --- clustering ----------------------------------------------------------------------------------------------


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST},
m AS (SELECT cluster_id, i, avg(vec[i]) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT cluster_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM m""")
def c3_lloyd_step(spark, sf):
    v = P.vectors(spark, sf)
    out = cluster.lloyd_step(v, cluster.first_seeds(v, 10))
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query()
def c3_kmeans(spark, sf):
    v = P.vectors(spark, sf)
    centers = cluster.kmeans(v, cluster.farthest_first(v, 10))
    return distance.assign(v, centers).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dist")).alias("mean_dist"))


@query(f"""WITH {P.SQL_VECTORS}, s0 AS (SELECT sample_id, vec FROM v ORDER BY sample_id LIMIT 1),
d1 AS (SELECT v.sample_id, v.vec, round({_DIST['abs_cos']}, 9) AS dist FROM v, s0 c WHERE v.sample_id <> c.sample_id), s1 AS (SELECT sample_id, vec FROM d1 ORDER BY dist DESC, sample_id LIMIT 1),
d2 AS (SELECT v.sample_id, min(round({_DIST['abs_cos']}, 9)) AS dist FROM v, (SELECT * FROM s0 UNION ALL SELECT * FROM s1) c WHERE v.sample_id NOT IN (SELECT sample_id FROM s0 UNION ALL SELECT sample_id FROM s1) GROUP BY 1),
s2 AS (SELECT sample_id FROM d2 ORDER BY dist DESC, sample_id LIMIT 1)
SELECT 0 AS cluster_id, sample_id FROM s0 UNION ALL SELECT 1, sample_id FROM s1 UNION ALL SELECT 2, sample_id FROM s2""")
def c1_farthest_first(spark, sf):
    return cluster.farthest_first(P.vectors(spark, sf), 3).select("cluster_id", "sample_id")


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST}, b AS (SELECT a.sample_id, a.cluster_id AS own, t.cluster_id AS theirs, round(list_distance(va.vec, vb.vec), 9) AS dist
FROM n a JOIN n t ON a.sample_id <> t.sample_id JOIN v va ON va.sample_id = a.sample_id JOIN v vb ON vb.sample_id = t.sample_id ),
m AS (SELECT sample_id, own, theirs, avg(dist) AS m FROM b GROUP BY ALL), s AS (SELECT sample_id, max(CASE WHEN own = theirs THEN m END) AS a, min(CASE WHEN own <> theirs THEN m END) AS b FROM m GROUP BY 1)
SELECT sample_id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS score FROM s""")
def c11_silhouette(spark, sf):
    v = P.vectors(spark, sf)
    one = distance.assign(v, cluster.first_seeds(v, 10))
    return cluster.silhouette(one, one).select("sample_id", r6(F.col("score")).alias("score"))


# --- representations -----------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted, round(list_max(probs), 6) AS top, round(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2], 6) AS gap, round(logp[1], 6) AS logp0 FROM p")
def r1_logit_scalars(spark, sf):
    z = F.col("logits")
    return P.logits(spark, sf).select("sample_id", vec.argmax(z).alias("predicted"), r6(F.array_max(vec.softmax(z))).alias("top"), r6(vec.top2_gap(vec.softmax(z))).alias("gap"), r6(vec.log_softmax(z)[0]).alias("logp0"))


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, round(vec[1] * probs[1], 6) AS first, round(vec[64] * probs[10], 6) AS last, CAST(640 AS INTEGER) AS width FROM p")
def r2_rank_one(spark, sf):
    d = P.logits(spark, sf).select("sample_id", vec.outer(F.col("vec"), vec.softmax(F.col("logits"))).alias("r"))
    return d.select("sample_id", r6(F.col("r")[0]).alias("first"), r6(F.element_at("r", -1)).alias("last"), F.size("r").alias("width"))


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, CAST(j AS INTEGER) AS j, round(probs[j + 1] - CASE WHEN j = label THEN 1 ELSE 0 END, 6) AS g FROM p, (SELECT unnest(range(0, 10)) AS j)")
def r3_ce_gradient(spark, sf):
    d = P.logits(spark, sf).select("sample_id", F.posexplode(vec.ce_gradient(F.col("logits"), F.col("label"), K)).alias("j", "g"))
    return d.withColumn("g", r6(F.col("g")))


# --- selection -----------------------------------------------------------------------------------------------

_SCORE = "round(-list_inner_product(logits, logp), 6) AS score"


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, {_SCORE} FROM p ORDER BY score DESC, sample_id LIMIT 20")
def l1_uncertain(spark, sf):
    return select.select_uncertain(P.logits(spark, sf), 20)


@query(f"WITH {P.SQL_LOGITS}, b AS (SELECT sample_id, -list_inner_product(logits, logp) AS s, (row_number() OVER (ORDER BY sample_id) - 1) // 32 AS batch FROM p) SELECT sample_id, round(avg(s) OVER (PARTITION BY batch), 6) AS score FROM b ORDER BY score DESC, sample_id LIMIT 40")
def l1_uncertain_by_batch(spark, sf):
    return select.select_uncertain(P.logits(spark, sf), 40, batch=32)


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, {_SCORE} FROM p ORDER BY score, sample_id LIMIT 20")
def l2_certain(spark, sf):
    return select.select_certain(P.logits(spark, sf), 20)


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, round(list_max(probs), 6) AS score FROM p ORDER BY score DESC, sample_id LIMIT 20")
def l3_confident(spark, sf):
    return select.select_confident(P.logits(spark, sf), 20)


_GAP = "round(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2], 6)"


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, {_GAP} AS score FROM p WHERE sample_id % 4 <> 0 ORDER BY score, sample_id LIMIT 20")
def l4_margin(spark, sf):
    z = P.logits(spark, sf)
    return select.select_margin(z, 20, ids_of(P.vectors(spark, sf), 4))


@query(f"""WITH {P.SQL_LOGITS}, r AS (SELECT sample_id, label, {_GAP} AS score FROM p WHERE list_position(logits, list_max(logits)) - 1 = label),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, sample_id) AS r FROM r WHERE score < 0.5) SELECT sample_id, label, score FROM k WHERE r <= 3""")
def l5_margin_by_class(spark, sf):
    return select.select_margin_by_class(P.logits(spark, sf), 30, K, 0.5)


_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, sample_id) AS r FROM {})"


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_RANK.format('d')} SELECT cluster_id, sample_id, dist FROM k WHERE r <= 5")
def l7_nearest_to_centers(spark, sf):
    v = P.vectors(spark, sf)
    return select.nearest_to_centers(v, cluster.first_seeds(v, 10), 50, 10)


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST}, {_RANK.format('n')} SELECT cluster_id, sample_id, dist FROM k WHERE r <= 5")
def l7_nearest_members(spark, sf):
    v = P.vectors(spark, sf)
    return select.nearest_to_centers(v, cluster.first_seeds(v, 10), 50, 10, members_only=True)


@query()
def l8_representatives(spark, sf):
    return select.select_representatives(P.vectors(spark, sf), 20, 10, 40)


@query(f"WITH {P.SQL_VECTORS}, {_COVER}, r AS (SELECT *, row_number() OVER (ORDER BY dist DESC, sample_id) AS r FROM g) SELECT sample_id, dist FROM r WHERE r <= floor((SELECT count(*) FROM v) / 4)")
def l11_farthest_fraction(spark, sf):
    v = P.vectors(spark, sf)
    return select.farthest_fraction(v, ids_of(v, 25))


@query(f"WITH {P.SQL_VECTORS}, {_COVER} SELECT sample_id, dist FROM (SELECT * FROM g WHERE sample_id % 25 <> 0 ORDER BY dist DESC, sample_id LIMIT 15)")
def l12_uncovered_top(spark, sf):
    v = P.vectors(spark, sf)
    return select.uncovered_top(v.filter("sample_id % 25 <> 0"), ids_of(v, 25), 15)


@query(f"WITH {P.SQL_VECTORS}, {_COVER} SELECT sample_id, dist FROM g WHERE dist > 0.6")
def l13_uncovered_radius(spark, sf):
    v = P.vectors(spark, sf)
    return select.uncovered_radius(v, ids_of(v, 25), 0.6)


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST}, e AS (SELECT v.sample_id, min(round({_DIST['abs_cos']}, 9)) AS cover FROM v, v c WHERE c.sample_id % 25 = 0 GROUP BY 1),
k AS (SELECT n.cluster_id, n.sample_id, cover, row_number() OVER (PARTITION BY n.cluster_id ORDER BY cover DESC, n.sample_id) AS r FROM n JOIN e USING (sample_id))
SELECT cluster_id, sample_id, cover FROM (SELECT * FROM k WHERE r = 1 ORDER BY cover DESC, sample_id LIMIT 6)""")
def l18_one_per_cluster(spark, sf):
    v = P.vectors(spark, sf)
    return select.farthest_one_per_cluster(v, cluster.first_seeds(v, 10), ids_of(v, 25), 6)


@query("WITH d AS (SELECT user_id AS sample_id, abs(round(sum(value - 50), 6)) AS score FROM events GROUP BY 1) SELECT sample_id, score FROM d ORDER BY score DESC, sample_id LIMIT 25")
def l19_weight_change(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), (F.col("value") - 50).alias("delta"))
    return select.select_by_weight_change(e, 25)


@query(f"""WITH {P.SQL_LABELLED}, c AS (SELECT label, count(*) AS c FROM l GROUP BY 1), s AS (SELECT label, 48 * c / sum(c) OVER () AS share FROM c),
r AS (SELECT label, floor(share) AS low, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label) AS rank, 48 - sum(floor(share)) OVER () AS rest FROM s)
SELECT label, CAST(1 + low + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS BIGINT) AS budget FROM r""")
def l20_class_budgets(spark, sf):
    return select.class_budgets(P.labelled(spark, sf), 53)


@query(f"WITH {P.SQL_VECTORS}, {_COVER} SELECT pick, count(*) AS gamma FROM (SELECT sample_id, arg_min(cluster_id, (dist, cluster_id)) AS pick FROM d GROUP BY 1) GROUP BY 1")
def l24_coreset_gamma(spark, sf):
    v = P.vectors(spark, sf)
    return select.coreset_counts(v, ids_of(v, 25))


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, value FROM (SELECT sample_id, value FROM l ORDER BY {P.sql_ticket(11)}, sample_id LIMIT 400) ORDER BY value, sample_id LIMIT 30")
def l27_pool_query(spark, sf):
    return select.pool_query(P.labelled(spark, sf).withColumn("score", F.col("value")), 30, 400, 11).select("sample_id", "value")


@query(f"WITH {P.SQL_LOGITS}, u AS (SELECT sample_id, {_SCORE} FROM p ORDER BY score DESC, sample_id LIMIT 10) SELECT sample_id, CASE WHEN sample_id IN (SELECT sample_id FROM u) THEN label ELSE 99 END AS label FROM p")
def l28_repair_labels(spark, sf):
    z = P.logits(spark, sf).withColumn("clean_label", F.col("label")).withColumn("label", F.lit(99))
    return select.repair_labels(z).select("sample_id", "label")


# --- weights -------------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_LABELLED} SELECT sample_id, round({P.sql_uniform(2)}, 9) AS w FROM l")
def w1_init_weights(spark, sf):
    return reweight.init_weights(P.labelled(spark, sf), seed=2).withColumn("w", F.round("w", 9))


@query(f"WITH {P.SQL_LABELLED}, g AS (SELECT sample_id, greatest(sqrt(-2 * ln(greatest({P.sql_uniform(2)}, pow(2, -33)))) * cos(2 * pi() * {P.sql_uniform(3)}), 0) AS w FROM l) SELECT sample_id, round(CASE WHEN sample_id % 4 = 0 THEN 0.25 ELSE w / (SELECT avg(w) FROM g) END, 6) AS w FROM g")
def w1_init_gaussian_cached(spark, sf):
    l = P.labelled(spark, sf)
    cached = ids_of(l, 4).select("sample_id", F.lit(0.25).alias("w"))
    return reweight.init_weights(l, "gaussian", 2, cached=cached).withColumn("w", r6(F.col("w")))


_GRAD = "list_transform(list_zip({}, range(0, 10)), lambda z: z[1] - CASE WHEN z[2] = label THEN 1 ELSE 0 END)"


@query(f"""WITH {P.SQL_LOGITS}, g AS (SELECT sample_id, label, vec, logits, {_GRAD.format('probs')} AS g FROM p),
s AS (SELECT j, list(x ORDER BY i) AS x FROM (SELECT i, j, avg(vec[i] * g[j] * 0.5) AS x FROM g, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 11)) AS j) WHERE sample_id % 10 <> 0 GROUP BY ALL) GROUP BY 1),
u AS (SELECT sample_id, label, vec, list(logits[j] - 0.1 * list_inner_product(vec, x) ORDER BY j) AS z FROM g, s WHERE sample_id % 10 = 0 GROUP BY 1, 2, 3),
q AS (SELECT label, vec, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM u), h AS (SELECT vec, {_GRAD.format('p')} AS g FROM q),
m AS (SELECT i, j, avg(vec[i] * g[j]) AS x FROM h, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL),
d AS (SELECT sample_id, sum(vec[i] * g[j] * x) AS d FROM g, m WHERE sample_id % 10 <> 0 GROUP BY 1)
SELECT sample_id, round(least(greatest(0.5 + 20 * (0.1 / 32) * d, 1e-7), 1), 6) AS w FROM d""")
def w2_meta_step(spark, sf):
    z = P.logits(spark, sf).withColumn("w", F.lit(0.5))
    out = reweight.meta_step(z.filter("sample_id % 10 <> 0"), z.filter("sample_id % 10 = 0"), K, 0.1, 20.0, 32)
    return out.withColumn("w", r6(F.col("w")))


@query("""WITH s AS (SELECT user_id AS sample_id, event_id AS epoch, value AS w FROM events), d AS (SELECT *, coalesce(w - lag(w) OVER (PARTITION BY sample_id ORDER BY epoch), 0) AS delta FROM s)
SELECT sample_id, epoch, round(delta, 6) AS delta, round(sum(delta) OVER (PARTITION BY sample_id ORDER BY epoch), 6) + 0 AS change FROM d""")
def w3_weight_deltas(spark, sf):
    s = P.table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("epoch"), F.col("value").alias("w"))
    return reweight.weight_deltas(s).withColumn("delta", r6(F.col("delta"))).withColumn("change", r6(F.col("change")) + 0)


@query("SELECT event_id, round(greatest(value - 50, 0) / sum(greatest(value - 50, 0)) OVER (PARTITION BY event_id // 100), 6) AS w FROM events")
def w4_normalize(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("w"), F.floor(F.col("event_id") / 100).alias("batch"))
    return reweight.normalize_weights(e, "sum").select("event_id", r6(F.col("w")).alias("w"))


@query("SELECT event_id, round(least(greatest(value / 50 - 0.5, 0), 1) / count(*) OVER (PARTITION BY event_id // 100), 6) AS clip, round(exp((value / 50 - max(value / 50) OVER w) / 0.7) / sum(exp((value / 50) / 0.7)) OVER w * exp(max(value / 50) OVER w / 0.7), 6) AS softmax FROM events WINDOW w AS (PARTITION BY event_id // 100)")
def w4_normalize_clip_softmax(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("batch"), (F.col("value") / 50).alias("x"))
    clip = reweight.normalize_weights(e.withColumn("w", F.col("x") - 0.5), "clip").select("event_id", r6(F.col("w")).alias("clip"))
    soft = reweight.normalize_weights(e.withColumn("w", F.col("x")), "softmax", temperature=0.7).select("event_id", r6(F.col("w")).alias("softmax"))
    return clip.join(soft, "event_id")


@query("SELECT event_id, round(greatest(value / 100 / 1.5 - 0.2, 1e-5), 6) AS w FROM events")
def w5_decayed_step(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("w"), F.lit(0.2).alias("grad"))
    return reweight.decayed_step(e, 1.5).select("event_id", r6(F.col("w")).alias("w"))


_OWN = "logp[label + 1]"
_LOSS = {
    "ce": f"-{_OWN}",
    "l1": "list_sum(list_transform(list_zip(probs, range(0, 10)), lambda z: abs(z[1] - CASE WHEN z[2] = label THEN 1 ELSE 0 END)))",
    "soft": f"-0.95 * {_OWN} - 0.05 * list_inner_product(probs, logp)",
    "hard": f"-0.95 * {_OWN} - 0.05 * list_max(logp)",
}


def _loss(kind: str):
    def run(spark, sf):
        return reweight.sample_loss(P.logits(spark, sf), kind, K).withColumn("loss", r6(F.col("loss")))

    run.__name__ = f"w7_loss_{kind}"
    query(f"WITH {P.SQL_LOGITS} SELECT sample_id, round({_LOSS[kind]}, 6) AS loss FROM p")(run)


for _kind in _LOSS:
    _loss(_kind)


@query(f"WITH {P.SQL_LOGITS} SELECT label, CAST(j - 1 AS INTEGER) AS j, round(avg(logits[j]), 6) AS x FROM z, (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL")
def w8_glc_matrix(spark, sf):
    return reweight.glc_matrix(P.logits(spark, sf)).select("label", F.posexplode("row").alias("j", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {P.SQL_LOGITS}, c AS (SELECT label AS k, list(x ORDER BY j) AS row FROM (SELECT label, j, avg(logits[j]) AS x FROM z, (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL) GROUP BY 1),
y AS (SELECT z.sample_id, z.label, j, sum(z.logits[k + 1] * c.row[j]) AS x FROM z, c, (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL), l AS (SELECT sample_id, label, list(x ORDER BY j) AS y FROM y GROUP BY 1, 2)
SELECT sample_id, round(ln(list_sum(list_transform(y, lambda e: exp(e - list_max(y))))) + list_max(y) - y[label + 1], 5) AS loss FROM l""")
def w8_glc_loss(spark, sf):
    z = P.logits(spark, sf)
    return reweight.glc_loss(z, reweight.glc_matrix(z)).withColumn("loss", F.round("loss", 5))


# --- evaluation ----------------------------------------------------------------------------------------------

_PRED = "CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER)"


@query(f"WITH {P.SQL_LOGITS}, s AS (SELECT count(*) AS n, avg(-{_OWN}) AS loss, count(*) FILTER ({_PRED} = label) AS correct FROM p) SELECT n, round(loss, 6) AS loss, correct, round(100 * correct / n, 6) AS accuracy FROM s")
def m1_evaluate(spark, sf):
    return metrics.evaluate(P.logits(spark, sf)).withColumn("loss", r6(F.col("loss"))).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"""WITH {P.SQL_LOGITS}, q AS (SELECT label AS y, {_PRED} AS p FROM p), o AS (SELECT sum((y - p) * (y - p)) AS d, count(*) AS n FROM q),
e AS (SELECT sum((a.y - b.p) * (a.y - b.p)) AS e FROM q a, q b) SELECT round(1 - d / (e / n), 6) AS kappa FROM o, e""")
def m2_kappa(spark, sf):
    z = P.logits(spark, sf).withColumn("predicted", vec.argmax(F.col("logits")))
    return metrics.quadratic_kappa(z).withColumn("kappa", r6(F.col("kappa")))


@query(f"""WITH {P.SQL_LOGITS}, s AS (SELECT label AS y, CAST(j AS INTEGER) AS label, round(logits[j + 1], 1) AS s FROM z, (SELECT unnest(range(0, 10)) AS j))
SELECT a.label, round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a JOIN s b ON a.label = b.label WHERE a.y = a.label AND b.y <> b.label GROUP BY 1""")
def m3_roc_auc(spark, sf):
    z = P.logits(spark, sf).withColumn("scores", F.transform("logits", lambda x: F.round(x, 1)))
    return metrics.roc_auc(z).withColumn("auc", r6(F.col("auc")))


@query(f"""WITH {P.SQL_LOGITS}, s AS (SELECT label AS y, CAST(j AS INTEGER) AS label, round(logits[j + 1], 1) AS s FROM z, (SELECT unnest(range(0, 10)) AS j)),
a AS (SELECT a.label, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM s a JOIN s b ON a.label = b.label WHERE a.y = a.label AND b.y <> b.label GROUP BY 1) SELECT round(avg(auc), 6) AS auc FROM a""")
def m3_macro_auc(spark, sf):
    z = P.logits(spark, sf).withColumn("scores", F.transform("logits", lambda x: F.round(x, 1)))
    return metrics.macro_auc(z).withColumn("auc", r6(F.col("auc")))


@query("WITH e AS (SELECT value / 100 AS p, CAST(user_id % 2 AS INTEGER) AS y FROM events), s AS (SELECT count(*) AS n, avg(-y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) - (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) AS loss, count(*) FILTER (CAST(p > 0.5 AS INTEGER) = y) AS correct FROM e) SELECT n, round(loss, 6) AS loss, correct, round(100 * correct / n, 6) AS accuracy FROM s")
def m1_evaluate_binary(spark, sf):
    e = P.table(spark, sf, "events").select((F.col("value") / 100).alias("output"), (F.col("user_id") % 2).cast("int").alias("label"))
    return metrics.evaluate_binary(e).withColumn("loss", r6(F.col("loss"))).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"WITH {P.SQL_LOGITS}, s AS (SELECT 1 + len(list_filter(logits, lambda x: x > logits[label + 1])) AS place FROM z) SELECT CAST(k AS INTEGER) AS k, round(100 * count(*) FILTER (place <= k) / count(*), 6) AS accuracy FROM s, (SELECT unnest([1, 5]) AS k) GROUP BY k")
def m4_topk_accuracy(spark, sf):
    return metrics.topk_accuracy(P.logits(spark, sf)).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"""WITH {P.SQL_VECTORS}, s AS (SELECT v.sample_id, c.sample_id AS near_id, c.label, -round({_DIST['neg_cos']}, 9) AS sim FROM v, v c WHERE v.sample_id % 10 = 0 AND c.sample_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY sim DESC, near_id) AS r FROM s), t AS (SELECT sample_id, label, round(sum(exp(sim / 0.5)), 6) AS votes FROM r WHERE r <= 20 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, label) AS r FROM t) SELECT sample_id, label AS predicted, votes FROM b WHERE r = 1""")
def m6_knn_vote(spark, sf):
    v = P.vectors(spark, sf)
    return metrics.knn_vote(ids_of(v, 10), v.filter("sample_id % 10 <> 0"), 20, 0.5)


@query(f"""WITH {P.SQL_VECTORS}, s AS (SELECT v.sample_id, v.label AS own, c.sample_id AS near_id, c.label, -round({_DIST['neg_cos']}, 9) AS sim FROM v, v c WHERE v.sample_id % 10 = 0 AND c.sample_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY sim DESC, near_id) AS r FROM s), t AS (SELECT sample_id, own, label, round(sum(exp(sim / 0.5)), 6) AS votes FROM r WHERE r <= 20 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, label) AS r FROM t), h AS (SELECT sample_id, coalesce(min(r) FILTER (own = label), 99) AS place FROM b GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, round(100 * avg(CASE WHEN place <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM h, (SELECT unnest([1, 5]) AS k) GROUP BY 1""")
def m6_knn_accuracy(spark, sf):
    v = P.vectors(spark, sf)
    return metrics.knn_accuracy(ids_of(v, 10), v.filter("sample_id % 10 <> 0"), 20, 0.5).withColumn("accuracy", r6(F.col("accuracy")))


_HIST = "h AS (SELECT user_id % 20 AS run, CAST(dayofyear(ts) AS INTEGER) AS epoch, round(avg(value), 3) AS metric, round(max(value), 3) AS test_metric FROM events GROUP BY 1, 2)"


def _history(spark, sf):
    e = P.table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 20).alias("run"), F.dayofyear("ts").alias("epoch")).agg(F.round(F.avg("value"), 3).alias("metric"), F.round(F.max("value"), 3).alias("test_metric"))


@query(f"WITH {_HIST}, b AS (SELECT *, max((metric, epoch)) OVER (PARTITION BY run ORDER BY epoch) AS b FROM h) SELECT run, epoch, b[1] AS best_metric, b[2] AS best_epoch FROM b")
def m7_best_so_far(spark, sf):
    return metrics.best_so_far(_history(spark, sf)).select("run", "epoch", "best_metric", "best_epoch")


@query(f"WITH {_HIST} SELECT run, arg_max(epoch, (metric, epoch)) AS epoch, arg_max(test_metric, (metric, epoch)) AS test_metric FROM h GROUP BY 1")
def m8_early_stop(spark, sf):
    return metrics.early_stop(_history(spark, sf))


@query(f"WITH {_HIST} SELECT run, arg_min(epoch, (test_metric, epoch)) AS epoch, arg_min(test_metric, (test_metric, epoch)) AS test_metric FROM h GROUP BY 1")
def m8_early_stop_least_loss(spark, sf):
    return metrics.early_stop(_history(spark, sf).withColumn("loss", F.col("test_metric")), "first", rule="loss")


@query("SELECT user_id % 20 AS split, count(DISTINCT event_type) AS labels FROM events GROUP BY 1")
def m9_distinct_labels(spark, sf):
    return metrics.distinct_labels(P.table(spark, sf, "events").select((F.col("user_id") % 20).alias("split"), F.col("event_type").alias("label")))


@query(f"WITH {P.SQL_LABELLED} SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM (SELECT CASE WHEN sample_id % 5 = 0 THEN 'meta' ELSE 'train' END AS split, label, count(*) AS n FROM l GROUP BY 1, 2)")
def m9_class_shares(spark, sf):
    l = P.labelled(spark, sf).withColumn("split", F.when(F.col("sample_id") % 5 == 0, "meta").otherwise("train"))
    return metrics.class_shares(l).withColumn("share", r6(F.col("share")))


@query("SELECT user_id AS run, event_id AS step, round(sum(value * (1 + event_id % 3)) OVER w / sum(1 + event_id % 3) OVER w, 9) AS average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def m13_running_average(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", (1 + F.col("event_id") % 3).alias("n"))
    return metrics.running_average(e).select("run", "step", F.round("average", 9).alias("average"))


# --- all pairs and kernels -----------------------------------------------------------------------------------


@query("SELECT vec_id AS sample_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS head, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def s1_read_samples(spark, sf):
    rows = tables.read_samples(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", "label")
    return rows.select("sample_id", "label", r6(F.col("vec")[0]).alias("head"), F.size("vec").alias("width"))


@query(f"WITH {P.SQL_VECTORS}, i AS (SELECT *, row_number() OVER (ORDER BY {P.sql_ticket(21)}, sample_id) - 1 AS i FROM v), d AS (SELECT draw, CAST(floor({P.sql_uniform(22, 'draw')} * (SELECT count(*) FROM v)) AS BIGINT) AS i FROM (SELECT unnest(range(0, 300)) AS draw)) SELECT draw, sample_id, label FROM d JOIN i USING (i)")
def p12_bootstrap(spark, sf):
    return splits.bootstrap(P.vectors(spark, sf), 300, 21).select("draw", "sample_id", "label")


@query(f"WITH {P.SQL_VECTORS} SELECT a.sample_id AS id_a, b.sample_id AS id_b, round(list_inner_product(a.vec, b.vec) / 64, 9) AS sim FROM v a, v b")
def d8_gram(spark, sf):
    return distance.gram(P.vectors(spark, sf))


@query(f"WITH {P.SQL_VECTORS} SELECT a.sample_id AS id_a, b.sample_id AS id_b, round(list_distance(a.vec, b.vec), 9) AS dist FROM v a, v b WHERE a.sample_id < b.sample_id")
def d8_all_pairs_l2(spark, sf):
    return distance.all_pairs_l2(P.vectors(spark, sf))


@query(f"WITH {P.SQL_VECTORS}, u AS (SELECT sample_id, vec, {_NORM.format('vec')} AS n FROM v) SELECT a.sample_id AS id_a, b.sample_id AS id_b, round((1 - round(1 - abs(list_inner_product(a.vec, b.vec)) / (a.n * b.n), 9)) / 0.5, 9) AS sim FROM u a, u b WHERE a.sample_id < b.sample_id")
def d9_affinity(spark, sf):
    return distance.affinity(P.vectors(spark, sf), 0.5).withColumn("sim", F.round("sim", 9))


@query(f"WITH {P.SQL_VECTORS} SELECT a.sample_id AS id_a, b.sample_id AS id_b FROM v a JOIN v b ON a.label = b.label AND a.sample_id < b.sample_id")
def d11_label_kernel(spark, sf):
    return distance.label_kernel(P.vectors(spark, sf))


@query(f"WITH {P.SQL_VECTORS} SELECT v.sample_id, b.label AS cluster_id, round(1 - abs(sum(list_inner_product(v.vec, b.vec) / 64 * (1 + b.sample_id % 3)) / sum(1 + b.sample_id % 3)), 9) AS dist FROM v, v b GROUP BY 1, 2")
def d14_member_dist(spark, sf):
    v = P.vectors(spark, sf)
    members = v.withColumn("cluster_id", F.col("label")).withColumn("weight", 1.0 + F.col("sample_id") % 3)
    return distance.member_dist(v, members, "weight")


@query(f"WITH {P.SQL_VECTORS} SELECT round(min({_NORM.format('vec')}), 6) AS min_norm, round(max({_NORM.format('vec')}), 6) AS max_norm FROM v")
def d15_norm_range(spark, sf):
    return distance.norm_range(P.vectors(spark, sf)).select(r6(F.col("min_norm")).alias("min_norm"), r6(F.col("max_norm")).alias("max_norm"))


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('l2')}, n AS (SELECT cluster_id, {_NORM.format('vec')} AS n FROM c) SELECT sample_id, cluster_id, round(dist * ((SELECT max(n) FROM n) / n), 9) AS dist FROM d JOIN n USING (cluster_id)")
def d16_rescale(spark, sf):
    v = P.vectors(spark, sf)
    centers = cluster.first_seeds(v, 10)
    out = distance.rescale_by_center_norm(distance.pairs(v, centers, "l2"), centers)
    return out.select("sample_id", "cluster_id", "dist")


@query(f"""WITH {P.SQL_VECTORS}, t AS (SELECT max({_NORM.format('vec')}) AS top FROM v), s AS (SELECT sample_id, list_transform(vec, lambda x: x / (2 * top)) AS vec FROM v, t)
SELECT sample_id, CAST(73 AS INTEGER) AS width, round(vec[1], 6) AS head, round(0.5 - list_inner_product(vec, vec), 6) AS first, round(0.5 - pow(list_inner_product(vec, vec), 9), 6) AS last FROM s""")
def d17_scale_and_extend(spark, sf):
    x = F.col("vec")
    return distance.scale_and_extend(P.vectors(spark, sf)).select("sample_id", F.size(x).alias("width"), r6(x[0]).alias("head"), r6(x[64]).alias("first"), r6(x[72]).alias("last"))


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')} SELECT sample_id, cluster_id, dist FROM d")
def d4_abs_cos_blocks(spark, sf):
    half = F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))
    v = P.vectors(spark, sf)
    return distance.pairs(v.withColumn("vec", half), cluster.first_seeds(v, 10).withColumn("vec", half), "abs_cos_blocks").select("sample_id", "cluster_id", "dist")


_HALVES = "list_inner_product(v.vec[1:32], c.vec[1:32])", "list_inner_product(v.vec[33:64], c.vec[33:64])"


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS} SELECT sample_id, cluster_id, round(1 - abs({_HALVES[0]}) / ({_NORM.format('v.vec')} * {_NORM.format('c.vec[1:32]')}), 6) AS prefix, round(1 - abs({_HALVES[0]} + {_HALVES[1]}) / {_NORM.format('v.vec')}, 6) AS by_norm, round(1 - abs({_HALVES[0]}) / ({_NORM.format('v.vec')} * {_NORM.format('c.vec')}), 6) AS first, round(1 - abs({_HALVES[1]}) / ({_NORM.format('v.vec')} * {_NORM.format('c.vec')}), 6) AS second FROM v, c")
def d4_abs_cos_blocks_options(spark, sf):
    half = F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))
    v = P.vectors(spark, sf)
    b = cluster.first_seeds(v, 10).select("cluster_id", half.alias("b"))
    rows, x, y = v.withColumn("vec", half).join(F.broadcast(b)), F.col("vec"), F.col("b")
    each = vec.abs_cos_each_block(x, y)
    return rows.select("sample_id", "cluster_id", r6(vec.abs_cos_blocks(x, y, 1)).alias("prefix"), r6(vec.abs_cos_blocks(x, y, by_norm=True)).alias("by_norm"), r6(each[0]).alias("first"), r6(each[1]).alias("second"))


_FLATS = [f"list_sum(list_transform({t}.vec[{r}], lambda x: abs(x))) / {_NORM.format(f'{t}.vec[{r}]')}" for r in ("1:32", "33:64") for t in ("v", "c")]


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS} SELECT sample_id, cluster_id, round(1 - (({_FLATS[0]}) * ({_FLATS[1]}) + ({_FLATS[2]}) * ({_FLATS[3]})) / 2, 9) AS dist FROM v, c")
def d7_cross_blocks(spark, sf):
    half = F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))
    v = P.vectors(spark, sf)
    return distance.pairs(v.withColumn("vec", half), cluster.first_seeds(v, 10).withColumn("vec", half), "cross_blocks").select("sample_id", "cluster_id", "dist")


# --- more clustering -----------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_VECTORS}, s AS (SELECT *, row_number() OVER (ORDER BY {P.sql_ticket(23)}, sample_id) - 1 AS k FROM v) SELECT CAST(k AS INTEGER) AS cluster_id, round(vec[1], 6) AS head FROM s WHERE k < 12")
def c2_random_seeds(spark, sf):
    return cluster.random_seeds(P.vectors(spark, sf), 12, 23).select("cluster_id", r6(F.col("vec")[0]).alias("head"))


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos_by_norm')}, {_NEAREST},
m AS (SELECT cluster_id, i, sum(vec[i] * (1 + sample_id % 3)) / sum({_NORM.format('vec')} * (1 + sample_id % 3)) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT cluster_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT c.cluster_id, k.i, coalesce(m.x, c.vec[k.i]) AS x FROM c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) k LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.i = k.i)""")
def c4_by_norm_step(spark, sf):
    v = P.vectors(spark, sf).withColumn("weight", 1.0 + F.col("sample_id") % 3)
    out = cluster.lloyd_step(v, cluster.first_seeds(v, 10), "abs_cos_by_norm", "weight", by_norm=True)
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST},
m AS (SELECT cluster_id, i, avg(vec[i]) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 65)) AS i) WHERE cluster_id >= 4 GROUP BY ALL)
SELECT c.cluster_id, CAST(k.i - 1 AS INTEGER) AS i, round(coalesce(m.x, c.vec[k.i]), 6) AS x FROM c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) k LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.i = k.i""")
def c6_frozen_step(spark, sf):
    v = P.vectors(spark, sf)
    ten = cluster.first_seeds(v, 10)
    free = ten.filter("cluster_id >= 4").withColumn("cluster_id", F.col("cluster_id") - 4)
    out = cluster.kmeans(v, free, max_iter=1, frozen=ten.filter("cluster_id < 4"))
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {P.SQL_VECTORS}, d AS (SELECT v.sample_id, b.label AS cluster_id, round(1 - abs(avg(list_inner_product(v.vec, b.vec) / 64)), 9) AS dist FROM v, v b GROUP BY 1, 2)
SELECT sample_id, arg_min(cluster_id, (dist, cluster_id)) AS cluster_id, min(dist) AS dist FROM d GROUP BY 1""")
def c8_kernel_step(spark, sf):
    v = P.vectors(spark, sf)
    return cluster.kernel_step(v, v.withColumn("cluster_id", F.col("label"))).select("sample_id", "cluster_id", "dist")


@query(f"""WITH {P.SQL_VECTORS}, d AS (SELECT v.sample_id, b.label AS cluster_id, round(avg(list_sum(list_transform(list_zip(v.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM v, v b GROUP BY 1, 2)
SELECT sample_id, arg_min(cluster_id, (dist, cluster_id)) AS cluster_id, round(min(dist), 5) AS dist FROM d GROUP BY 1""")
def c8_kernel_step_l2(spark, sf):
    v = P.vectors(spark, sf)
    return cluster.kernel_step(v, v.withColumn("cluster_id", F.col("label")), kind="l2").select("sample_id", "cluster_id", F.round("dist", 5).alias("dist"))


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST},
m AS (SELECT cluster_id, i, sum(vec[i] * (1 + sample_id % 3)) / sum({_NORM.format('vec')} * (1 + sample_id % 3)) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT cluster_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT c.cluster_id, k.i, coalesce(m.x, c.vec[k.i]) AS x FROM c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) k LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.i = k.i)""")
def c5_blocks_weighted_step(spark, sf):
    """One step over two blocks with one assignment: the blocks' means together are the whole vector's."""
    v, widths = cluster.flatten_blocks(P.vectors(spark, sf).withColumn("blocks", F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))).withColumn("weight", 1.0 + F.col("sample_id") % 3))
    out = cluster.kmeans(v, cluster.first_seeds(v, 10), weight="weight", by_norm=True, max_iter=1, widths=widths)
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query()
def c8_kernel_kmeans(spark, sf):
    return cluster.kernel_kmeans(P.vectors(spark, sf), 10).select("sample_id", "cluster_id", "dist")


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('l2')}, {_NEAREST}, m AS (SELECT cluster_id, i, avg(vec[i]) AS x FROM n JOIN v USING (sample_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT c.cluster_id, CAST(k.i - 1 AS INTEGER) AS i, round(coalesce(m.x, 0), 6) AS x FROM c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) k LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.i = k.i""")
def c9_kmeans_fixed(spark, sf):
    out = cluster.kmeans_fixed(P.vectors(spark, sf), 10, 1)
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query()
def c10_spectral(spark, sf):
    out = cluster.spectral(P.vectors(spark, sf), 8, 8)
    return out.select("sample_id", "cluster_id", F.size("vec").alias("width"))


@query(f"""WITH {P.SQL_VECTORS}, b AS (SELECT a.sample_id, a.label AS own, t.label AS theirs, avg(pow(list_distance(a.vec, t.vec), 2)) AS m FROM v a JOIN v t ON a.sample_id <> t.sample_id GROUP BY ALL),
s AS (SELECT sample_id, max(CASE WHEN own = theirs THEN m END) AS a, min(CASE WHEN own <> theirs THEN m END) AS b FROM b GROUP BY 1) SELECT sample_id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS score FROM s""")
def c11_silhouette_by_means(spark, sf):
    v = P.vectors(spark, sf)
    return cluster.silhouette_by_means(v, v.withColumn("cluster_id", F.col("label"))).withColumn("score", r6(F.col("score")))


@query()
def c12_best_k(spark, sf):
    return cluster.best_k(P.vectors(spark, sf)).withColumn("score", r6(F.col("score")))


@query(f"""WITH {P.SQL_VECTORS}, a AS (SELECT a.sample_id, any_value(a.vec) AS vec, round(avg(round(abs(list_inner_product(a.vec, b.vec) / 64), 9)), 9) AS m FROM v a, v b GROUP BY 1), f AS (SELECT * FROM a ORDER BY m DESC, sample_id LIMIT 1),
s AS (SELECT a.sample_id, round(avg(round(abs((list_inner_product(a.vec, b.vec) + list_inner_product(f.vec, b.vec)) / 64), 9)), 9) AS m FROM a, v b, f WHERE a.sample_id <> f.sample_id GROUP BY 1)
SELECT CAST(1 AS INTEGER) AS step, sample_id FROM f UNION ALL SELECT 2, sample_id FROM (SELECT sample_id FROM s ORDER BY m DESC, sample_id LIMIT 1)""")
def c13_greedy_similarity(spark, sf):
    return cluster.greedy_similarity(P.vectors(spark, sf), 2)


@query(f"""WITH {P.SQL_VECTORS}, b AS (SELECT a.sample_id, a.label AS own, t.label AS theirs, avg(pow(list_distance(a.vec, t.vec), 2)) AS m FROM v a JOIN v t ON a.sample_id <> t.sample_id GROUP BY ALL),
s AS (SELECT sample_id, max(CASE WHEN own = theirs THEN m END) AS a, min(CASE WHEN own <> theirs THEN m END) AS b FROM b GROUP BY 1),
h AS (SELECT sample_id, row_number() OVER (ORDER BY NOT (b < a), {P.sql_ticket(24)}, sample_id) <= ceil((SELECT count(*) FROM v) * 0.3) AS hit FROM s)
SELECT sample_id, CASE WHEN hit THEN CAST(floor({P.sql_uniform(25)} * 9) AS INTEGER) ELSE label END AS label FROM v JOIN h USING (sample_id)""")
def n5_flip_adversarial(spark, sf):
    v = P.vectors(spark, sf)
    scores = cluster.silhouette_by_means(v, v.withColumn("cluster_id", F.col("label")))
    return splits.flip_adversarial(v, scores, 0.3, K, 24).select("sample_id", "label")


# --- more representations ------------------------------------------------------------------------------------


@query(f"""WITH {P.SQL_VECTORS}, r AS (SELECT *, (row_number() OVER (ORDER BY {P.sql_ticket(26)}, sample_id) - 1) // 32 AS batch FROM v)
SELECT batch, CAST(i - 1 AS INTEGER) AS i, round(avg(vec[i]), 6) AS x FROM r, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL""")
def r4_batch_mean(spark, sf):
    out = represent.batch_mean(P.vectors(spark, sf), 32, 26)
    return out.select("batch", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id, round(probs[1], 6) AS head, round(probs[1] * vec[1], 6) AS first, round(probs[10] * vec[64], 6) AS last, CAST(650 AS INTEGER) AS width FROM p")
def r5_full_gradient(spark, sf):
    out = represent.gradient(P.logits(spark, sf), K, linear_layer=True, full_loss=True)
    x = F.col("vec")
    return out.select("sample_id", r6(x[0]).alias("head"), r6(x[10]).alias("first"), r6(F.element_at(x, -1)).alias("last"), F.size(x).alias("width"))


def _blocks(v):
    return v.withColumn("blocks", F.array(*(F.slice("vec", 8 * b + 1, 8) for b in range(8))))


@query(f"""WITH {P.SQL_VECTORS}, s AS (SELECT b, avg(list_inner_product(vec[8 * b + 1:8 * b + 8], vec[8 * b + 1:8 * b + 8]) / 8) AS s FROM v, (SELECT unnest(range(0, 8)) AS b) GROUP BY 1)
SELECT CAST(b AS INTEGER) AS block, round(s / sum(s) OVER (), 6) AS prob FROM s""")
def r6_block_probabilities(spark, sf):
    return represent.block_probabilities(_blocks(P.vectors(spark, sf))).withColumn("prob", r6(F.col("prob")))


@query(f"""WITH {P.SQL_VECTORS}, s AS (SELECT b, avg(list_inner_product(vec[8 * b + 1:8 * b + 8], vec[8 * b + 1:8 * b + 8]) / 8) AS s FROM v, (SELECT unnest(range(0, 8)) AS b) GROUP BY 1),
c AS (SELECT b, s / sum(s) OVER () AS prob, sum(s) OVER (ORDER BY b) / sum(s) OVER () AS cum FROM s), d AS (SELECT draw, coalesce(min(b) FILTER ({P.sql_uniform(27, 'draw')} < cum), 7) AS b FROM c, (SELECT unnest(range(0, 5)) AS draw) GROUP BY 1)
SELECT sample_id, CAST(5 AS INTEGER) AS blocks, round(vec[8 * b + 1] / sqrt(prob), 6) AS head FROM v, d JOIN c USING (b) WHERE draw = 0""")
def r6_sample_blocks(spark, sf):
    out = represent.sample_blocks(_blocks(P.vectors(spark, sf)), 5, 27)
    return out.select("sample_id", F.size("blocks").alias("blocks"), r6(F.col("blocks")[0][0]).alias("head"))


@query("""WITH d AS (SELECT user_id AS sample_id, CAST(dayofyear(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)
SELECT sample_id, CAST(count(*) AS INTEGER) AS n, arg_min(x, epoch) AS head, arg_max(x, epoch) AS last FROM d WHERE epoch IN (2, 9, 16, 23, 30) GROUP BY 1""")
def r7_stack_checkpoints(spark, sf):
    d = P.table(spark, sf, "events").groupBy(F.col("user_id").alias("sample_id"), F.dayofyear("ts").alias("epoch")).agg(F.array(r6(F.avg("value"))).alias("vec"))
    b = F.col("blocks")
    return represent.stack_checkpoints(d, 2, 7).select("sample_id", F.size(b).alias("n"), b[0][0].alias("head"), F.element_at(b, -1)[0].alias("last"))


_PASSES = "x AS (SELECT sample_id, s, list_transform(logits, lambda z: z * (1 + s / 4.0)) AS z FROM z, (SELECT unnest([0, 1, 2]) AS s)), y AS (SELECT sample_id, s, list_transform(z, lambda e: exp(e - list_max(z)) / list_sum(list_transform(z, lambda f: exp(f - list_max(z))))) AS q FROM x), a AS (SELECT sample_id, j, avg(q[j]) AS p FROM y, (SELECT unnest(range(1, 11)) AS j) GROUP BY ALL)"


@query(f"WITH {P.SQL_LOGITS}, {_PASSES} SELECT sample_id, CAST(arg_max(j, (round(p, 9), -j)) - 1 AS INTEGER) AS predicted, round(max(p), 6) AS top FROM a GROUP BY 1")
def r8_mean_passes(spark, sf):
    z = P.logits(spark, sf).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    out = represent.mean_passes(z.withColumn("logits", vec.scale(F.col("logits"), 1 + F.col("pass") / 4)))
    return out.select("sample_id", "predicted", r6(F.array_max("probs")).alias("top"))


@query(f"WITH {P.SQL_VECTORS} SELECT m.sample_id, round(avg(list_inner_product(m.vec, t.vec)), 6) AS product FROM v m, v t WHERE m.sample_id % 10 = 0 AND t.sample_id % 10 <> 0 GROUP BY 1")
def r9_grad_product(spark, sf):
    v = P.vectors(spark, sf)
    return represent.grad_product(v.filter("sample_id % 10 <> 0"), ids_of(v, 10)).withColumn("product", r6(F.col("product")))


# --- more selection ------------------------------------------------------------------------------------------


@query()
def l6_boundary_and_rep(spark, sf):
    return select.select_boundary_and_rep(P.logits(spark, sf), 20, 6)


@query()
def l9_gradient_representatives(spark, sf):
    return select.select_gbc(P.logits(spark, sf), 20, 10, K, 64)


@query(f"WITH {P.SQL_VECTORS}, {_COVER} SELECT sample_id, dist FROM (SELECT * FROM g WHERE sample_id % 25 <> 0 ORDER BY dist DESC, sample_id LIMIT greatest(CASE WHEN (SELECT count(*) FROM v WHERE sample_id % 25 = 0) > 100 THEN 0 ELSE 110 - (SELECT count(*) FROM v WHERE sample_id % 25 = 0) END, 0))")
def l14_new_picks(spark, sf):
    v = P.vectors(spark, sf)
    return select.new_picks(v.filter("sample_id % 25 <> 0"), ids_of(v, 25), 100, 110)


@query()
def l15_outlier_picks(spark, sf):
    v = P.vectors(spark, sf)
    return select.outlier_picks(v, ids_of(v, 100), 25, 0.6).select("sample_id")


@query()
def l15_outlier_picks_repeated(spark, sf):
    v = P.vectors(spark, sf)
    return select.outlier_picks(v, ids_of(v, 100), 25, 0.6, repeat=True).select("sample_id")


@query(f"WITH {P.SQL_VECTORS}, g AS (SELECT v.sample_id, min(round(list_distance(v.vec, c.vec), 9)) AS dist FROM v, v c WHERE c.sample_id % 25 = 0 GROUP BY 1) SELECT sample_id, dist FROM (SELECT * FROM g ORDER BY dist DESC, sample_id LIMIT 12)")
def l16_under_represented(spark, sf):
    v = P.vectors(spark, sf)
    return select.under_represented(v, ids_of(v, 25), 12)


@query()
def l17_select_by_class(spark, sf):
    return select.select_by_class(P.vectors(spark, sf), 20)


_FL = """sq AS (SELECT a.label, a.sample_id AS i, b.sample_id AS c, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM v a JOIN v b ON a.label = b.label),
sim AS (SELECT label, i, c, max(d2) OVER (PARTITION BY label) - d2 AS s FROM sq), g1 AS (SELECT label, c, round(sum(s), 9) AS gain FROM sim GROUP BY 1, 2), p1 AS (SELECT label, arg_max(c, (gain, -c)) AS c, max(gain) AS gain FROM g1 GROUP BY 1),
b1 AS (SELECT sim.label, i, s AS best FROM sim JOIN p1 ON sim.label = p1.label AND sim.c = p1.c), g2 AS (SELECT sim.label, sim.c, round(sum(greatest(s - best, 0)), 9) AS gain FROM sim JOIN b1 ON sim.label = b1.label AND sim.i = b1.i WHERE sim.c NOT IN (SELECT c FROM p1) GROUP BY 1, 2),
p2 AS (SELECT label, arg_max(c, (gain, -c)) AS c, max(gain) AS gain FROM g2 GROUP BY 1), picks AS (SELECT label, c AS sample_id, 1 AS step, gain FROM p1 UNION ALL SELECT label, c, 2, gain FROM p2)"""


@query(f"WITH {P.SQL_VECTORS}, {_FL} SELECT label, sample_id, CAST(step AS INTEGER) AS step, round(gain, 4) AS gain FROM picks")
def l21_facility_location(spark, sf):
    v = P.vectors(spark, sf)
    return facility.per_class(v, v.select("label").distinct().withColumn("budget", F.lit(2))).withColumn("gain", F.round("gain", 4))


@query(f"WITH {P.SQL_VECTORS}, {_FL} SELECT label, sample_id, CAST(step AS INTEGER) AS step, round(gain, 4) AS gain FROM picks WHERE step = 1 ORDER BY picks.gain DESC, label LIMIT 7")
def l22_facility_supervised(spark, sf):
    return facility.supervised(P.vectors(spark, sf), 7).withColumn("gain", F.round("gain", 4))


@query(f"""WITH {P.SQL_VECTORS.replace('v AS', 'e AS', 1)}, r AS (SELECT *, (row_number() OVER (ORDER BY {P.sql_ticket(26)}, sample_id) - 1) // 32 AS batch FROM e),
v AS (SELECT CAST(0 AS INTEGER) AS label, batch AS sample_id, list(x ORDER BY i) AS vec FROM (SELECT batch, i, avg(vec[i]) AS x FROM r, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY 2), {_FL}
SELECT sample_id, batch FROM r WHERE batch IN (SELECT sample_id FROM picks)""")
def l23_facility_per_batch(spark, sf):
    return facility.per_batch(P.vectors(spark, sf), 60, 32, 26).select("sample_id", "batch")


@query()
def l25_facility_active(spark, sf):
    z = P.logits(spark, sf).withColumn("predicted", vec.argmax(F.col("logits")))
    budgets = select.class_budgets(z.withColumn("label", F.col("predicted")), 30)
    return facility.active(z, budgets).withColumn("gain", F.round("gain", 4))


@query(f"WITH {P.SQL_LOGITS}, u AS (SELECT sample_id, label, {_SCORE} FROM p WHERE sample_id % 10 <> 0 ORDER BY score DESC, sample_id LIMIT 5) SELECT sample_id, label FROM u UNION ALL SELECT sample_id, label FROM v WHERE sample_id % 10 = 0")
def l29_grow_meta(spark, sf):
    z = P.logits(spark, sf)
    return select.grow_meta(z.filter("sample_id % 10 <> 0").withColumn("clean_label", F.col("label")), ids_of(P.vectors(spark, sf), 10))


@query()
def l30_radius_cover(spark, sf):
    return select.radius_cover(P.vectors(spark, sf), 16).select("sample_id")


@query()
def l31_incremental(spark, sf):
    v = P.vectors(spark, sf)
    return select.select_incremental(v, v.filter("sample_id < 10"), 20, 18)


# --- training and more evaluation ----------------------------------------------------------------------------


@query(f"""WITH {P.SQL_VECTORS}, n AS (SELECT count(*) AS n, avg(CASE WHEN label = 0 THEN 100.0 ELSE 0 END) AS accuracy FROM v), h AS (SELECT j, i, sum(vec[i] * (CASE WHEN label = j - 1 THEN 0.9 ELSE -0.1 END)) AS x FROM v, (SELECT unnest(range(1, 11)) AS j), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
w AS (SELECT j, list(0.5 * x / n ORDER BY i) AS w FROM h, n GROUP BY 1), z AS (SELECT sample_id, label, list(list_inner_product(vec, w) ORDER BY j) AS z FROM v, w GROUP BY 1, 2),
l AS (SELECT avg(ln(list_sum(list_transform(z, lambda e: exp(e)))) - z[label + 1]) AS loss, avg(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 100.0 ELSE 0 END) AS accuracy FROM z)
SELECT CAST(0 AS INTEGER) AS epoch, round(ln(10), 6) AS loss, round(accuracy, 6) AS accuracy FROM n UNION ALL SELECT 1, round(loss, 6), round(accuracy, 6) FROM l""")
def w6_train_head(spark, sf):
    out = reweight.train_head(P.vectors(spark, sf), K, 0.5, 2)
    return out.select("epoch", r6(F.col("loss")).alias("loss"), r6(F.col("accuracy")).alias("accuracy"))


@query(f"WITH {P.SQL_LOGITS} SELECT sample_id % 3 AS epoch, round(avg(-{_OWN}), 6) AS loss, round(100 * avg(CASE WHEN {_PRED} = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1")
def w9_train_stats(spark, sf):
    out = reweight.train_stats(P.logits(spark, sf).withColumn("epoch", F.col("sample_id") % 3))
    return out.select("epoch", r6(F.col("loss")).alias("loss"), r6(F.col("accuracy")).alias("accuracy"))


@query(f"""WITH {P.SQL_VECTORS}, s AS (SELECT v.sample_id, any_value(v.label) AS y, arg_max(t.label, (round(list_inner_product(v.vec, t.vec) / 64, 9), -t.sample_id)) AS p FROM v, v t WHERE v.sample_id % 10 = 0 AND t.sample_id % 10 <> 0 GROUP BY 1)
SELECT count(*) AS n, round(100 * avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s""")
def m5_nn_accuracy(spark, sf):
    v = P.vectors(spark, sf)
    return metrics.nn_accuracy(ids_of(v, 10), v.filter("sample_id % 10 <> 0")).withColumn("accuracy", r6(F.col("accuracy")))


@query("""WITH r AS (SELECT user_id, abs(sum(value - 50)) / sum(abs(value - 50)) AS r FROM events GROUP BY 1), d AS (SELECT (1 + r) / (1 - r) AS v FROM r WHERE r < 1)
SELECT count(*) AS n, round(min(v), 6) AS least, round(quantile_cont(v, 0.001), 6) AS low FROM d""")
def m10_d_value(spark, sf):
    cells = P.table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), (F.col("value") - 50).alias("d"))
    return metrics.d_value(cells).select("n", r6(F.col("least")).alias("least"), r6(F.col("low")).alias("low"))


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST}, e AS (SELECT v.sample_id, arg_min(c.cluster_id, (round({_DIST['l2']}, 9), c.cluster_id)) AS o FROM v, c GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN cluster_id = o THEN 1.0 ELSE 0.0 END), 6) AS agree FROM n JOIN e USING (sample_id)")
def m11_assign_agreement(spark, sf):
    v = P.vectors(spark, sf)
    centers = cluster.first_seeds(v, 10)
    return metrics.assign_agreement(distance.assign(v, centers), distance.assign(v, centers, "l2")).withColumn("agree", r6(F.col("agree")))


@query(f"""WITH {P.SQL_VECTORS}, {_CENTERS}, {_pairs('abs_cos')}, {_NEAREST}, q AS (SELECT v.sample_id, list(list_inner_product(v.vec, c.vec) / 0.5 ORDER BY c.cluster_id) AS z FROM v, c GROUP BY 1)
SELECT sample_id, list_position(z, list_max(z)) - 1 = cluster_id AS agree, round(ln(list_sum(list_transform(z, lambda e: exp(e - list_max(z))))) + list_max(z) - z[cluster_id + 1], 6) AS loss FROM q JOIN n USING (sample_id)""")
def m11_cross_view(spark, sf):
    v = P.vectors(spark, sf)
    centers = cluster.first_seeds(v, 10)
    return metrics.cross_view(v, distance.assign(v, centers), centers, 0.5).withColumn("loss", r6(F.col("loss")))


@query(f"""WITH {P.SQL_VECTORS}, c AS (SELECT * FROM v WHERE sample_id % 25 = 0), s AS (SELECT list_inner_product(v.vec[1:8], c.vec[1:8]) * (1 - round({_DIST['abs_cos']}, 9)) AS s FROM v, c)
SELECT round(max(s), 6) AS largest, round(max(abs(s)), 6) AS largest_abs FROM s""")
def m12_similarity_bound(spark, sf):
    v = P.vectors(spark, sf).withColumn("g", F.slice("vec", 1, 8))
    out = metrics.weighted_similarity_bound(v, ids_of(v, 25))
    return out.select(r6(F.col("largest")).alias("largest"), r6(F.col("largest_abs")).alias("largest_abs"))


# --- stores: written to the scratch folder and read again ------------------------------------------------------


@query(f"WITH {P.SQL_LABELLED} SELECT CASE WHEN sample_id % 10 = 0 THEN 'meta' ELSE 'train' END AS split, sample_id, label FROM l UNION ALL SELECT 'clean_labels', sample_id, label FROM l WHERE sample_id % 10 = 0")
def s4_split_store(spark, sf):
    l, at = P.labelled(spark, sf).select("sample_id", "label"), tables.scratch_path(spark, "splits")
    meta = l.filter("sample_id % 10 = 0")
    tables.save_splits({"train": l.filter("sample_id % 10 <> 0"), "meta": meta, "clean_labels": meta}, at)
    out = None
    for name, df in tables.load_splits(spark, at).items():
        if df is not None:
            one = df.select(F.lit(name).alias("split"), "sample_id", "label")
            out = one if out is None else out.unionByName(one)
    return out


@query("""WITH w AS (SELECT e, event_id AS sample_id, value / 100 * CASE e WHEN 1 THEN 9 ELSE e + 1 END AS w FROM events, (SELECT unnest([0, 1, 7]) AS e))
SELECT 'latest' AS kind, CAST(7 AS INTEGER) AS epoch, sample_id, round(w, 6) AS w FROM w WHERE e = 7 UNION ALL SELECT 'again', 1, sample_id, round(w, 6) FROM w WHERE e = 1 UNION ALL SELECT 'promoted', 0, sample_id, round(w, 6) FROM w WHERE e = 0""")
def s5_weight_epochs(spark, sf):
    """Three epochs, one of them written again, the latest resumed, one promoted."""
    at = tables.scratch_path(spark, "weights")
    weights = lambda by: P.table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), (F.col("value") / 100 * by).alias("w"))
    for epoch, by in ((0, 1), (1, 2), (7, 8), (1, 9)):
        tables.save_weights(weights(by), at, epoch)
    tables.promote_weights(spark, at, 0, f"{at}-best")
    found = {"latest": tables.load_weights(spark, at), "again": tables.load_weights(spark, at, 1), "promoted": spark.read.parquet(f"{at}-best").withColumn("epoch", F.lit(0))}
    one, two, three = (df.select(F.lit(name).alias("kind"), F.col("epoch").cast("int").alias("epoch"), "sample_id", r6(F.col("w")).alias("w")) for name, df in found.items())
    return one.unionByName(two).unionByName(three)


@query("SELECT CAST(user_id % 40 AS INTEGER) AS run, CAST(max(dayofyear(ts)) AS INTEGER) AS epoch, round(avg(value), 4) AS loss, round(max(value), 4) AS metric FROM events GROUP BY 1")
def s7_run_logs(spark, sf):
    """A log for each run, with the line that reports its last epoch, read back by that line."""
    at, e = tables.scratch_path(spark, "logs"), P.table(spark, sf, "events")
    runs = e.groupBy((F.col("user_id") % 40).cast("int").alias("run")).agg(F.max(F.dayofyear("ts")).alias("epoch"), F.round(F.avg("value"), 4).alias("loss"), F.round(F.max("value"), 4).alias("metric"))
    text = F.concat_ws("\n", F.lit("start"), F.concat(F.lit("final test performance is in epoch "), F.col("epoch"), F.lit(": "), F.col("loss"), F.lit(", "), F.col("metric")), F.lit(""))
    runs.select("run", text.alias("value")).write.partitionBy("run").text(at)
    logs = tables.read_run_logs(spark, f"{at}/run=*/*.txt")
    return logs.select(F.regexp_extract("path", r"run=(\d+)/", 1).cast("int").alias("run"), "epoch", "loss", "metric")


@query(ORACLES["n4_flip_permute"])
def n6_corrupt_stored(spark, sf):
    """Corruption by kind, whose labels are stored: a second call with another seed sees the first one's."""
    l, at = P.labelled(spark, sf), tables.scratch_path(spark, "labels")
    splits.corrupt(l, "biased", 0.2, 5, 8, [3, 0, 4, 1, 2], store=at)
    return splits.corrupt(l, "uniform", 0.5, 5, 9, store=at).select("sample_id", "label")


# --- compositions, hooks and registries ------------------------------------------------------------------------


@query(f"""WITH {P.SQL_VECTORS}, a AS (SELECT * FROM v ORDER BY sample_id LIMIT 6), far AS (SELECT v.sample_id, min(round(1 - abs(list_inner_product(v.vec, a.vec)) / ({_NORM.format('v.vec')} * {_NORM.format('a.vec')}), 9)) AS dist FROM v, a GROUP BY 1),
part AS (SELECT sample_id FROM (SELECT *, row_number() OVER (ORDER BY dist DESC, sample_id) AS r FROM far) WHERE r <= floor((SELECT count(*) FROM v) / 4))
SELECT sample_id FROM a UNION SELECT sample_id FROM (SELECT sample_id FROM part ORDER BY sample_id LIMIT 3)""")
def l10_coverage_loop(spark, sf):
    """The loop with a selection that SQL can say: the smallest ids, then the smallest among the farthest quarter for what is missing."""
    return select.coverage_loop(P.vectors(spark, sf).select("sample_id", "vec"), 6, 9, lambda rows, n: rows.select("sample_id").orderBy("sample_id").limit(n))


@query()
def l8_rbc(spark, sf):
    """Rank-one vectors of features and outputs, some of their columns, two checkpoints, weights, means by norm, and the coverage loop."""
    z = P.logits(spark, sf)
    epochs = z.withColumn("epoch", F.lit(0)).unionByName(z.withColumn("logits", F.transform("logits", lambda x: x / 2)).withColumn("epoch", F.lit(20)))
    weights = z.select("sample_id", (1.0 + F.col("sample_id") % 3).alias("w"))
    return select.select_rbc(epochs, 20, 10, 30, columns=48, weights=weights, start=0, max_iter=20)


@query()
def l9_gbc_user_blocks(spark, sf):
    """Gradient blocks that the user brings."""
    halves = F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))
    return select.select_gbc(P.logits(spark, sf).withColumn("blocks", halves), 20, 10, K, 24, blocks="blocks", max_iter=20)


@query("SELECT CAST(greatest(0, least(100, 60 - count(*) FILTER (vec_id % 10 = 0))) AS INTEGER) AS n FROM embeddings")
def l26_remaining_budget(spark, sf):
    n = select.remaining_budget(P.vectors(spark, sf).filter("sample_id % 10 = 0"), 100, 60)
    return spark.createDataFrame([(n,)], "n int")


@query(ORACLES["c3_lloyd_step"])
def c7_nonempty_step(spark, sf):
    """One step from the rows with the smallest ids, after which no cluster is empty, so that it isn't run again with fewer."""
    out = cluster.kmeans_nonempty(P.vectors(spark, sf), 10, cluster.first_seeds, max_iter=1)
    return out.select("cluster_id", F.posexplode("vec").alias("i", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {P.SQL_VECTORS}, u AS (SELECT sample_id, vec, {_NORM.format('vec')} AS n FROM v), s AS (SELECT a.sample_id AS i, b.sample_id AS j, round(1 - abs(list_inner_product(a.vec, b.vec)) / (a.n * b.n), 9) AS d FROM u a JOIN u b ON a.sample_id <> b.sample_id),
k AS (SELECT i, j, 1 - d AS w FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5), g AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY 1, 2)
SELECT i AS sample_id, round(sum(w), 6) AS degree FROM g GROUP BY 1""")
def c10_degrees(spark, sf):
    return spectral.degrees(spectral.neighbour_graph(P.vectors(spark, sf), 5)).select("sample_id", r6(F.col("degree")).alias("degree"))


@query(f"WITH {P.SQL_VECTORS}, d AS (SELECT a.sample_id, b.sample_id AS near_id, round(list_distance(a.vec, b.vec), 9) AS dist FROM v a JOIN v b ON a.sample_id % 20 = 0 AND b.sample_id % 20 <> 0) SELECT sample_id, near_id, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY dist, near_id) <= 3")
def d12_nearest_rows(spark, sf):
    """The three nearest of all other rows for every twentieth one, with cells ruled out."""
    v = P.vectors(spark, sf)
    return nearest.nearest(v.filter("sample_id % 20 = 0"), v.filter("sample_id % 20 <> 0"), 3, "l2").select("sample_id", "near_id", r6(F.col("dist")).alias("dist"))


@query(f"WITH w AS (WITH {P.SQL_LOGITS} SELECT sample_id, {_PRED} AS label, vec FROM p), v AS (SELECT * FROM w), {_FL} SELECT label, sample_id, CAST(step AS INTEGER) AS step, round(gain, 4) AS gain FROM picks")
def l25_facility_active_two(spark, sf):
    z = P.logits(spark, sf).withColumn("predicted", vec.argmax(F.col("logits")))
    budgets = z.select(F.col("predicted").alias("label")).distinct().withColumn("budget", F.lit(2))
    return facility.active(z, budgets).withColumn("gain", F.round("gain", 4))


@query(f"WITH {P.SQL_VECTORS}, {_CENTERS}, d AS (SELECT v.sample_id, c.cluster_id, round(list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: abs(z[1] - z[2]))), 9) AS dist FROM v, c) SELECT sample_id, cluster_id, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY dist, cluster_id) = 1")
def u1_registered_metric(spark, sf):
    """Assignment under a distance that a user registers."""
    if "city_block" not in vec.METRICS:
        vec.register("city_block", lambda a, b: vec.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    v = P.vectors(spark, sf)
    return distance.assign(v, cluster.first_seeds(v, 10), "city_block").select("sample_id", "cluster_id", r6(F.col("dist")).alias("dist"))


@query(f"WITH {P.SQL_VECTORS} SELECT sample_id FROM v ORDER BY round(list_sum(vec), 6) DESC, sample_id LIMIT 25")
def u2_registered_selector(spark, sf):
    """A selection that a user registers, by its name."""
    if "largest_sum" not in select.SELECTORS:
        select.register_selector("largest_sum", lambda df, n: df.orderBy(F.round(vec.total(F.col("vec")), 6).desc(), "sample_id").limit(n))
    return select.select(P.vectors(spark, sf), "largest_sum", 25)


@query(f"WITH {P.SQL_VECTORS} SELECT sample_id, round(vec[1] + 2 * vec[2], 6) AS a, round(vec[1] - vec[2], 6) AS b FROM v")
def u3_model_hook(spark, sf):
    """Outputs of a model that a user brings."""

    def make_model():
        import numpy as np

        matrix = np.zeros((64, 2))
        matrix[:2] = [[1, 1], [2, -1]]
        return lambda rows: np.asarray(rows, float) @ matrix

    z = F.col("logits")
    return represent.predict(P.vectors(spark, sf), make_model).select("sample_id", r6(z[0]).alias("a"), r6(z[1]).alias("b"))
