"""Distances of rows to a set of centres or chosen rows, and what is read off them.

The set is sent to all tasks where it has at most SMALL rows of SMALL_BYTES (checked); there a batch of rows meets it
as one matrix product. Beyond that rows and set meet in blocks, which the triangle inequality rules out where it can (operators.nearest).
Distances are rounded to nine decimals before they are compared, and ties go to the smallest id. Vectors of several widths
are an error; a null vector is near nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions import vec
from sievekit.functions.arrays import NUMPY_METRICS, squared
from sievekit.operators import blocks
from sievekit.sources.tables import cut

SMALL, SMALL_BYTES = 20_000, 32 << 20


def blocks_of(chosen: DataFrame, column: str = "vec") -> int:
    """Into how many blocks a set must be cut for each to be small; 1: it may be broadcast."""
    width = F.size(column) if chosen.schema[column].dataType.elementType.typeName() != "array" else F.size(F.flatten(column))
    rows, numbers = chosen.agg(F.count(F.lit(1)), F.sum(width)).first()
    return max(1, -(-rows // SMALL), -(-8 * (numbers or 0) // SMALL_BYTES))


def pairs(a: DataFrame, b: DataFrame, metric: str, b_id: str = "cluster_id") -> DataFrame:
    """(columns of a, b_id, dist) for every row of a and of the set b (b_id, vec)."""
    right = b.select(F.col(b_id), F.col("vec").alias("__b"))
    blocks = blocks_of(right, "__b")
    if blocks == 1:
        joined = a.join(F.broadcast(right))
    else:
        right = right.withColumn("__block", F.pmod(F.xxhash64(b_id), F.lit(blocks)))
        spread = a.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        joined = spread.join(right, "__block").drop("__block")
    return joined.withColumn("dist", F.round(vec.METRICS[metric](F.col("vec"), F.col("__b")), 9)).drop("__b")


def centre_array(centers: DataFrame) -> DataFrame:
    """One row with all centres in order of id."""
    return centers.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "vec"))).alias("_centers"))


def assign(df: DataFrame, centers: DataFrame, metric: str = "abs_cos") -> DataFrame:
    """df with the nearest centre's cluster_id and dist; both are null where there is no centre or no vector.

    Rows pass through with all their columns. Of a set too large to be sent, each row finds its nearest by nearest.nearest
    or, under other metrics, in blocks that each pass on their nearest; there, rows with one id must have one vector.
    """
    many = blocks_of(centers)
    if many > 1:
        from sievekit.operators import nearest

        if metric in nearest.GEOMETRIES:
            near = nearest.nearest(df.select("sample_id", "vec"), centers.select(F.col("cluster_id").alias("sample_id"), "vec"), 1, metric)
            near = near.select(F.col("sample_id").alias("__id"), "dist", F.col("near_id").cast(centers.schema["cluster_id"].dataType).alias("cluster_id"))
        else:
            near = pairs(df.select("sample_id", "vec"), centers, metric).groupBy("sample_id").agg(F.min(F.struct("dist", "cluster_id")).alias("b"))
            near = near.select(F.col("sample_id").alias("__id"), "b.dist", "b.cluster_id")
        return df.drop("cluster_id", "dist").join(near, F.col("sample_id") == F.col("__id"), "left").drop("__id").select(*_kept(df), "cluster_id", "dist")
    if metric not in NUMPY_METRICS:
        distance = lambda v, c: F.struct(F.round(vec.METRICS[metric](v, c["vec"]), 9).alias("dist"), c["cluster_id"].alias("cluster_id"))
        best = vec.bind(F.col("vec"), lambda v: F.array_min(F.transform("__centers", lambda c: distance(v, c))))
        table = centre_array(centers).withColumnRenamed("_centers", "__centers")
        found = df.drop("cluster_id", "dist").join(F.broadcast(table)).withColumn("__best", best)
        return found.select(*_kept(df), F.col("__best.cluster_id").alias("cluster_id"), F.col("__best.dist").alias("dist"))
    own = sorted((r["cluster_id"], r["vec"]) for r in centers.select("cluster_id", "vec").filter("vec IS NOT NULL").collect())  # SMALL at most
    shared = df.sparkSession.sparkContext.broadcast((np.array([c for c, _ in own]), np.array([v for _, v in own], float)))
    kept = _kept(df)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("cluster_id", centers.schema["cluster_id"].dataType), T.StructField("dist", T.DoubleType())])
    arrow = blocks.arrow_type(centers.schema["cluster_id"].dataType)

    def near(incoming):
        ids, matrix = shared.value
        for batch in incoming:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            vecs = batch.column(batch.schema.get_field_index("vec"))
            known = vecs.is_valid()
            best, dist = np.zeros(len(vecs), np.int64), np.zeros(len(vecs))
            if len(ids) and vecs.null_count < len(vecs):
                rows = np.flatnonzero(np.asarray(known))
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    far = NUMPY_METRICS[metric](blocks.matrix(vecs.take(pa.array(part)), matrix.shape[1]), matrix)
                    best[part] = far.argmin(axis=1)
                    dist[part] = far.min(axis=1)
            gone = ~np.asarray(known) if len(ids) else np.ones(len(vecs), bool)
            found = pa.array(ids[best] if len(ids) else best, mask=gone).cast(arrow)
            yield pa.RecordBatch.from_arrays([*columns, found, pa.array(dist, mask=gone)], names=[*kept, "cluster_id", "dist"])

    return df.drop("cluster_id", "dist").mapInArrow(near, schema)


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("cluster_id", "dist")]


def coverage(df: DataFrame, selected: DataFrame, metric: str = "abs_cos") -> DataFrame:
    """sample_id and the distance to the nearest selected row (sample_id, vec), for each row where anything is selected."""
    chosen = selected.select(F.col("sample_id").alias("cluster_id"), "vec")
    return assign(df.select("sample_id", "vec"), chosen, metric).filter(F.col("dist").isNotNull()).select("sample_id", "dist")


def cluster_spread(distances: DataFrame) -> DataFrame:
    """cluster_id, the largest distance of its own rows and the smallest distance to a second-nearest centre."""
    ordered = Window.partitionBy("sample_id").orderBy("dist", "cluster_id")
    ranked = distances.withColumn("r", F.row_number().over(ordered)).withColumn("next", F.lead("dist").over(ordered))
    return ranked.filter("r = 1").groupBy("cluster_id").agg(F.max("dist").alias("max_own"), F.min("next").alias("min_second"))


def norm_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(vec.norm(F.col("vec"))).alias("min_norm"), F.max(vec.norm(F.col("vec"))).alias("max_norm"))


def class_similarity(df: DataFrame) -> DataFrame:
    """(label, id_a, id_b, sim): the class' largest squared distance less the pair's, for pairs a < b of a class.

    Rows of a class meet in tiles twice: the first pass gives the largest distance alone, the second passes pairs on as they are read. No pair is written.
    """
    columns, kind = {"sample_id": "i8"}, blocks.arrow_type(df.schema["label"].dataType)
    packed = blocks.pack(df.filter("label IS NOT NULL"), columns, ["label"])
    own_type = kind.to_pandas_dtype()
    rounded = lambda d: np.floor(d * 1e9 + 0.5) / 1e9

    def widest(key, a, b):
        top = -1.0
        for own, other, same in blocks.couples(a, b):
            d = squared(own["vec"], other["vec"])
            if same or len(np.intersect1d(own["sample_id"], other["sample_id"])):
                d[own["sample_id"][:, None] == other["sample_id"]] = -1
            top = max(top, float(d.max()))
        yield from blocks.batches([np.full(1, key[0], own_type), np.array([top])], ["label", "top"])

    shape = f"label {df.schema['label'].dataType.simpleString()}"
    tops = blocks.tiles(packed, None, columns, widest, f"{shape}, top double", ["label"]).groupBy("label").agg(F.max("top").alias("top")).collect()  # a row per class
    shared = df.sparkSession.sparkContext.broadcast({r["label"]: float(rounded(r["top"])) for r in tops})

    def work(key, a, b):
        top = shared.value[key[0]]
        for own, other, same in blocks.couples(a, b):
            ids = other["sample_id"]
            for at in range(0, len(own["vec"]), 100):
                mine = own["sample_id"][at : at + 100]
                i, j = np.repeat(mine, len(ids)), np.tile(ids, len(mine))
                kept = (i < j) if same else (i != j)
                i, j, sims = i[kept], j[kept], top - rounded(squared(own["vec"][at : at + 100], other["vec"]).ravel()[kept])
                yield from blocks.batches([np.full(len(i), key[0], own_type), np.minimum(i, j), np.maximum(i, j), sims], ["label", "id_a", "id_b", "sim"])

    return blocks.tiles(packed, None, columns, work, f"{shape}, id_a long, id_b long, sim double", ["label"])


# --- all pairs ---------------------------------------------------------------------------------------------------


def _products(a: DataFrame, b: DataFrame | None, value, halves: bool) -> DataFrame:
    """(id_a, id_b, sim): value(matrix, matrix), which is symmetric, for every row of a with every row of b (a itself by default), or for pairs a < b alone.

    Rows meet in tiles. Nothing that is made is written here: pairs leave a task as they are read, so the result takes the room
    of its reader alone.
    """
    columns = {"sample_id": "i8"}
    left = blocks.pack(a, columns)
    right = None if b is None else blocks.pack(b, columns)
    alone = b is None

    def work(_, some, others):
        for own, other, same in blocks.couples(some, others):
            ids = other["sample_id"]
            for at in range(0, len(own["vec"]), 100):
                mine = own["sample_id"][at : at + 100]
                sims = value(own["vec"][at : at + 100], other["vec"])
                i, j = np.repeat(mine, len(ids)), np.tile(ids, len(mine))
                if halves:
                    kept = (i < j) if same else (i != j)
                    i, j, flat = i[kept], j[kept], sims.ravel()[kept]
                    yield from blocks.batches([np.minimum(i, j), np.maximum(i, j), flat], ["id_a", "id_b", "sim"])
                else:
                    yield from blocks.batches([i, j, sims.ravel()], ["id_a", "id_b", "sim"])
                    if alone and not same:
                        yield from blocks.batches([j, i, sims.ravel()], ["id_a", "id_b", "sim"])

    return blocks.tiles(left, right, columns, work, "id_a long, id_b long, sim double")


def gram(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, sim): product over the width for every row of a with every row of b (a itself by default).

    The result has a row per pair by definition; operators that only need sums over pairs don't call this.
    """
    return _products(a, b, NUMPY_METRICS["mean_dot"], False)


def all_pairs_l2(df: DataFrame) -> DataFrame:
    """(id_a, id_b, dist) for pairs a < b."""
    return _products(df, None, NUMPY_METRICS["l2"], True).withColumnRenamed("sim", "dist")


def affinity(df: DataFrame, sigma: float) -> DataFrame:
    """(id_a, id_b, sim): absolute cosine over sigma for pairs a < b; the diagonal is zero and the rest symmetric."""
    return _products(df, None, lambda x, y: (1 - NUMPY_METRICS["abs_cos"](x, y)) / sigma, True)


def label_kernel(df: DataFrame, rows: int = 2000) -> DataFrame:
    """(id_a, id_b) for pairs a < b of one class: where the kernel is 1. Elsewhere it is 0.

    A class' ids meet in lists of about so many, each two lists once and in a task of their own, and pairs are made where they are read: what is shuffled is lists, not rows of a class.
    """
    ids = df.select("label", "sample_id").filter("label IS NOT NULL AND sample_id IS NOT NULL")
    sizes = ids.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("__many"))
    lists = cut(ids.join(sizes, "label").groupBy("label", F.pmod(F.xxhash64("sample_id"), F.col("__many")).alias("at")).agg(F.collect_list("sample_id").alias("ids")))
    a = lists.select("label", F.col("at").alias("a"), F.col("ids").alias("ia"))
    b = lists.select("label", F.col("at").alias("b"), F.col("ids").alias("ib"))
    many = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = a.join(b, "label").filter("a <= b").repartition(many, "label", "a", "b")
    pairs = met.select("a", "b", "ib", F.explode("ia").alias("x")).select("a", "b", "x", F.explode("ib").alias("y")).filter("CASE WHEN a = b THEN x < y ELSE x <> y END")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def member_dist(df: DataFrame, assigned: DataFrame, weight: str | None = None, kind: str = "dot") -> DataFrame:
    """(sample_id, cluster_id, dist) of each row to the members of each cluster, weighted.

    dot: 1 less the absolute mean product over the width. l2: the mean squared distance. Both need the members' sums
    alone (a mean of products is the product with the mean), so no pair is formed.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    square = vec.dot(F.col("vec"), F.col("vec"))
    cells = assigned.select("cluster_id", w.alias("w"), F.posexplode("vec").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    sums = cells.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))
    mass = assigned.groupBy("cluster_id").agg(F.sum(w).alias("mass"), F.sum(w * square).alias("square"))
    table = sums.join(mass, "cluster_id").agg(F.collect_list(F.struct("cluster_id", "sum", "mass", "square")).alias("_t"))  # a row per cluster
    product = lambda v, t: vec.dot(v, t["sum"])
    if kind == "dot":
        far = lambda v, t: 1 - F.abs(product(v, t) / (t["mass"] * F.size(v)))
    else:
        far = lambda v, t: F.greatest(vec.dot(v, v) - 2 * product(v, t) / t["mass"] + t["square"] / t["mass"], F.lit(0.0))
    each = vec.bind(F.col("vec"), lambda v: F.transform("_t", lambda t: F.struct(t["cluster_id"].alias("cluster_id"), F.round(far(v, t), 9).alias("dist"))))
    return df.select("sample_id", "vec").join(F.broadcast(table)).select("sample_id", F.explode(each).alias("e")).select("sample_id", "e.cluster_id", "e.dist")


def rescale_by_center_norm(distances: DataFrame, centers: DataFrame) -> DataFrame:
    """distances times the largest norm of a centre over the own centre's norm."""
    norms = centers.select("cluster_id", vec.norm(F.col("vec")).alias("_n"))
    norms = norms.withColumn("_by", F.max("_n").over(Window.partitionBy()) / F.col("_n")).drop("_n")  # a row per centre
    return distances.join(F.broadcast(norms), "cluster_id").withColumn("dist", F.round(F.col("dist") * F.col("_by"), 9)).drop("_by")


def scale_and_extend(df: DataFrame, terms: int = 9) -> DataFrame:
    """Vectors over twice the largest norm, with 0.5 - |x|^(2l) appended for l = 1 to terms."""
    top = norm_range(df).select(F.col("max_norm").alias("_top"))
    scaled = df.join(F.broadcast(top)).withColumn("vec", F.transform("vec", lambda x: x / (2 * F.col("_top"))))
    square = vec.dot(F.col("vec"), F.col("vec"))
    more = vec.bind(square, lambda s: F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda l: 0.5 - F.pow(s, l)))
    return scaled.withColumn("vec", F.concat("vec", more)).drop("_top")
