"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target in words over its size is the number of copies that each of its documents should have; the
whole part is certain and the fraction is rounded. Two documents with fractions meet, word mass moves from one
to the other at random (each way with the chance that keeps both expectations) until one fraction is 0 or 1;
the other goes on. Chunks of documents do so at once, and what is left of each chunk meets in the next level
of a tree. So a source's words stay at its target up to the last residual.

Documents above their source's mean mass go first; the rest then takes up what their last residual left over,
so that the final error is below one document of ordinary length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import join_counted, join_per_key, materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """share: the mix's words over all words; cap: most copies; fan: documents or residuals that meet in a chunk, on average;
    block: rows alike, or copies of one, that one task makes at a time."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: int = 2
    seed: int = 17
    fan: int = 200
    block: int = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, params: Params = Params()) -> DataFrame:
    """source, source_size, n_units, mean_mass and target for each source, as a written table.

    Sources in code point order (null last) take the weights in turn: they are written in that order, and a source's
    place is its place in its partition behind the partitions before. A target stops at cap times its source's
    size and what is above is shared again by weight, until none is above; each round is a sum over the sources.
    """
    sums = units.groupBy("source").agg(F.sum("mass").alias("source_size"), F.count(F.when(F.col("mass") > 0, 1)).alias("n_units"))
    ordered = materialize(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mixing-sources")
    part = F.shiftright("place", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("many"))
    parts = parts.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))  # a row per partition
    ranked = ordered.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("pos", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    weights = F.array(*(F.lit(float(w)) for w in params.weights))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.pmod(F.col("pos"), F.lit(len(params.weights))) + 1).cast("int")))
    ranked = materialize(ranked.withColumn("most", F.col("source_size") * float(params.cap)).drop("part", "place", "before", "pos"), "mixing-weights")
    budget, level, seen = params.share * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most") if seen >= 0 else F.lit(False)
        sums_ = ranked.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count(F.when(above, 1))).first()
        if sums_[2] == seen or not sums_[1]:
            break
        level, seen = (budget - sums_[0]) / sums_[1], sums_[2]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight")) if sums_[1] else F.col("most")
    return ranked.select("source", "source_size", "n_units", (F.col("source_size") / F.greatest(F.col("n_units"), F.lit(1))).alias("mean_mass"), target.alias("target"))


def _uniform(*cols) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _meet(acc: Column, x: Column) -> Column:
    """One pivotal step: the residual acc.cur (p < 0: none) meets x; what becomes 0 or 1 goes to acc.done."""
    c = acc["cur"]
    up = F.least((1 - c["p"]) * c["mass"], x["p"] * x["mass"])
    down = F.least(c["p"] * c["mass"], (1 - x["p"]) * x["mass"])
    raised = x["u"] * (up + down) < down
    unit = lambda s, p: F.struct(s["key"].alias("key"), s["k"].alias("k"), s["mass"].alias("mass"), s["u"].alias("u"), p.cast("double").alias("p"))
    c_full = F.when(raised, (1 - c["p"]) * c["mass"] <= x["p"] * x["mass"]).otherwise(c["p"] * c["mass"] <= (1 - x["p"]) * x["mass"])
    c_end, x_end = F.when(raised, 1.0).otherwise(0.0), F.when(raised, 0.0).otherwise(1.0)
    x_left = F.when(raised, x["p"] - up / x["mass"]).otherwise(x["p"] + down / x["mass"])
    c_left = F.when(raised, c["p"] + up / c["mass"]).otherwise(c["p"] - down / c["mass"])
    fresh = F.struct(unit(x, x["p"]).alias("cur"), acc["done"].alias("done"))
    met = F.when(c_full, F.struct(unit(x, F.least(F.greatest(x_left, F.lit(0.0)), F.lit(1.0))).alias("cur"), F.concat(acc["done"], F.array(unit(c, c_end))).alias("done"))).otherwise(
        F.struct(unit(c, F.least(F.greatest(c_left, F.lit(0.0)), F.lit(1.0))).alias("cur"), F.concat(acc["done"], F.array(unit(x, x_end))).alias("done"))
    )
    return F.when(c["p"] < 0, fresh).otherwise(met)


_UNIT = ("source", "key", "k", "mass")


def _level(units: DataFrame, number: int, chunks: Column, params: Params) -> DataFrame:
    """source and n_units with ``cur`` (residual) and ``done`` (decided) of each chunk of units (source, n_units, key, k, mass, p)."""
    kind = "struct<key:bigint,k:bigint,mass:bigint,u:double,p:double>"
    u = _uniform(F.lit(params.seed), F.lit(number), "key", "k")
    place = F.xxhash64(F.lit(params.seed + 1), F.lit(number), "key", "k")
    packed = units.withColumn("chunk", F.pmod(place, chunks))
    item = F.struct(place.alias("place"), F.col("key").alias("key"), F.col("k").alias("k"), F.col("mass").alias("mass"), u.alias("u"), F.col("p").alias("p"))
    grouped = packed.groupBy("source", "n_units", "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("key", "k")), F.lit(1).cast("bigint").alias("mass"), F.lit(0.0).alias("u"), F.lit(-1.0).alias("p"))
    state = F.struct(none.alias("cur"), F.array().cast(f"array<{kind}>").alias("done"))
    return grouped.select("source", "n_units", F.aggregate("items", state, lambda acc, x: _meet(acc, x)).alias("r")).select("source", "n_units", "r.cur", "r.done")


def _tree(units: DataFrame, largest: int, label: str, params: Params) -> DataFrame:
    """(source, key, k, mass, extra) for each unit, from (source, key, k, mass, p, n_units).

    largest: units of the largest source; it sets the number of levels, which grows with its logarithm.
    """
    decided, number = [], 0
    certain = (F.col("p") <= 0) | (F.col("p") >= 1)
    decided.append(units.filter(certain).select(*_UNIT, F.col("p").cast("int").alias("extra")))
    now = units.filter(~certain)
    while True:
        chunks = F.greatest(F.ceil(F.col("n_units") / F.lit(float(params.fan ** (number + 1)))), F.lit(1)).cast("long")
        done = materialize(_level(now, number, chunks, params), f"mixing-{label}-{number}")
        decided.append(done.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.k", "d.mass", F.col("d.p").cast("int").alias("extra")))
        number += 1
        now = done.filter("cur.p >= 0").select("source", "n_units", "cur.key", "cur.k", "cur.mass", "cur.p")
        if params.fan**number >= largest:
            u = _uniform(F.lit(params.seed), F.lit(-1), "key", "k")
            decided.append(now.select(*_UNIT, (u < F.col("p")).cast("int").alias("extra")))
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def row_key(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of all of a row's columns and of which of them are null (hashes pass over nulls). Two with different seeds tell any rows apart that differ."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(F.lit(seed), *columns, *(c.isNull() for c in columns))


def _same_unit(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b (_UNIT and more) where all of key, k, mass and source agree: a key alone may be that of two rows."""
    other = b.select(*(F.col(c).alias(f"_{c}") for c in _UNIT), *(c for c in b.columns if c not in _UNIT))
    same = [F.col(c) == F.col(f"_{c}") for c in ("key", "k", "mass")] + [F.col("source").eqNullSafe(F.col("_source"))]
    return a.join(other, same, how).drop(*(f"_{c}" for c in _UNIT))


def _each(rows: DataFrame, many: str, name: str, params: Params) -> DataFrame:
    """Each row as often as its column many says, numbered from 1 in name; large numbers are made in blocks, by several tasks."""
    few = rows.filter(F.col(many) <= params.block).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many))))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / params.block).cast("long"))
    more = rows.filter(F.col(many) > params.block).withColumn("_block", F.explode(blocks)).repartition("key", "_block")
    last = F.least(F.col(many), (F.col("_block") + 1) * params.block)
    return few.unionByName(more.withColumn(name, F.explode(F.sequence(F.col("_block") * params.block + 1, last))).drop("_block"))


def plan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """key, check, k, doc_id, source, mass (size in words), source_size, target and copies of each row.

    Rows alike in all columns share a key and are numbered by k, so that each is rounded on its own. Null ids are an
    id, null sources a source; texts without words take no part and get the certain copies. Reruns agree, however
    the rows are dealt: chance comes from hashes of the seed, the key and the number.
    """
    slim = docs.select(row_key(docs).alias("key"), row_key(docs, 1).alias("check"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("mass"))
    units = slim.groupBy("key", "check", "doc_id", "source", "mass").agg(F.count(F.lit(1)).alias("n"))
    units = materialize(_each(materialize(units, "mixing-rows"), "n", "k", params).drop("n"), "mixing-units")
    goals = targets(units, params)
    largest = goals.agg(F.max("n_units")).first()[0] or 1
    of = goals.withColumnRenamed("source", "of")
    spread = [F.col("key"), F.col("k")]
    full = join_per_key(units, F.col("source"), of, "of", spread, "inner").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = full.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    alive = full.filter("mass > 0")
    tall = alive.filter(F.col("mass") > F.col("mean_mass"))
    first = materialize(_tree(tall.select("source", "key", "k", "mass", "p", "n_units"), largest, "tall", params), "mixing-tall")
    # what the tall ones took more or less than their due is the others' to make up
    over = _same_unit(first, tall.select(*_UNIT, "p")).groupBy("source").agg(F.sum((F.col("extra") - F.col("p")) * F.col("mass")).alias("over"))
    low = alive.filter(F.col("mass") <= F.col("mean_mass"))
    room = low.groupBy("source").agg(F.sum("mass").alias("room")).withColumnRenamed("source", "of")
    shift = room.join(over, F.col("of").eqNullSafe(F.col("source")), "left").select("of", (F.coalesce("over", F.lit(0.0)) / F.col("room")).alias("shift"))
    low = join_per_key(low, F.col("source"), materialize(shift, "mixing-shift"), "of", spread).drop("of")
    moved = F.when((F.col("p") > 0), F.least(F.greatest(F.col("p") - F.coalesce("shift", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("p"))
    second = _tree(low.withColumn("p", moved).select("source", "key", "k", "mass", "p", "n_units"), largest, "low", params)
    out = _same_unit(full, first.unionByName(second), "left")
    copies = F.least(F.col("whole") + F.coalesce("extra", F.lit(0)), F.lit(params.cap))
    return out.select("key", "check", "k", "doc_id", "source", "mass", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row per document (repeated rows each have theirs)."""
    rows = plan(docs.select("doc_id", "source", "text"), params)
    return rows.select("doc_id", F.col("mass").alias("size"), "source_size", "target", (F.col("copies") * F.col("mass")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    Rows alike in everything are brought together first and copied as often as all of them are taken.
    """
    chosen = plan(docs, params).groupBy("key", "check").agg(F.count(F.lit(1)).alias("alike"), F.sum("copies").alias("copies")).filter("copies > 0")
    chosen = materialize(chosen, "mixing-chosen")
    packed = docs.select(row_key(docs).alias("key"), row_key(docs, 1).alias("check"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = join_counted(packed, chosen.filter("alike = 1").select("key", "check", "copies"), ["key", "check"]).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    repeated = materialize(chosen.filter("alike > 1").select(F.col("key").alias("of"), F.col("check").alias("_check"), "copies"), "mixing-repeated") if chosen.filter("alike > 1").limit(1).count() else None
    if repeated is None:
        return single.select("row.*")
    together = join_per_key(packed, F.col("key"), repeated, "of", [F.monotonically_increasing_id()], "inner").filter("check = _check").drop("of", "_check")
    together = together.groupBy("key", "check", "copies").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(_each(together, "copies", "_k", params).select("row.*"))
