"""Rows packed in matrices that meet block by block: work on pairs is a NumPy product for each two blocks, and only what is made of it leaves a task.

Blocks are written once. Where two sets meet, each is cut into stripes of some blocks; a stripe of one and a stripe
of the other make a task's work, so a row is copied once for each stripe of the other side, not for each row of it.
A task holds one stripe of the right side and one block of the left.

tiles() does the same without writing what is made: a task holds two stripes whole and passes on what it makes as it goes. A
set that meets itself does so by unordered pairs, each two blocks once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievekit.sources.tables import cut

#: Rows of a block, blocks of a stripe, blocks of an Arrow batch, rows of a batch that leaves a task.
ROWS, STRIPE, BATCH, OUT = 1000, 16, 16, 50_000
#: Bytes of vectors of a tile's stripe at most (one block at least), tiles for each core at least where blocks suffice, and most partitions of tiles.
STRIPE_BYTES, TILES, PARTITIONS = 16 << 20, 3, 20_000
Block = dict[str, np.ndarray]


def matrix(column, like: int | None = None) -> np.ndarray:
    """The rows of an Arrow list column as a matrix. Vectors of several widths (or not of width like), and null components, are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("a vector or one of its components is null")
    n = len(column)
    width = len(flat) // n if n else 0
    if n and ((np.asarray(column.value_lengths()) != width).any() or like not in (None, width)):
        raise ValueError("vectors of several widths")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, width)


def arrow_type(kind) -> pa.DataType:
    return to_arrow_type(kind)


def pack(df: DataFrame, columns: dict[str, str], by: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """(by, block, n, vec, and columns), written: rows of df in matrices of about so many, each column (name -> NumPy type, without nulls) packed as bytes.

    by: columns that all rows of a block share (integers, null being a value of its own). Rows are dealt to blocks by a hash
    of sample_id. Null vectors are left out.
    """
    by = by or []
    df = df.filter(F.col("vec").isNotNull())
    if by:
        sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("__many"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        dealt = df.join(sizes.select(*(F.col(c).alias(f"__{c}") for c in by), "__many"), same).drop(*(f"__{c}" for c in by))
    else:
        dealt = df.withColumn("__many", F.lit(max(1, -(-df.count() // rows))).cast("long"))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("sample_id"), F.col("__many")))
    names = [*by, "__block"]
    slim = dealt.select(*names, "vec", *(c for c in columns))
    shape = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "block long", "n int", "vec binary", *(f"{c} binary" for c in columns)])

    fields = [pa.field(c, arrow_type(df.schema[c].dataType)) for c in by]
    out = pa.schema([*fields, pa.field("block", pa.int64()), pa.field("n", pa.int32()), *(pa.field(c, pa.binary()) for c in ("vec", *columns))])

    def packed(key, table):
        made = [[] for _ in out]
        for at in range(0, table.num_rows, 2 * rows):
            part = table.slice(at, 2 * rows)
            data = [matrix(part.column("vec")).tobytes(), *(part.column(c).to_numpy().astype(t).tobytes() for c, t in columns.items())]
            for column, value in zip(made, [*(k.as_py() for k in key), part.num_rows, *data], strict=True):
                column.append(value)
        return pa.table([pa.array(v, f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return cut(slim.groupBy(*names).applyInArrow(packed, shape), BATCH)


def unpack(row: dict, columns: dict[str, str]) -> Block:
    """The arrays of a packed row; vec is a matrix."""
    return {"vec": np.frombuffer(row["vec"], np.float64).reshape(row["n"], -1), **{c: np.frombuffer(row[c], t) for c, t in columns.items()}}


def together(blocks: list[Block]) -> Block:
    return {c: np.concatenate([b[c] for b in blocks]) for c in blocks[0]}


def batches(arrays: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrays of one length as record batches of bounded size."""
    for at in range(0, len(arrays[0]), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + OUT]) for a in arrays], names=names)


def meet(left: DataFrame, right: DataFrame, columns: dict[str, str], of_left: Callable[[], object], step: Callable, shape: str, stripe: int = STRIPE) -> DataFrame:
    """Every block of left with every stripe of right, both packed with the same columns; written.

    step(state, block, stripe) yields record batches of the shape; state is what of_left() makes once a task.
    """
    last = [side.agg(F.max("block")).first()[0] for side in (left, right)]
    stripes = [1 if top is None else top // stripe + 1 for top in last]
    own = [F.pmod("block", F.lit(many)) for many in stripes]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = ["n", "vec", *columns]
    a = left.select(own[0].alias("__s"), every(stripes[1]).alias("__g"), F.lit(1).alias("__turn"), *names)
    b = right.select(every(stripes[0]).alias("__s"), own[1].alias("__g"), F.lit(0).alias("__turn"), *names)
    dealt = a.unionByName(b).repartition("__s", "__g").sortWithinPartitions("__s", "__g", "__turn")

    def run(incoming):
        state, key, held, whole = of_left(), None, [], None
        for batch in incoming:
            for row in batch.to_pylist():
                at = (row["__s"], row["__g"])
                if at != key:
                    key, held, whole = at, [], None
                if row["__turn"] == 0:
                    held.append(unpack(row, columns))
                elif held:
                    whole = together(held) if whole is None else whole
                    yield from step(state, unpack(row, columns), whole)

    return cut(dealt.mapInArrow(run, shape), BATCH)


def tiles(left: DataFrame, right: DataFrame | None, columns: dict[str, str], work: Callable, shape: str, by: list[str] | None = None, also: list[str] | None = None) -> DataFrame:
    """Every stripe of left with every stripe of right that agrees in by (integers), both packed with the same columns; not written.

    work(key, a, b) gets the values of by and the two stripes as lists of blocks, and yields record batches of the shape. Where
    right is None, left meets itself: each two stripes meet once, in either order, and a stripe meets itself with b None. also:
    whole numbers of a packed row that its block has as well. A column may be null in all blocks of one side, which lack it then. What is shuffled is each row once for each stripe of the other side.
    """
    by, also, spark = by or [], also or [], left.sparkSession
    sizes = []
    for side in (left, left if right is None else right):
        found = side.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.max(F.length("vec")).alias("__w")).collect()  # a row for each value of by
        sizes.append({tuple(r[c] for c in by): (r["__n"], r["__w"]) for r in found if r["__n"]})
    keys = [k for k in sizes[0] if k in sizes[1]]
    if not keys:
        return spark.createDataFrame([], shape)
    pairs = sum(sizes[0][k][0] * sizes[1][k][0] for k in keys) / (2 if right is None else 1)
    large = max(w for s in sizes for _, w in s.values())
    length = max(1, min(STRIPE_BYTES // max(large, 1), int((pairs / (TILES * spark.sparkContext.defaultParallelism)) ** 0.5)))
    plan, total = [], 0
    for key in keys:
        m, other = (-(-s[key][0] // length) for s in sizes)
        plan.append((*key, m, other, total))
        total += m * (m + 1) // 2 if right is None else m * other
    fields = ", ".join([*(f"__{c} long" for c in by), "__m long", "__o long", "__at long"])
    table = F.broadcast(spark.createDataFrame(plan, fields))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    number = F.xxhash64(*(c for c in ("block", *also))) if also else F.col("block")

    def side(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        return df.join(table, same).withColumn("__s", F.pmod(number, F.col(mine))).withColumn("__g", every(F.col(theirs)))

    if right is None:
        low, high = F.least("__s", "__g"), F.greatest("__s", "__g")
        place = F.col("__at") + F.expr("least(__s, __g) * (2 * __m - least(__s, __g) + 1) div 2") + high - low
        dealt = side(left, "__m", "__m").withColumns({"__tile": place, "__side": (F.col("__s") > F.col("__g")).cast("int"), "__self": F.col("__s") == F.col("__g")})
    else:
        a = side(left, "__m", "__o").withColumns({"__tile": F.col("__at") + F.col("__s") * F.col("__o") + F.col("__g"), "__side": F.lit(0)})
        b = side(right, "__o", "__m").withColumns({"__tile": F.col("__at") + F.col("__g") * F.col("__o") + F.col("__s"), "__side": F.lit(1)})
        dealt = a.select(*(names := ["__tile", "__side", "n", "vec", *columns, *by, *(c for c in also if c not in by)])).unionByName(b.select(*names)).withColumn("__self", F.lit(False))
    many = min(total, PARTITIONS)
    scalars = [*by, *(c for c in also if c not in by)]
    dealt = dealt.select("__tile", "__side", "__self", "n", "vec", *columns, *scalars).repartitionById(many, F.pmod("__tile", F.lit(many)).cast("int"))
    if many < total:
        dealt = dealt.sortWithinPartitions("__tile")

    def run(incoming):
        now, key, alone, held = None, (), False, ([], [])
        for batch in incoming:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                value = lambda c: batch.column(at[c])[i]  # noqa: B023, E731
                tile = value("__tile").as_py()
                if tile != now:
                    if held[0] and (alone or held[1]):
                        yield from work(key, held[0], None if alone else held[1])
                    now, key, alone, held = tile, tuple(value(c).as_py() for c in by), value("__self").as_py(), ([], [])
                own = {"vec": np.frombuffer(value("vec").as_buffer(), np.float64).reshape(value("n").as_py(), -1)}
                own |= {c: np.frombuffer(value(c).as_buffer(), t) for c, t in columns.items() if value(c).is_valid} | {c: value(c).as_py() for c in scalars}
                held[value("__side").as_py()].append(own)
        if held[0] and (alone or held[1]):
            yield from work(key, held[0], None if alone else held[1])

    return dealt.mapInArrow(run, shape)


def couples(a: list[Block], b: list[Block] | None) -> Iterator[tuple[Block, Block, bool]]:
    """The blocks of a with those of b; without b, those of a with each other, each two once, and with themselves (True)."""
    for i, own in enumerate(a):
        for j, other in enumerate(a[i:] if b is None else b):
            yield own, other, b is None and j == 0
