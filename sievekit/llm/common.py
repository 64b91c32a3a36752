"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 1000

#: Rows and key bytes up to which a table with a row per key is broadcast, and the places a key has beyond that.
FEW_ROWS, FEW_BYTES, SALTS = 200_000, 32 << 20, 64

#: Rows up to which a table of a few numbers a row is broadcast.
FEW_NUMBERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. On a local master, where that may be unset, under a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="sievekit-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Holds settings of the session while it lasts (dots in their names are written __)."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name) for k, name in names.items()}
    for k, name in names.items():
        spark.conf.set(name, values[k])
    try:
        yield
    finally:
        for k, name in names.items():
            spark.conf.set(name, before[k])


def small_batches(spark: SparkSession, rows: int = 1000):
    """Holds Arrow batches to some rows: whole texts travel through Python, and some are very long."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(min(now, rows) if now > 0 else rows))


def small_reads(spark: SparkSession):
    """Holds a task that reads texts to few of them at a time."""
    return settings(spark, spark__sql__parquet__columnarReaderBatchSize="512")


def materialize(df: DataFrame, label: str, batch: int = 1000, row_group: int = 128 << 20) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs no recomputation.

    batch: most rows of an Arrow batch meanwhile, fewer for rows that are large. row_group: bytes that a task holds
    before it writes them.
    """
    path = scratch_path(df.sparkSession, label)
    with small_batches(df.sparkSession, batch):
        df.write.option("parquet.block.size", str(row_group)).parquet(path)
    for open_ in _OPEN:
        open_.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete written tables that nothing reads any more (frames that materialize returned, or their paths)."""
    for one in written:
        files = [one + "/"] if isinstance(one, str) else one.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_OPEN: list[scratch] = []


class scratch:
    """Deletes the tables that materialize wrote inside a with block when it ends, but for those given to keep.

    What the block returns must be written, or come from kept tables alone.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """df, the last table that was written, which stays."""
        self.kept.add(self.paths[-1])
        return df

    def __enter__(self) -> scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)
        drop(self.spark, *(p for p in self.paths if p not in self.kept))


def join_per_key(df: DataFrame, key: Column, per_key: DataFrame, of: str, spread: list[Column], how: str = "left", few_rows: int = FEW_ROWS) -> DataFrame:
    """df joined with per_key, a written table with one row for each value of its column ``of``; null keys match.

    Where its counted rows and bytes are few, per_key travels to every task and df stays where it is. Beyond that
    each of its rows goes to SALTS places and df's rows are dealt to them by a hash of spread, so that a key that
    holds a third of all rows has no task of its own.
    """
    rows, size = per_key.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(of)))).first()
    same = key.eqNullSafe(F.col(of))
    if rows <= few_rows and (size or 0) <= FEW_BYTES:
        return df.join(F.broadcast(per_key), same, how)
    copies = per_key.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies, same & (F.col("_salt") == F.col("_place")), how).drop("_salt", "_place")


def join_counted(df: DataFrame, numbers: DataFrame, on, how: str = "inner", few: int = FEW_NUMBERS, rows: int | None = None) -> DataFrame:
    """df joined with a table of a few numbers a row, which travels to every task where its rows are few, so that df stays where it is.

    The table is written, because it is counted; for another one give rows, the most it can have.
    """
    return df.join(F.broadcast(numbers) if (numbers.count() if rows is None else rows) <= few else numbers, on, how)


def id_modulus(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def release() -> None:
    """Give memory that this process holds and nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches; behind the last one the worker, which waits for other tasks, gives its memory back."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def map_rows(df: DataFrame, inputs: list[str], setup: Callable[[], Callable], outputs: str, keep: list[str] | None = None) -> DataFrame:
    """Add columns computed by Python in Arrow batches.

    Every row of df travels as one struct column ``row``, so that no column name of df can clash with an
    output. setup runs once in each task and returns a function that maps the lists of the input columns
    to the lists of the output columns. The result has ``row`` and the outputs; keep names the columns that
    ``row`` has afterwards, all where it is None.
    """
    keep = df.columns if keep is None else keep
    outs = T._parse_datatype_string(outputs)
    at = [df.columns.index(c) for c in inputs]
    stay, all_ = [df.columns.index(c) for c in keep], keep == df.columns
    schema = T.StructType([T.StructField("row", T.StructType([df.schema.fields[i] for i in stay]), False), *outs.fields])
    arrow = to_arrow_schema(outs)

    def run(batches):
        fn = setup()
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                row = whole.slice(begin, SLICE).column(0)
                cols = fn(*(row.field(i).to_pylist() for i in at))
                row = row if all_ else pa.StructArray.from_arrays([row.field(i) for i in stay], names=keep)
                arrays = [row, *(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", *arrow.names])

    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    return packed.mapInArrow(releasing(run), schema)
