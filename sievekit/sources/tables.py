"""Sources and sinks: samples, manifests, label overlays, splits, weights by epoch, run logs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import vec

SPLITS = ("train", "valid", "meta", "test", "clean_labels")


def read_samples(spark: SparkSession, path: str, sample_id: str, features: str, label: str | None = None) -> DataFrame:
    cols = [F.col(sample_id).alias("sample_id"), vec.as_double(F.col(features)).alias("vec")]
    return spark.read.parquet(path).select(*cols, *([F.col(label).alias("label")] if label else []))


def read_manifest(labels: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Rows of the label manifest whose object exists."""
    return labels.join(objects.select(key), key, "left_semi")


def list_objects(spark: SparkSession, glob: str, key: str = "file_name") -> DataFrame:
    """(key, path, length) of the files that match; their content isn't read."""
    found = spark.read.format("binaryFile").load(glob).select("path", "length")
    return found.select(F.element_at(F.split("path", "/"), -1).alias(key), "path", "length")


def read_csv_manifest(spark: SparkSession, path: str, objects: str, key: str = "file_name", label: str = "label") -> DataFrame:
    """(key, label, path) of the rows of a CSV manifest with a header whose file is among the objects (a glob)."""
    rows = spark.read.csv(path, header=True).select(F.col(key), F.col(label).cast("int").alias("label"))
    return rows.join(list_objects(spark, objects, key).select(key, "path"), key)


def overlay_labels(df: DataFrame, other: DataFrame) -> DataFrame:
    """Labels of other (sample_id, label) where it has one, else df's own. An id that repeats in other takes its smallest label, so no row of df is repeated."""
    new = other.groupBy(F.col("sample_id").alias("__id")).agg(F.min("label").alias("__new"))
    return df.join(new, F.col("sample_id") == F.col("__id"), "left").withColumn("label", F.coalesce("__new", "label")).drop("__id", "__new")


def save_splits(splits: dict[str, DataFrame], path: str) -> None:
    for name, df in splits.items():
        if name not in SPLITS:
            raise ValueError(f"unknown split {name}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_splits(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """The splits that were saved; None for an absent one."""
    out: dict[str, DataFrame | None] = {}
    for name in SPLITS:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = None
    return out


def save_weights(df: DataFrame, path: str, epoch: int) -> None:
    """Replace the epoch's partition of the weights (sample_id, w); the other epochs stay as they are, also where df is made from them."""
    rows = df.select("sample_id", "w", F.lit(epoch).cast("int").alias("epoch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def saved_epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs that have weights, from the names of their folders: no weight is read. None where nothing is saved."""
    files, at = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def promote_weights(spark: SparkSession, path: str, best: int, to: str) -> None:
    """The weights of the best epoch at a place of their own, to start from. They are written beside it and renamed, so that a reader sees the old ones or the new ones, whole."""
    files, at = _files(spark, to)
    new, old = (_files(spark, f"{to.rstrip('/')}.{name}")[1] for name in ("new", "old"))
    load_weights(spark, path, best).select("sample_id", "w").write.mode("overwrite").parquet(new.toString())
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    if not files.rename(new, at):
        raise OSError(f"{new.toString()} could not be renamed to {to}")
    files.delete(old, True)


def load_weights(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """(sample_id, w, epoch): one epoch's weights, the latest where epoch is None; only its partition is read."""
    if epoch is None:
        epochs = saved_epochs(spark, path)
        if not epochs:
            raise ValueError(f"no weights are saved under {path}")
        epoch = epochs[-1]
    return spark.read.parquet(path).filter(F.col("epoch") == epoch)


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """A table (sample_id, vec) bucketed and sorted by id, its files under path: such tables meet without a shuffle."""
    df.select("sample_id", "vec").write.mode("overwrite").option("path", path).bucketBy(buckets, "sample_id").sortBy("sample_id").saveAsTable(name)


def read_run_logs(spark: SparkSession, glob: str) -> DataFrame:
    """path, epoch, loss and metric from the last line of each log that reports them."""
    last = F.element_at(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), -1)
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    shape = rf"epoch (\d+): {number}, {number}"
    logs = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), last.alias("line"))
    found = [F.regexp_extract("line", shape, i) for i in (1, 2, 3)]
    return logs.filter(F.col("line").rlike(shape)).select("path", found[0].cast("int").alias("epoch"), found[1].cast("double").alias("loss"), found[2].cast("double").alias("metric"))


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df written to the checkpoint folder, so that its plan ends there. On a local master the folder may be unset: then it is a temporary one of this process.

    batch: the most rows of an Arrow batch meanwhile, fewer for rows that are large.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or _local_folder())
    if batch is None:
        return df.checkpoint()
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, str(batch))
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; on a local master, where that may be unset, in a temporary one of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + _local_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="sievekit-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
