"""Shared helpers: worker imports, Arrow maps, staging in the shared folder."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Rows of one Arrow batch; Spark also bounds a batch in bytes (64 MB by default),
# so long texts make it shorter.
BATCH_ROWS = 1000


def _workers_can_import(spark: SparkSession) -> None:
    """Python workers find this package by the driver's own path to it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])


def map_batches(df: DataFrame, fn, schema: str, through: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with importable functions and bounded batches.

    ``fn`` takes an iterator of record batches and yields dicts of column
    name to list, numpy or Arrow array, for the columns of ``schema``.
    ``through`` names a column of ``df`` that comes out unchanged, as the last.
    """
    spark = df.sparkSession
    _workers_can_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = spark.createDataFrame([], schema).schema
    types = {f.name: _arrow_type(f.dataType.simpleString()) for f in out}
    if through:
        out, types[through] = out.add(df.schema[through]), None
    return df.mapInArrow(_Mapped(fn, types), out)


class _Mapped:
    def __init__(self, fn, types: dict):
        self.fn, self.types = fn, types

    def __call__(self, batches):
        for columns in self.fn(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[n], pa.Array) else pa.array(c, t) for n, t in self.types.items()],
                names=list(self.types))


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[name]


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` where ``right`` is aggregated by ``keys`` (the first a long).

    Spark splits the rows of a hot key only if both sides come straight from a
    shuffle for the join. The first key's complement has another partitioning
    than the aggregation, so its (smaller) result is shuffled once more.
    """
    a = left.withColumn("_apart", F.bitwise_not(keys[0]))
    b = right.withColumn("_apart", F.bitwise_not(keys[0])).drop(keys[0])
    return a.join(b, ["_apart", *keys[1:]], how).drop("_apart")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a scratch folder only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="overhaul-llm-"))
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but stays columnar and survives lost
    executors. Folders live under the application's id; see ``drop_staged``.
    The shuffle files that the written steps have used are of no more use;
    Spark drops them once the driver has collected its garbage.
    """
    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _stage_root(spark: SparkSession) -> str:
    return f"{_shared_folder(spark)}/overhaul-llm-{spark.sparkContext.applicationId}"


def unstage(df: DataFrame) -> None:
    """Delete the folder of a frame that ``stage`` gave (with columns added or not), which nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote in this application, once results are stored."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
