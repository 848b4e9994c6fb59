"""Staged tables: intermediate results written once to the shared folder.

A staged table is plain Parquet, so it survives lost executors, is computed
exactly once, and its file sizes tell the optimizer whether it may be
broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


# Temporary folder of each application in local mode that names no shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidewatch-")
    return _LOCAL[context.applicationId]


def _staged(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused."""
    return f"{_staged(spark)}/{label}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged, once none of it is needed any more."""
    fs, location = file_system(spark, _staged(spark))
    fs.delete(location, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as it takes it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished."""
    fs, marker = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def lasting_name(spark: SparkSession, path: str) -> str:
    """A name that is made up once and kept at ``path``."""
    if not is_complete(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def stage(
    df: DataFrame, label: str, partition_by: str | None = None, at: str | None = None
) -> DataFrame:
    """Write ``df`` once and return it as a table read back from storage.

    ``at`` names the place; what an unfinished write left there is replaced.
    """
    spark = df.sparkSession
    path = at or fresh_path(spark, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.mode("overwrite" if at else "errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_in_slots(
    df: DataFrame, label: str, order: list[str], slot: str, slots: int | None = None
) -> DataFrame:
    """``df`` staged in ranges of ``order``, numbered in that order in column ``slot``.

    Equal keys share a slot.  Without ``slots`` adaptive execution sizes the
    ranges by the data, up to ``spark.sql.shuffle.partitions`` of them.  Each
    slot is a folder of its own, so that one that is not needed is not read.
    """
    ranged = df.repartitionByRange(slots, *order) if slots else df.repartitionByRange(*order)
    return stage(ranged.withColumn(slot, F.spark_partition_id()), label, slot)
