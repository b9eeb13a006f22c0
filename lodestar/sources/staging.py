"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[str] = []


def ship(context: SparkContext) -> None:
    """Sends this package to the executors, once for each application, so that it need not be installed there."""
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), f"lodestar-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, "lodestar")):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    out.write(whole, os.path.relpath(whole, top))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir; where that is unset, in a temporary folder, but only if all runs on this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/lodestar/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared path and reads it back.

    What follows starts from a plain scan: lost executors recompute it from there, and the optimizer doesn't carry wide
    projections' constraints through joins.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(context: SparkContext, name: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    _written.remove(df.staged_path)
    _delete(df.sparkSession.sparkContext, df.staged_path)


def released(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark deletes the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(context: SparkContext) -> None:
    """Deletes the tables that this process has staged; call it when no result that reads them is needed any more."""
    while _written:
        _delete(context, _written.pop())


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, if it has at most so many rows; more are refused, none are left out."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} are worked on in one task, at most {most} rows")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of an input with fewer partitions than the cluster has cores over all cores; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
