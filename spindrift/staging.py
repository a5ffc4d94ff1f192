"""Tables written to the folder that the whole cluster shares.

Staging cuts lineage in a way that survives lost executors: the rows are Parquet files under
``spark.checkpoint.dir``, so a later read never depends on blocks that one executor holds.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no folder and everything runs in this one process.
LOCAL_FOLDER = "/tmp/spindrift-shared"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only under a ``local`` master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_FOLDER


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared folder."""
    return f"{shared_folder(spark)}/spindrift-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's folder."""
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that were not written elsewhere can't be read any more."""
    delete(spark, own_folder(spark))


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return read_staged(df.sparkSession, path, df.schema)


def read_staged(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over and whose plans nothing refers to any more.

    Spark's cleaner follows the driver's garbage collection, which may be a long time off while shuffle files fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``staged`` returned; it must not be read again."""
    delete(df.sparkSession, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
