"""Cutting lineage with tables in the folder that all executors share.

Iterative operators and operators that read an intermediate result twice write it
once and read it back.  A written table survives the loss of an executor, is
columnar and compressed, and gives the planner real file statistics.

The tables of an application lie in one folder of its own.  A loop removes the tables of earlier rounds itself; what
results are read from stays until `release` is called or the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sheaf-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    path = f"{shared_dir(spark)}/sheaf-{spark.sparkContext.applicationId}"
    _used.add(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df to the shared folder and return a scan of the written table."""
    return staged(df, label)[0]


def staged(df: DataFrame, label: str = "stage") -> tuple[DataFrame, str]:
    """The same with the path of the table, for a reader that knows when it is done."""
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, whatever file system it is on; nothing happens if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has staged; results that are read from them are gone then."""
    remove(spark, own_dir(spark))


def _at_exit() -> None:
    session = SparkSession.getActiveSession()
    for path in _used:
        try:
            remove(session, path)
        except Exception:  # the JVM has ended first
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


atexit.register(_at_exit)
