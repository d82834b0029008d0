"""Tables that a job writes and reads again: between iterations they cut the lineage, and a lost executor costs no more than the step at hand."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the session's spark.checkpoint.dir. Where that is unset a temporary one serves a local session; on a cluster, whose machines don't share one, that is an error. The folder goes when the session ends."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _temporary()
    path = f"{shared}/thicket-{uuid.uuid4().hex}"
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


_LOCAL: list[tempfile.TemporaryDirectory] = []


def _temporary() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="thicket-", ignore_cleanup_errors=True))
        atexit.register(_LOCAL[0].cleanup)
    return _LOCAL[0].name


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own, computed once."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
