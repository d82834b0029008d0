"""Driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import thicket
from thicket.storage import folder

__all__ = ["STEPS", "folder", "labelled", "read", "steps"]

#: Executor-side code must not depend on how the package was installed there.
cloudpickle.register_pickle_by_value(thicket)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as steps: user_id, pos (from 0, by time), event_id, ts, event_type, value, k (of props)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


#: The same in SQL, as the common table expression s.
STEPS = """s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
