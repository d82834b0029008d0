"""Writers of results: appended tables committed by Spark, one manifest a run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(results: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's results, in a folder of its own."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def replace_run(results: DataFrame, path: str, run_id: str) -> None:
    """Writes a run's results in the place of what it wrote before; other runs stay."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def manifest(spark: SparkSession, path: str, run_id: str, settings: dict[str, Any]) -> None:
    """One row: the run and its settings as text."""
    spark.createDataFrame([(run_id, {k: str(v) for k, v in settings.items()})], "run_id string, settings map<string,string>").coalesce(1).write.mode("append").json(path)


def manifests(runs: DataFrame, path: str, run_id: str, settings: list[str]) -> None:
    """A row like manifest()'s for each row of runs, its settings from the columns named."""
    of = F.create_map(*[x for c in settings for x in (F.lit(c), F.col(c).cast("string"))])
    runs.select(F.col(run_id).alias("run_id"), of.alias("settings")).write.mode("append").json(path)


def merged(spark: SparkSession, paths: list[str], keys: list[str], version: str) -> DataFrame:
    """Chunks of results as one table: of each key the row of highest version."""
    rows = None
    for p in paths:
        d = spark.read.parquet(p)
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def updated(rows: DataFrame, path: str, value: Column) -> DataFrame:
    """rows with the field at a dotted path set: `a.b.c` sets field b.c of the struct column a."""
    column, _, field = path.partition(".")
    return rows.withColumn(column, F.col(column).withField(field, value) if field else value)


def log_lines(results: DataFrame, case: str, correct: str, output: str, answer: str) -> DataFrame:
    """Results as log lines, the running accuracy excepted."""
    text = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("None"))
    return results.select(F.concat(F.lit("Case #"), case, F.lit(": correct="), F.initcap(F.col(correct).cast("string")), F.lit(", output="), text(output), F.lit(", answer="), text(answer)).alias("value"))


def disagreements(rows: DataFrame, path: str, kind: str, text: str, dataset: str) -> None:
    """A text folder for each dataset and kind of disagreement."""
    rows.select(F.col(dataset).alias("dataset"), F.col(kind).alias("kind"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("dataset", "kind").text(path)


def by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object a row, {key: value}: answers keyed by id, a line each."""
    return rows.select(F.to_json(F.map_from_entries(F.array(F.struct(F.col(key).cast("string"), F.col(value))))).alias("value"))


def compressed(rows: DataFrame, path: str) -> None:
    """A table of one text column as gzipped text files, such as tree logs that are sent elsewhere."""
    rows.write.option("compression", "gzip").text(path)
