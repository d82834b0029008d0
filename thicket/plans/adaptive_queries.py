"""Beam search with a depth that the model raises, over each user's events: from an event the search goes to the next or the one after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import search
from thicket.plans.tables import STEPS, steps

QUERIES, ORACLES = {}, {}
WIDTH, DEPTH, LIMIT = 2, 2, 7


def adaptive_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each user: two levels, and one more whenever a kept event's k is a multiple of three, seven at most."""
    s = steps(spark, sf_dir).select(F.col("user_id").alias("_u"), F.col("pos").alias("_p"), "value", "k")

    def children(frontier: DataFrame) -> DataFrame:
        at = F.col("parent_id").cast("long")
        j = frontier.withColumn("_to", F.explode(F.array(at + 1, at + 2))).join(s, (F.col("example_id") == F.col("_u")) & (F.col("_to") == F.col("_p")))
        more = F.when(F.col("k") % 3 == 0, 1).otherwise(0)
        return j.select(*frontier.columns, F.col("_p").cast("string").alias("node_id"), F.lit("go").alias("action"), F.col("value").alias("reward"), F.lit(False).alias("terminal"), F.col("_p").alias("pos"), more.alias("more"))

    roots = s.where("_p = 0").select(F.col("_u").alias("example_id"), F.lit("0").alias("node_id"))
    b = search.adaptive_beam(roots, children, WIDTH, DEPTH, LIMIT)
    return b.select("example_id", "depth", "budget", F.array_join("path_ids", ">").alias("path"), F.round("score", 4).alias("score"))


def _sql() -> str:
    steps_ = [STEPS, f"b0 AS (SELECT user_id, pos AS place, ['0'] AS path, CAST(0 AS DOUBLE) AS score, {DEPTH} AS budget FROM s WHERE pos = 0)"]
    for t in range(1, LIMIT + 1):
        steps_.append(f"""g{t} AS MATERIALIZED (SELECT user_id, place, path, score, least({LIMIT}, budget + max(more) OVER (PARTITION BY user_id)) AS budget FROM (
  SELECT b.user_id, s.pos AS place, list_append(b.path, CAST(s.pos AS VARCHAR)) AS path, b.score + s.value AS score, b.budget, CASE WHEN s.k % 3 = 0 THEN 1 ELSE 0 END AS more
  FROM b{t - 1} b JOIN s ON b.user_id = s.user_id AND s.pos IN (b.place + 1, b.place + 2)
  QUALIFY row_number() OVER (PARTITION BY b.user_id ORDER BY b.score + s.value DESC, list_append(b.path, CAST(s.pos AS VARCHAR))) <= {WIDTH}))""")
        steps_.append(f"b{t} AS (SELECT * FROM g{t} WHERE budget > {t})")
    ends = " UNION ALL ".join(f"SELECT *, {t} AS depth FROM g{t} WHERE budget <= {t}" for t in range(1, LIMIT + 1))
    return f"""WITH {", ".join(steps_)}, e AS ({ends})
SELECT user_id AS example_id, CAST(depth AS INTEGER) AS depth, CAST(budget AS INTEGER) AS budget, array_to_string(path, '>') AS path, round(score, 4) AS score
FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path) = 1"""


QUERIES["adaptive_beam"] = adaptive_beam
ORACLES["adaptive_beam"] = _sql()
