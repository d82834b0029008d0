"""Significance of paired differences; the SQL sums the finite series that Student's distribution has for whole degrees of freedom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.statistics import t_test_p
from thicket.plans.tables import labelled

QUERIES, ORACLES = {}, {}


def paired_ttest_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language and source the paired t-test of quality against toxicity: n, t, and the two-sided p-value. Groups of one pair, or without any spread, have neither."""
    d = labelled(spark, sf_dir).withColumn("d", F.col("quality") - F.col("toxic"))
    g = d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.try_divide(F.col("m"), F.col("s") / F.sqrt(F.col("n").cast("double")))
    g = g.withColumn("t", t)
    return g.select("lang", "source", "n", F.round("t", 6).alias("t"), F.round(t_test_p(F.col("t"), F.col("n") - 1), 9).alias("p"))


#: With the angle a = atan(t / sqrt f): for odd f 2/pi (a + sin a (cos a + 2/3 cos^3 a + ...)), for even sin a (1 + 1/2 cos^2 a + ...).
PAIRED_SQL = """WITH g AS (
  SELECT lang, source, count(*) AS n, avg(quality - toxic) AS m, stddev_samp(quality - toxic) AS s FROM labels JOIN documents USING (doc_id) GROUP BY lang, source),
t AS (SELECT *, CASE WHEN s > 0 THEN m / (s / sqrt(n)) END AS t, n - 1 AS f FROM g),
a AS (SELECT *, atan(abs(t) / sqrt(f)) AS a FROM t),
k AS (
  SELECT *, CASE WHEN f % 2 = 1 THEN list_transform(range(1, (f - 1) // 2 + 1), lambda i: coalesce(list_product(list_transform(range(1, i), lambda j: 2.0 * j / (2 * j + 1))), 1) * pow(cos(a), 2 * i - 1))
       ELSE list_transform(range(0, f // 2), lambda i: coalesce(list_product(list_transform(range(1, i + 1), lambda j: (2.0 * j - 1) / (2 * j))), 1) * pow(cos(a), 2 * i)) END AS terms FROM a)
SELECT lang, source, n, round(t, 6) AS t,
  CASE WHEN t IS NOT NULL THEN round(1 - CASE WHEN f % 2 = 1 THEN 2 / pi() * (a + sin(a) * coalesce(list_sum(terms), 0)) ELSE sin(a) * list_sum(terms) END, 9) END AS p FROM k"""

QUERIES["paired_ttest_p"] = paired_ttest_p
ORACLES["paired_ttest_p"] = PAIRED_SQL
