"""The incomplete beta function and Student's p-values against closed forms, tabulated values and drawn samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from thicket.functions.statistics import incomplete_beta, log_gamma, t_test_p


def test_log_gamma(spark):
    xs = [0.5, 0.75, 1.0, 1.5, 2.0, 7.3, 50.0, 1234.5, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r["g"] - math.lgamma(r["x"])) <= 1e-12 * max(1.0, abs(math.lgamma(r["x"]))) for r in got)


def test_incomplete_beta(spark):
    """Whole a and b: the tail of a binomial."""
    rows = [(x, float(a), float(b)) for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0) for a in (1, 2, 9, 40) for b in (1, 3, 25)]
    got = spark.createDataFrame(rows, "x double, a double, b double").select("*", incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("i")).collect()
    for r in got:
        n = int(r["a"] + r["b"] - 1)
        want = math.fsum(math.comb(n, k) * r["x"] ** k * (1 - r["x"]) ** (n - k) for k in range(int(r["a"]), n + 1))
        assert abs(r["i"] - want) < 1e-12


def test_p_values(spark):
    """Two-sided 5 % and 1 % points of the usual tables, and what has no p-value."""
    table = [(1, 12.706204736, 0.05), (2, 4.302652730, 0.05), (5, 2.570581836, 0.05), (10, 2.228138852, 0.05), (30, 2.042272456, 0.05), (10, 3.169272673, 0.01), (120, 2.617421145, 0.01), (3, 0.0, 1.0)]
    d = spark.createDataFrame([(f, t, p) for f, t, p in table] + [(f, -t, p) for f, t, p in table], "f int, t double, p double")
    assert all(abs(r["got"] - r["p"]) < 1e-9 for r in d.select("p", t_test_p(F.col("t"), F.col("f")).alias("got")).collect())
    far = spark.createDataFrame([(100_000, 1.959988)], "f int, t double").select(t_test_p(F.col("t"), F.col("f")).alias("p")).first()["p"]
    assert abs(far - math.erfc(1.959988 / math.sqrt(2))) < 1e-5  # the normal's, nearly
    odd = spark.createDataFrame([(0, 1.0), (None, 1.0), (4, None)], "f int, t double").select(t_test_p(F.col("t"), F.col("f")).alias("p")).collect()
    assert [r["p"] for r in odd] == [None] * 3


def test_drawn(spark):
    """The share of t statistics of drawn samples beyond a value is its p-value, within sampling error."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200_000, 6))
    t = np.abs(x.mean(1) / (x.std(1, ddof=1) / math.sqrt(6)))
    for at in (0.5, 1.5, 3.0):
        p = spark.createDataFrame([(5, at)], "f int, t double").select(t_test_p(F.col("t"), F.col("f")).alias("p")).first()["p"]
        assert abs((t > at).mean() - p) < 0.004
