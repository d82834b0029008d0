"""Probabilities of statistics, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos's coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function of x > 0.5, to about 1e-14 of its size."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method: a fold over its terms, two a step."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    start = 1 / tiny(1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d = 1 / tiny(1 + even * s["d"])
        c = tiny(1 + even / s["c"])
        d2, c2 = 1 / tiny(1 + odd * d), tiny(1 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

    first = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 300) -> Column:
    """The regularised incomplete beta function I_x(a, b) of a, b >= 0.5. The fraction converges in some sqrt(max(a, b)) terms; of x and 1 - x it is taken where it does so fast."""
    log_beta = log_gamma(a) + log_gamma(b) - log_gamma(a + b)
    front = F.exp(a * F.log(x) + b * F.log1p(-x) - log_beta)
    low = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    part = front * _fraction(p, q, y, terms) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(low, part).otherwise(1 - part))


def t_test_p(t: Column, freedom: Column, terms: int = 300) -> Column:
    """Two-sided p-value of Student's t with so many degrees of freedom (1 to some 10^5); null for null or none."""
    f = freedom.cast("double")
    return F.when(f >= 1, incomplete_beta(f / (f + t * t), f / 2, F.lit(0.5), terms))
