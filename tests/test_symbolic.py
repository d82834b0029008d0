"""Symbolic equality and normal forms of mathematics answers on known pairs, and on random expressions expanded by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thicket.functions import judge, maths
from thicket.functions.symbolic import equal

SAME = [
    (r"\frac{2}{\sqrt{2}}", r"\sqrt{2}"), ("(x+1)^2", "x^2+2x+1"), (r"\sqrt{8}", r"2\sqrt2"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"\sqrt{3+2\sqrt{2}}", r"1+\sqrt{2}"),
    ("2^{x+1}", "2*2^x"), (r"\frac12", "0.5"), (r"\sqrt[3]{54}", r"3\sqrt[3]{2}"), ("x=5", "5=x"), ("y=2x+1", "2x-y+1=0"), (r"\pi r^2", r"r \cdot r\pi"),
    (r"\frac{1}{1+\sqrt2}", r"\sqrt2-1"), (r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}"), (r"\sin(x+y)", r"\sin(y+x)"), ("-x^2", "-(x^2)"), ("x^{-2}", r"\frac{1}{x^2}"),
    (r"\sqrt{-4}", r"2\sqrt{-1}"), ("x^{1/2}", r"\sqrt{x}"), ("e^{2x}", "(e^x)^2"), (r"2\sqrt{37}", r"\sqrt{148}"), (r"\left(\frac{1}{2}\right)^{3}", r"\frac18"),
    ("x_1+x_2", "x_{2}+x_{1}"), (r"\sin^2 x+\cos x", r"(\sin x)^2+\cos x"), (r"|x|\cdot|x|", "x^2"), (r"4\sqrt[4]{9}", r"4\sqrt3"),
]
OTHER = [
    ("x+1", "x+2"), (r"\sqrt2", "1.41421356"), ("x^2", "x"), (r"\sqrt{5}+\sqrt{2}", r"\sqrt7"), ("(x+y)^2", "x^2+y^2"), ("x=5", "x=6"), (r"\pi", "3.14159"), (r"\sin x", r"\cos x"),
    ("2^x", "x^2"), ("-1", "1"), (r"-\sqrt2", r"\sqrt2"), ("x", "y"), ("", ""), ("(1+2", "3"), ("3!", "6"), ("x=1=1", "x=1"), (None, "1"), ("1/0", "2/0"), ("(" * 200 + "1" + ")" * 200, "1"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert equal(a, b) and equal(b, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not equal(a, b)


def test_random_polynomials():
    """Products against their expansions by hand, right and with one coefficient off; none is decided wrongly."""
    rng = random.Random(1)
    for _ in range(400):
        factors = [Counter({(rng.randrange(3), rng.randrange(3)): rng.randrange(-9, 10) for _ in range(3)}) for _ in range(rng.randrange(1, 4))]
        total = Counter({(0, 0): 1})
        for f in factors:
            out = Counter()
            for (a, b), c in total.items():
                for (p, q), d in f.items():
                    out[a + p, b + q] += c * d
            total = out
        show = lambda poly: "+".join(f"({c})x^{{{a}}}y^{{{b}}}" for (a, b), c in poly.items()) or "0"
        product = "".join(f"({show(f)})" for f in factors)
        assert equal(product, show(total))
        total[rng.choice(list(total))] += rng.choice((-1, 1))
        assert not equal(product, show(total))


def test_random_surds():
    """(a + b sqrt c) (d + e sqrt c) over (f + g sqrt c), with the denominator made rational by hand."""
    rng = random.Random(2)
    for _ in range(200):
        c = rng.choice([2, 3, 5, 6, 7, 10, 14, 17, 37, 101])
        a, b, d, e, f, g = (rng.randrange(1, 9) for _ in range(6))
        p, q, n = a * d + b * e * c, a * e + b * d, f * f - g * g * c
        x, y = p * f - q * g * c, q * f - p * g
        left = rf"\frac{{({a}+{b}\sqrt{{{c}}})({d}+{e}\sqrt{{{c}}})}}{{{f}+{g}\sqrt{{{c}}}}}"
        assert equal(left, rf"\frac{{{x}+({y})\sqrt{{{c}}}}}{{{n}}}")
        assert not equal(left, rf"\frac{{{x + 1}+({y})\sqrt{{{c}}}}}{{{n}}}")


FORMS = [
    ("12 km/h", "12"), ("5 square feet", "5"), ("3.50 dollars", "3.50"), ("7 red apples", "7"), ("4 soldiers", "4"), ("2 and 3", "23"), ("90^{\\circ}", "90"), ("$18$ inches", "18"), ("10 m/s^2", "10"),
    ("6 cubic centimeters", "6"), ("\\frac12 kg", "\\frac{1}{2}"), ("x", "x"), ("m", "m"), ("3m", "3"), ("twenty-one", "21"), ("2 kilometers per hour", "2"), (None, None), ("", ""),
]


def test_forms(spark):
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(FORMS)], "i int, a string").select("i", maths.normal_form(F.col("a")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [f for _, f in FORMS]


def test_maths_equal(spark):
    rows = [("(1, \\frac{1}{2})", "(1,1.5)", False), ("(1, \\frac{1}{2})", "(1,0.5)", True), ("x^2+2x+1", "(x+1)^2", True), ("4 km", "4", True), ("\\begin{pmatrix}1 & 2\\\\3&1.5\\end{pmatrix}", "\\begin{bmatrix}1&2\\\\3&1.5\\end{bmatrix}", True), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1&3\\end{pmatrix}", False), (None, "1", False), ("1", None, False)]
    d = spark.createDataFrame(rows, "a string, g string, sure boolean")
    got = d.select("sure", judge.maths_equal(F.col("a"), F.col("g"), symbolic=True).alias("e")).collect()
    assert [r["e"] for r in got] == [r["sure"] for r in got]
