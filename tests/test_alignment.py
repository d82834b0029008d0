"""Alignments and longest common subsequences in bulk against one cell at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from thicket.operators import alignment


def lcs(x, y):
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            d[i + 1][j + 1] = d[i][j] + 1 if x[i] == y[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def walk(cost, n, m, gap):
    d = np.zeros((n + 1, m + 1), np.int64)
    d[:, 0], d[0, :] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j - 1] + cost[i - 1, j - 1], d[i - 1, j] + gap, d[i, j - 1] + gap)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i, j] == d[i - 1, j] + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return d[n, m], out[::-1]


def test_lcs(spark):
    """Sizes around whole words of bits, long carries, few symbols, nulls."""
    rng = random.Random(1)
    size = lambda: rng.choice([0, 1, 3, 63, 64, 65, 127, 128, 129, 200])
    rows = [(i, [str(rng.randrange(1 + i % 5)) for _ in range(size())], [str(rng.randrange(1 + i % 5)) for _ in range(size())]) for i in range(120)]
    rows += [(200, None, ["a"]), (201, ["a"], None), (202, None, None), (203, ["a", None, "b"], [None, "b"])]
    got = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select("i", alignment.lcs_length("a", "b").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: lcs(a or [], b or []) for i, a, b in rows}


def test_least_costs(monkeypatch):
    """Few different costs, so that ties abound."""
    rng = np.random.default_rng(2)
    n, m = rng.integers(0, 12, 300), rng.integers(0, 15, 300)
    cost = rng.integers(0, 4, (300, 12, 15)) * 200_000
    total, pairs = alignment.least_costs(cost, n, m)
    assert [(t, p) for t, p in zip(total, pairs, strict=True)] == [walk(cost[k], n[k], m[k], alignment.GAP) for k in range(300)]


def test_aligned(spark, monkeypatch):
    """Whole texts of steps, in runs of few cells, with empty steps, repeated words and nulls."""
    rng = random.Random(3)
    steps = lambda: [" ".join(rng.choice("a b c d É".split()) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(9))]
    rows = [(i, steps(), steps()) for i in range(80)] + [(100, None, ["a"]), (101, None, None), (102, ["a", None], ["", "A a"])]

    def by_hand(x, y):
        sets = [[set((s or "").lower().split()) for s in side or []] for side in (x, y)]
        c = np.array([[1_000_000 - 1_000_000 * len(p & q) // len(p | q) if p | q else 0 for q in sets[1]] for p in sets[0]], np.int64).reshape(len(sets[0]), len(sets[1]))
        return walk(c, len(sets[0]), len(sets[1]), alignment.GAP)

    d = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").withColumn("al", alignment.aligned(F.col("a"), F.col("b")))
    for r in d.collect():
        assert (r["al"]["cost"], [tuple(p) for p in r["al"]["pairs"]]) == by_hand(r["a"], r["b"])


def test_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    steps = lambda: [[f"w{rng.randrange(50)}" for _ in range(5)] for _ in range(12)]
    a, b = (pa.array([steps() for _ in range(3000)], pa.list_(pa.list_(pa.string()))) for _ in range(2))
    tracemalloc.start()
    out = alignment._aligned.func(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3000 and peak < 16_000_000, peak
