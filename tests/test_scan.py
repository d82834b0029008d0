"""Running sums against a loop."""

import random

from pyspark.sql import functions as F

from thicket.operators.scan import scan


def test_scan(spark):
    """One group with most rows, a null group, nulls among values and at a group's start, negative and equal values, extra columns."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, -1, 0, 2, 5]), "x") for i in rng.sample(range(3000), 900)] + [("late", 5, None, "x"), ("late", 6, 4, "x")]
    d = spark.createDataFrame(rows, "g string, at int, v int, _n string").repartition(7)
    for by in (["g"], []):
        want, sums = {}, {}
        for g, at, v, _ in sorted(rows, key=lambda r: (r[1] if not by else 0, str(r[0]), r[1])):
            k = g if by else 0
            n, s = sums.get(k, (0, None))
            sums[k] = (n + 1, s if v is None else (s or 0) + v)
            want[g, at] = sums[k]
        if not by:  # equal places of the two groups go in any one order
            want = {k: w for k, w in want.items() if k[1] not in (5, 6)}
        got = {(r["g"], r["at"]): (r["n"], r["s"]) for r in scan(d, by, ["at"], {"n": F.lit(1).cast("long"), "s": F.col("v").cast("long")}).collect()}
        assert {k: got[k] for k in want} == want and len(got) == len({r[:2] for r in rows})
    assert scan(d.where("false"), ["g"], ["at"], {"n": F.lit(1)}).collect() == []
