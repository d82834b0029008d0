"""Queries of this folder against their own SQL, with whole licences planted; flows and curves against brute force."""

import itertools
import os
import random

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from thicket.llm import hilbert_shards, licenses, mixing, registry


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name, tmp_path):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE TABLE {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    if name == "op10_license_scan":  # whole licences among the documents, as files hold them
        for i, (who, text) in enumerate(licenses.KNOWN):
            for k, t in enumerate((text, "Copyright (c) 2021 Some One\n\n" + text.upper(), text.replace(" ", "  "), text + " but not quite")):
                con.execute("INSERT INTO documents VALUES (?, ?, 'en', 'planted', ?)", [10**6 + 10 * i + k, t, len(t)])
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = registry.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = con.sql(registry.ORACLES[name])
    at = [got.columns.index(c) for c in cols]
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
    if name == "op10_license_scan":
        found = {r["doc_id"]: r["license_id"] for r in df.where("doc_id >= 1000000").collect()}
        assert all(found[10**6 + 10 * i + k] == who for i, (who, _) in enumerate(licenses.KNOWN) for k in (0, 1, 2))
        assert all(found[10**6 + 10 * i + 3] is None for i in range(len(licenses.KNOWN)))


def test_licences_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do as you like,\nbut say where it is from.")
    d = spark.createDataFrame([(1, "do as you LIKE but say: where it is from"), (2, "else")], "doc_id int, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(d, licenses.known_from(spark, str(tmp_path))).collect()} == {1: "Own-1.0", 2: None}


def test_flow_like_brute_force():
    """As much of the quotas as can be filled, at the least cost of repeats, with overlapping sources."""
    rng = random.Random(1)
    for _ in range(150):
        supply = [(m, rng.randrange(1, 4)) for m in rng.sample([("a",), ("b",), ("a", "b")], rng.randrange(1, 4))]
        quota = {"a": rng.randrange(7), "b": rng.randrange(7)}
        flow = mixing.min_cost_flow(supply, quota, 2)
        routes = [(i, s) for i, (m, _) in enumerate(supply) for s in m]

        def worth(x):
            used = [sum(v for (i, _), v in zip(routes, x) if i == k) for k in range(len(supply))]
            filled = {s: sum(v for (_, t), v in zip(routes, x) if t == s) for s in quota}
            if any(u > 2 * w for u, (_, w) in zip(used, supply)) or any(filled[s] > quota[s] for s in quota):
                return None
            return sum(x), -sum(max(0, u - w) for u, (_, w) in zip(used, supply))

        best = max(w for x in itertools.product(*[range(2 * supply[i][1] + 1) for i, _ in routes]) if (w := worth(x)))
        assert worth([flow[r] for r in routes]) == best


def test_hilbert_curve_fills_octants_one_after_the_other(spark):
    n = 8
    grid = spark.range(n**3).select((F.col("id") % n).alias("x"), (F.floor(F.col("id") / n) % n).alias("y"), F.floor(F.col("id") / n**2).alias("z"))
    got = grid.withColumn("h", hilbert_shards.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(n**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(got, got[1:]))
    for size in (2, 4):  # each aligned cube is one run of the curve
        for k in range(0, n**3, size**3):
            assert len({(r["x"] // size, r["y"] // size, r["z"] // size) for r in got[k : k + size**3]}) == 1
