"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import WORD, cut, table, unpacked

WEIGHTS = (3, 1, 2)


def capped_targets(sizes: dict, total: Fraction, weights: Sequence[int] = WEIGHTS, most: int = 2) -> dict:
    """Exact targets: sources by code point (null last) share `total` by the repeating weights; none is above `most` times its size, and what is over goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, left = {}, Fraction(total), set(names)
    while left:
        share = rest / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in left}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            rest -= out[s]
        left -= over
    return out


def min_cost_flow(supply: list[tuple[tuple, int]], quota: dict, epochs: int) -> dict[tuple[int, object], int]:
    """Words routed from each pattern to each of its sources: (pattern number, source) -> words.

    A pattern's words can be taken up to `epochs` times; its e-th time costs e - 1 a word, so costs are convex and words are repeated only where no fresh words can fill a quota. As much of the quotas as can be is filled, at the least cost. Successive shortest paths with potentials; each path fills an arc, so the work depends on the number of patterns and sources alone.
    """
    sources = sorted(quota, key=lambda s: (s is None, s or ""))
    n, where = len(supply), {s: 1 + len(supply) + i for i, s in enumerate(sources)}
    sink = 1 + n + len(sources)
    to, cap, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    routes = {}
    for i, (members, words) in enumerate(supply):
        for e in range(epochs):
            arc(0, 1 + i, words, e)
        for s in members:
            routes[i, s] = arc(1 + i, where[s], epochs * words, 0)
    for s in sources:
        arc(where[s], sink, quota[s], 0)
    high = [0] * (sink + 1)
    while True:
        dist, by, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in out[a]:
                if cap[k] and (e := d + cost[k] + high[a] - high[to[k]]) < dist.get(to[k], 1 << 62):
                    dist[to[k]], by[to[k]] = e, k
                    heapq.heappush(heap, (e, to[k]))
        if sink not in dist:
            return {r: cap[k ^ 1] for r, k in routes.items()}
        far = max(dist.values())
        high = [h + dist.get(v, far) for v, h in enumerate(high)]
        path, v = [], sink
        while v:
            path.append(by[v])
            v = to[by[v] ^ 1]
        most = min(cap[k] for k in path)
        for k in path:
            cap[k] -= most
            cap[k ^ 1] += most


def mix(docs: DataFrame, members: Column, size: Column, quota: dict, seed: int = 0, epochs: int = 2, fills: int = 2) -> DataFrame:
    """Rows of docs with `_size` and `_times`: how often the mix takes each.

    members: array of the sources a row belongs to (an empty one: it is never taken). Rows are summed by membership pattern, the only thing that goes to the driver (one row a pattern); min_cost_flow gives each pattern its words. A pattern of S words that gets F takes every row F div S times, and of the rest rows in the order of a seeded hash while they fit; then, `fills` times, the largest row that fits into what is still missing. A pattern thus misses its words by less than its smallest row left. Reruns agree; rows equal in all columns are interchangeable. Rows without words are taken 0 times.

    The order is found without sorting a pattern in one task: words by pattern and hash bucket give the bucket that straddles the cut, and only that bucket is ranked.
    """
    spark = docs.sparkSession
    d = docs.select(members.alias("_members"), size.cast("long").alias("_size"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_size", "_times")]).alias("_row"))
    d = d.withColumn("_members", F.array_sort(F.array_distinct(F.transform("_members", lambda s: F.struct(s.isNull().alias("n"), s.alias("s"))))))
    d = d.withColumn("_p", F.to_json(F.struct("_members"))).withColumn("_h", F.shiftright("_h", 1).bitwiseAND((1 << 62) - 1))
    d = cut(d.withColumn("_uid", F.monotonically_increasing_id()))
    patterns = d.groupBy("_p").agg(F.first("_members").alias("m"), F.sum("_size").alias("s"), F.count("*").alias("n")).orderBy("_p").collect()
    flow = min_cost_flow([(tuple(x["s"] for x in r["m"]), r["s"]) for r in patterns], quota, epochs)
    got = [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(patterns))]
    plan = spark.createDataFrame([(r["_p"], g // r["s"] if r["s"] else 0, g % r["s"] if r["s"] else 0) for r, g in zip(patterns, got, strict=True)], "_p string, _full long, _rest long")
    plan = F.broadcast(plan) if len(patterns) <= 50_000 else plan
    bits = max(6, (max((r["n"] for r in patterns), default=1) // 1000).bit_length())  # about 1000 rows a bucket
    d = d.withColumn("_b", F.shiftright("_h", 62 - bits))
    w = Window.partitionBy("_p", "_hi").orderBy("_b")
    # running sums over the buckets in two steps, so that no pattern's buckets are all in one window
    cells = cut(d.groupBy("_p", "_b").agg(F.sum("_size").alias("s")).withColumn("_hi", F.shiftright("_b", bits // 2)))
    tops = cells.groupBy("_p", "_hi").agg(F.sum("s").alias("t"))
    tops = tops.withColumn("_before", F.sum("t").over(Window.partitionBy("_p").orderBy("_hi")) - F.col("t")).drop("t")
    cells = cells.withColumn("_run", F.sum("s").over(w)).join(tops, ["_p", "_hi"]).join(plan, "_p")
    cells = cells.select("_p", "_b", "_rest", "_full", (F.col("_run") + F.col("_before")).alias("_upto"), (F.col("_run") + F.col("_before") - F.col("s")).alias("_from"))
    cells = cut(cells)
    edge = cells.where("_from < _rest and _upto > _rest").select("_p", "_b", "_from")
    ranked = d.join(F.broadcast(edge) if len(patterns) <= 50_000 else edge, ["_p", "_b"]).withColumn("_run", F.sum("_size").over(Window.partitionBy("_p").orderBy("_h", "_uid").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from"))
    last = ranked.join(plan, "_p").where("_run <= _rest").groupBy("_p").agg(F.max(F.struct("_h", "_uid")).alias("_last"), F.max("_run").alias("_sum"))
    cuts = edge.join(last, "_p", "left").join(plan, "_p").select("_p", F.coalesce(F.col("_last"), F.struct(F.shiftleft(F.col("_b"), 62 - bits).alias("_h"), F.lit(-1).cast("long").alias("_uid"))).alias("_last"), (F.col("_rest") - F.coalesce("_sum", "_from")).alias("_gap"))
    exact = cells.where("_upto = _rest").groupBy("_p").agg(F.max("_b").alias("_b")).select("_p", F.struct(F.shiftleft(F.col("_b") + 1, 62 - bits).alias("_h"), F.lit(-1).cast("long").alias("_uid")).alias("_last"), F.lit(0).cast("long").alias("_gap"))
    end = cut(cuts.unionByName(exact))
    bound = (lambda x: F.broadcast(x)) if len(patterns) <= 50_000 else (lambda x: x)
    d = d.join(plan, "_p").join(bound(end), "_p", "left")
    taken = F.coalesce(F.struct("_h", "_uid") <= F.col("_last"), F.lit(False)) & (F.col("_rest") > 0)
    d = d.withColumn("_more", taken.cast("int"))
    picked = None
    for _ in range(fills):  # the largest row that fits, one a pattern
        open_ = d if picked is None else d.join(bound(picked.select(F.col("_p"), F.col("_uid"), F.lit(True).alias("_x"))), ["_p", "_uid"], "left_anti")
        gap = end.select("_p", F.col("_gap").alias("_g")) if picked is None else end.join(picked.groupBy("_p").agg(F.sum("_size").alias("_f")), "_p", "left").select("_p", (F.col("_gap") - F.coalesce("_f", F.lit(0))).alias("_g"))
        one = open_.where("_more = 0 and _size > 0").join(bound(gap), "_p").where("_size <= _g").groupBy("_p").agg(F.max(F.struct("_size", "_h", "_uid")).alias("x")).select("_p", "x._uid", "x._size")
        one = cut(one)
        picked = one if picked is None else cut(picked.unionByName(one))
    if picked is not None:
        d = d.join(bound(picked.select("_p", "_uid", F.lit(1).alias("_fill"))), ["_p", "_uid"], "left")
    times = F.when(F.col("_size") > 0, F.col("_full") + F.col("_more") + F.coalesce("_fill", F.lit(0))).otherwise(0)
    return unpacked(d, "_size", times.cast("long").alias("_times"))


def shares(docs: DataFrame, size: Column, percent: int = 150, weights: Sequence[int] = WEIGHTS, most: int = 2) -> tuple[dict, dict]:
    """(size, exact target) of every source of docs; one row a source goes to the driver."""
    sizes = {r["source"]: r["s"] for r in docs.groupBy("source").agg(F.sum(size).alias("s")).collect()}
    return sizes, capped_targets(sizes, Fraction(percent * sum(sizes.values()), 100), weights, most)


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents: each row as often as mix() takes it."""
    d = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")))
    sizes, targets = shares(d, F.col("size"))
    m = mix(d, F.array("source"), F.col("size"), {s: int(t) for s, t in targets.items()})
    t = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "s string, source_size long, target double")
    t = F.broadcast(t) if len(sizes) <= 50_000 else t
    return m.join(t, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", (F.col("_times") * F.col("size")).alias("taken"), "source")
