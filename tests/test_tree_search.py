"""Tree search as joins against the search of one example in memory."""

import random

import pytest

from thicket.operators import search, tree_search

NODE = "example_id long, node_id string, parent_id string, reward double, terminal boolean, pos long"


def trees(seed):
    """Random trees with ties in reward and place, nodes without children, examples of a root alone and one without a root."""
    rng = random.Random(seed)
    rows = [(100, "r", None, 0.0, False, 0), (101, "lost", "r", 1.0, True, 0)]
    for e in range(10):
        rows.append((e, "r", None, 0.0, False, 0))
        level, k = ["r"], 0
        for _ in range(4):
            below = []
            for p in level:
                for _ in range(rng.randrange(5)):
                    k += 1
                    t = rng.random() < 0.15
                    rows.append((e, f"n{k}", p, round(rng.choice([0.1, 0.2, 0.5, rng.random()]), 3), t, rng.randrange(3)))
                    below += [f"n{k}"] if not t or rng.random() < 0.3 else []
            level = below
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"n_iters": 7, "depth_limit": 3},
        {"n_iters": 5, "depth_limit": 5, "uct_with_fast_reward": False, "calc_q": "max", "w_exp": 0.5},
        {"n_iters": 4, "depth_limit": 1, "cum_reward": "mean", "calc_q": "sum"},
    ],
)
def test_like_one_by_one(spark, options):
    d = spark.createDataFrame(trees(options["n_iters"]), NODE)
    told = lambda v: sorted((r["example_id"], r["iter"], r["pos"], r["node_id"], round(r["ret"], 9), r["reward"], r["terminal"]) for r in v.collect())
    visits, tree = tree_search.search(d, **options)
    got = told(visits)
    assert got == told(search.mcts(d, **options))
    counts = {}
    for e, _, _, n, *_ in got:
        counts[e, n] = counts.get((e, n), 0) + 1
    assert {(r["example_id"], r["node_id"]): r["n"] for r in tree.collect()} == counts
    assert max(counts.values()) > 1


def test_wide_and_empty(spark):
    """A root of 20,000 children: the search is an aggregation, and no task gets them all in Python."""
    rows = [(1, "r", None, 0.0, False, 0)]
    wide = spark.createDataFrame(rows, NODE).unionByName(spark.range(20_000).selectExpr("1L example_id", "concat('c', id) node_id", "'r' parent_id", "double((id * 7919) % 20011) / 20011 reward", "true terminal", "id pos"))
    visits, _ = tree_search.search(wide, n_iters=3, depth_limit=2, w_exp=0.0)
    best = max(range(20_000), key=lambda i: (i * 7919) % 20011)
    assert [r["node_id"] for r in visits.where("pos = 1").orderBy("iter").collect()] == [f"c{best}"] * 3
    assert tree_search.search(spark.createDataFrame([], NODE), n_iters=2)[0].collect() == []
    with pytest.raises(ValueError):
        tree_search.search(wide, n_iters=0)


def test_adaptive_beam(spark):
    """Against one example at a time: budgets that rise, terminal nodes, dead ends, ties, examples that end at once."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows, kids = [], {}
    for e in range(8):
        level = ["r"]
        for depth in range(6):
            below = []
            for p in level[:6]:
                for c in range(rng.randrange(4)):
                    n = f"{p}.{c}"
                    row = (e, p, n, float(rng.randrange(4)), rng.random() < 0.1, rng.choice([None, 0, 0, 1, 2]))
                    rows.append(row)
                    kids.setdefault((e, p), []).append(row)
                    below.append(n)
            level = below

    def by_hand(e, width, depth, limit):
        beam, budget, done, at = [(("r",), 0.0)], min(depth, limit), [], 0
        while beam:
            at += 1
            grown = [((*path, n), s + r, t, more) for path, s in beam for _, _, n, r, t, more in kids.get((e, path[-1]), [])]
            grown = sorted(grown, key=lambda x: (-x[1], x[0]))[:width]
            budget = min(limit, budget + max([more or 0 for *_, more in grown], default=0))
            done += [(path, s, at) for path, s, t, _ in grown if t or at >= budget]
            beam = [(path, s) for path, s, t, _ in grown if not t and at < budget]
        return min(done, key=lambda x: (-x[1], x[0])) if done else None

    nodes = spark.createDataFrame(rows, "_e long, _p string, node_id string, reward double, terminal boolean, more int")

    def children(frontier):
        j = frontier.join(nodes, (F.col("example_id") == F.col("_e")) & (F.col("parent_id") == F.col("_p")))
        return j.drop("_e", "_p").withColumns({"action": F.lit("a"), "pos": F.lit(0)})

    roots = spark.createDataFrame([(e, "r") for e in range(9)], "example_id long, node_id string")
    for options in ((2, 2, 5), (3, 1, 6), (1, 9, 3)):
        got = {r["example_id"]: (tuple(r["path_ids"]), r["score"], r["depth"]) for r in search.adaptive_beam(roots, children, *options).collect()}
        want = {e: by_hand(e, *options) for e in range(9)}
        assert got == {e: w for e, w in want.items() if w}


@pytest.mark.parametrize("options", [{"n_iters": 4, "depth_limit": 3}, {"n_iters": 6, "depth_limit": 2, "uct_with_fast_reward": False, "w_exp": 0.7}])
def test_wide_like_one_by_one(spark, monkeypatch, options):
    """Nodes of more children than there are iterations, rows repeated: the same paths as one example at a time, by one written table, however many the iterations; what is gathered of an example is bounded."""
    import math

    rng = random.Random(3)
    rows = []
    for e in range(4):
        rows.append((e, "r", None, 0.0, False, 0))
        for c in range(40):
            rows.append((e, f"c{c}", "r", rng.choice([0.3, 0.6, rng.random()]), rng.random() < 0.2, rng.randrange(5)))
            for g in range(rng.randrange(12)):
                rows.append((e, f"c{c}.{g}", f"c{c}", rng.choice([0.3, rng.random()]), False, rng.randrange(3)))
                rows += [(e, f"c{c}.{g}.{h}", f"c{c}.{g}", rng.random(), True, h) for h in range(rng.randrange(3))]
    d = spark.createDataFrame(rows, NODE)
    made = []
    monkeypatch.setattr(tree_search, "written", lambda t, w=tree_search.written: made.append(t) or w(t))
    told = lambda v: sorted((r["example_id"], r["iter"], r["pos"], r["node_id"], round(r["ret"], 9)) for r in v.collect())
    want = told(search.mcts(d, **options))
    assert told(tree_search.search(d.unionByName(d), **options)[0]) == want
    assert len(made) == 1
    n, depth = options["n_iters"], options["depth_limit"]
    found = tree_search._reachable(d, "example_id", n, depth).selectExpr("aggregate(found, 0, (a, f) -> a + size(f.fan)) AS n").collect()
    assert len(found) == 4 and all(r["n"] < math.comb(n + depth, depth) for r in found)


def test_strategies_at_once(spark):
    """All strategies by one shuffle of the visits are what each is for itself."""
    visits, _ = tree_search.search(spark.createDataFrame(trees(11), NODE), n_iters=5, depth_limit=4)
    told = lambda d, s: sorted((r["example_id"], s or r["strategy"], r["iter"], tuple(r["path"])) for r in d.collect())
    at_once = search.output_paths(visits)
    assert told(at_once, None) == sorted(x for s in search.STRATEGIES for x in told(search.output_path(visits, strategy=s), s))
    plan = search.output_paths(visits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        search.output_path(visits, strategy="none")
