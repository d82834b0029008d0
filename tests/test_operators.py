import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thicket.functions import extract, judge
from thicket.model import HashModel, filled, first_valid
from thicket.operators import alignment, evaluate, planning, search, similarity, trees, votes, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_votes_ties_and_nulls(spark):
    s = frame(spark, [(1, i, a) for i, a in enumerate(["5", "7", "7", None])] + [(2, i, a) for i, a in enumerate("abba")] + [(3, 0, None)], "g int, pos long, a string")
    got = {r["g"]: (r["answer"], r["votes"], r["total"]) for r in votes.majority(s, ["g"], "a", "pos").collect()}
    assert got == {1: ("7", 2, 4), 2: ("a", 2, 4), 3: (None, 1, 1)}
    got = {r["g"]: (r["answer"], r["votes"]) for r in votes.majority(s, ["g"], "a", "pos", drop_null=True).collect()}
    assert got == {1: ("7", 2), 2: ("a", 2), 3: (None, 0)}


def test_early_stop(spark):
    s = frame(spark, [(1, i, a) for i, a in enumerate("aaabbbbb")], "g int, pos long, a string")
    r = votes.early_stopped(s, ["g"], "a", "pos", 3, 0.9).first()
    assert (r["answer"], r["votes"], r["total"]) == ("a", 3, 3)


@pytest.fixture()
def model(spark):
    edges = frame(spark, [("r", "a", 1.0, False), ("r", "b", 2.0, False), ("r", "c", 0.5, True), ("a", "d", 9.0, True), ("a", "e", 1.0, True), ("b", "f", 3.0, True), ("b", "g", 3.0, True)], "parent_id string, node_id string, reward double, terminal boolean").withColumn("action", F.col("node_id")).withColumn("pos", F.lit(0))
    return frame(spark, [(1, "r")], "example_id int, node_id string"), lambda f: f.join(edges, "parent_id"), edges


def test_beam(model):
    roots, children, _ = model
    best = search.beam_search(roots, children, 2, 2).first()
    assert best["path_ids"] == ["r", "a", "d"] and best["score"] == 10
    assert search.greedy_search(roots, children, 2).first()["path_ids"] == ["r", "b", "f"]
    wide = search.beam_search(roots, children, 3, 2, return_beam=True).orderBy("rank").collect()
    assert [r["path_ids"][-1] for r in wide] == ["d", "f", "g", "c"]  # c ended early and left the beam
    kept = search.beam_search(roots, children, 3, 2, min_reward=1.5, return_beam=True).collect()
    assert {r["path_ids"][-1] for r in kept} == {"f", "g"}
    a, b = (search.beam_search(roots, children, 2, 2, strategy="sample", seed=3, return_beam=True).collect() for _ in range(2))
    assert sorted(a) == sorted(b)


def test_dfs(model):
    roots, children, _ = model
    found = search.dfs(roots, children, 2, 2).orderBy("rank").collect()
    assert [r["path_ids"][-1] for r in found] == ["d", "f", "g", "e"]


def test_mcts_trace(model, spark):
    nodes = pd.DataFrame([("r", None, 0.0, False), ("a", "r", 1.0, False), ("b", "r", 2.0, False), ("d", "a", 9.0, True), ("f", "b", 3.0, True)], columns=["node_id", "parent_id", "reward", "terminal"])
    visits, tree = search.search_tree(nodes, n_iters=3, w_exp=20.0)
    paths = visits.groupby("iter")["node_id"].agg(list).tolist()
    assert paths[0] == ["r", "b", "f"]  # the root has no visited child: simulation by highest reward
    assert ["r", "a", "d"] in paths
    assert visits[(visits.iter == 0) & (visits.pos == 0)]["ret"].item() == 5.0
    assert tree.set_index("node_id").loc["r", "n_visits"] == 3
    d = frame(spark, [(7, *r, i) for i, r in enumerate(nodes.itertuples(index=False, name=None))], "example_id int, node_id string, parent_id string, reward double, terminal boolean, pos int")
    v = search.mcts(d, n_iters=3, w_exp=20.0)
    assert search.output_path(v).first()["path"] == ["r", "a", "d"]
    assert v.count() == len(visits)


def test_mcts_strategies(spark):
    rows = [("r", None, 0.0, False), ("a", "r", 1.0, False), ("b", "r", 2.0, False), ("d", "a", 9.0, True), ("f", "b", 3.0, False)]
    d = frame(spark, [(7, *r, i) for i, r in enumerate(rows)], "example_id int, node_id string, parent_id string, reward double, terminal boolean, pos int")
    v = search.mcts(d, n_iters=2, uct_with_fast_reward=False)  # first r b f, which doesn't end at a terminal; then r a d
    path = lambda s: [r["path"] for r in search.output_path(v, strategy=s).collect()]
    assert path("max_iter") == path("last_terminal_iter") == path("max_reward") == path("last_iter") == [["r", "a", "d"]]
    assert path("follow_max") == [["r", "b", "f"]]
    none = search.mcts(d, n_iters=1, uct_with_fast_reward=False)
    assert search.output_path(none, strategy="max_iter").count() == 0 and search.output_path(none, strategy="last_iter").count() == 1
    last = search.snapshots(v).where("iter = 1 and node_id = 'r'").first()
    assert (last["n_visits"], last["q"]) == (2, 7.5)


def test_mcts_running_values_like_lists():
    """Running sums give what the lists of all returns would."""
    rng = np.random.default_rng(1)
    nodes = pd.DataFrame([("n0", None, 0.0, False)] + [(f"n{i}", f"n{(i - 1) // 3}", float(rng.integers(0, 9)), i > 60) for i in range(1, 120)], columns=["node_id", "parent_id", "reward", "terminal"])
    for q in ("mean", "max", "sum"):
        visits, tree = search.search_tree(nodes, n_iters=30, calc_q=q, w_exp=5.0)
        want = visits.groupby("node_id")["ret"].agg(["size", q])
        got = tree[tree.n_visits > 0].set_index("node_id")
        assert (want.iloc[:, 0] == got["n_visits"].loc[want.index]).all() and np.allclose(want.iloc[:, 1], got["q"].loc[want.index])


def test_dfs_caps(model, spark):
    roots, children, _ = model
    ids = lambda **o: [r["path_ids"][-1] for r in search.dfs(roots, children, 2, 2, **o).orderBy("rank").collect()]
    assert ids(total_states=3) == ["f", "g"]  # b, f, g come first
    assert ids(total_states=5) == ["d", "f", "g"] and ids(max_terminals=1) == ["f"]
    one = frame(spark, [("r", "a", 1.0, False), ("a", "d", 9.0, True)], "parent_id string, node_id string, reward double, terminal boolean").withColumn("action", F.col("node_id")).withColumn("pos", F.lit(0))
    found = search.dfs(roots, lambda f: f.join(one, "parent_id"), 2, 2, single_first=True).collect()
    assert [r["path_ids"] for r in found] == [["r", "a"]]


def test_beam_draws(model):
    roots, children, _ = model
    r = search.beam_search(roots, lambda f: children(f).withColumn("prob", F.lit(0.5)), 3, 1, strategy="sample", replace=True, unbiased=True, return_beam=True).collect()
    assert len(r) == 3 and {x["path_ids"][-1] for x in r} <= {"a", "b", "c"}


def test_closure_of_a_cycle(spark):
    loop = frame(spark, [(1, "a", "b"), (1, "b", "a")], "example_id int, node_id string, parent_id string")
    with pytest.raises(ValueError):
        trees.closure(loop)
    chain = frame(spark, [(1, str(i), str(i - 1) if i else None) for i in range(70)], "example_id int, node_id string, parent_id string")
    assert trees.closure(chain).count() == 70 * 71 // 2


def test_trees(spark):
    good = frame(spark, [(1, "r", None, 0.0), (1, "a", "r", 1.0), (1, "b", "r", 1.0), (1, "c", "a", None)], "example_id int, node_id string, parent_id string, q double")
    assert trees.valid(good).first()["is_tree"]
    assert not trees.valid(good.unionByName(good.where("node_id = 'a'"))).first()["is_tree"]
    assert not trees.valid(good.where("node_id <> 'a'")).first()["is_tree"]
    assert {(r["parent_id"], r["node_id"]) for r in trees.selected_edges(good, "q").collect()} == {("r", "a"), ("a", "c")}
    assert {(r["node_id"], r["ancestor_id"], r["distance"]) for r in trees.closure(good).collect() if r["node_id"] == "c"} == {("c", "c", 0), ("c", "a", 1), ("c", "r", 2)}


def test_guards(spark):
    s = frame(spark, [(1, i, a) for i, a in enumerate(["a"] * 6 + ["scroll", "scroll", "b"])], "g int, pos int, a string")
    r = windows.repeat_guard(s, ["g"], ["pos"], "a", ["scroll"]).first()
    assert (r["longest"], r["tripped"]) == (5, True)
    e = frame(spark, [(1, i, a) for i, a in enumerate("xeeex")], "g int, pos int, a string")
    assert windows.error_guard(e, ["g"], ["pos"], F.col("a") == "e").first()["longest"] == 3


def test_interleave(spark):
    d = frame(spark, [("a", i) for i in range(4)] + [("b", i) for i in range(2)], "s string, i int")
    got = [(r["s"], r["i"]) for r in windows.interleaved(d, "s", "i", {"a": 2, "b": 1}).orderBy("block", "s", "place").collect()]
    assert got == [("a", 0), ("a", 1), ("b", 0), ("a", 2), ("a", 3), ("b", 1)]


def test_similarity(spark):
    d = frame(spark, [(1, "a b c", "b c d d"), (2, "x", "y")], "id int, a string, b string")
    o = {r["id"]: r for r in similarity.token_overlap(d, ["id"], "a", "b", lambda c: F.split(c, " ")).collect()}
    assert o[1]["common"] == 2 and abs(o[1]["f1"] - 4 / 7) < 1e-9 and o[2]["f1"] == 0
    assert d.select(alignment.lcs_length(F.split("a", " "), F.split("b", " ")).alias("n")).first()["n"] == 2


def test_top_k_like_brute_force(spark):
    """Copies, a null, a zero and a short vector; blocks of queries; no join of all pairs of rows."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) + (i % 7 == 0) * rng.random() for _ in range(4)]) for i in range(1, 300)]
    rows = [r for r in rows if any(r[1])] + [(300, None), (301, [1.0, None, 0.0, 0.0])]
    d = frame(spark, rows, "id long, v array<double>").repartition(3)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for i, v in rows:
        if i % 20 == 0 and v and None not in v:
            near = [(round(sum(x * y for x, y in zip(v, u)) / (norm(v) * norm(u)), 6), j) for j, u in rows if j != i and u and None not in u]
            want |= {(i, j, s, r) for r, (s, j) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:5], 1)}
    q = d.where("id % 20 = 0")
    for limit in (4, 4000):
        out = similarity.top_k_cosine(q, d, "id", "v", 5, limit)
        assert {tuple(r) for r in out.where("similarity is not null").collect()} == want
    assert [r["item_id"] for r in out.where("query_id = 300").orderBy("rank").collect()] == sorted(i for i, _ in rows)[:5]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_answers_meet_their_leaves_once(spark):
    rows = [(1, "a", 5.0, 3.0, "y", 1.0), (1, "a", 5.0, 3.0, "y", 2.0), (1, "a", 5.0, 3.0, "n", 4.0), (1, "b", 5.0, 7.0, "n", None), (2, "c", 1.0, 1.0, "y", 1.0)]
    d = frame(spark, rows, "e int, o string, r_p double, r_o double, answer string, reward double").withColumn("p", F.lit("top"))
    got = {(r["e"], r["answer"]): r["weight"] for r in trees.answer_weights(d, "e", ["p", "o"], "answer", "reward", 2, "edge", 1_200_000).collect()}
    assert got == {(1, "y"): 11.0, (1, "n"): 19.0, (2, "y"): 3.0}
    one = trees.answer_weights(d, "e", ["o"], "answer", "reward", 2, "edge_inverse_depth", 1_200_000)
    assert {(r["e"], r["answer"]): r["weight"] for r in one.collect()} == {(1, "y"): 3.0, (1, "n"): 7.0, (2, "y"): 1.0}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "RepartitionByExpression" in plan and ", 3" in plan


def test_planning(spark):
    start = ["the red block is clear", "the red block is on the table", "the hand is empty", "the blue block is clear", "the blue block is on the table"]
    assert "pick up the red block" in planning.legal(start) and len(planning.legal(start)) == 2
    plan = ["pick up the red block", "stack the red block on top of the blue block"]
    d = frame(spark, [(start, plan, ["the red block is on top of the blue block"]), (start, plan[1:], []), (start, [], [])], "s array<string>, p array<string>, g array<string>")
    assert [r["v"] for r in d.select(planning.plan_valid(F.col("s"), F.col("p"), F.col("g")).alias("v")).collect()] == [True, False, True]


def test_self_consistency(spark):
    d = frame(spark, [(1, "q1", "7"), (2, "q2", "12")], "id int, prompt string, gold string")
    a, b = (evaluate.self_consistency(d, "id", "prompt", "gold", extract.final_number, judge.numeric_ladder, 9).orderBy("id").collect() for _ in range(2))
    assert a == b and len(a) == 2
    s = HashModel().generate(d.unionByName(d), "prompt", 3)
    assert s.count() == 12 and s.groupBy("prompt", "sample").agg(F.countDistinct("text").alias("n")).where("n > 1").isEmpty()
    assert first_valid(s, ["id"], ["sample"], F.lit(True), 2).count() == 4
    assert d.select(filled("Q: <q>!", q=F.col("prompt")).alias("t")).first()["t"] == "Q: q1!"


def test_accuracy_of_nothing(spark):
    r = evaluate.accuracy(frame(spark, [], "c boolean"), F.col("c")).first()
    assert r["n"] == 0 and r["accuracy"] is None
