"""Tree search over all examples at once: each level is one job that expands, scores and prunes every example's frontier.

A model is a function children(frontier) -> DataFrame: the frontier's rows with their columns and, for each child, node_id, action, reward (double), terminal (boolean) and pos (order among its siblings). Roots are (example_id, node_id) rows and whatever columns children() needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.score import aggregated, softmax, unbiased_softmax
from thicket.storage import written

Model = Callable[[DataFrame], DataFrame]
_NEW = ("node_id", "action", "reward", "terminal", "pos")


def _start(roots: DataFrame) -> DataFrame:
    return roots.withColumn("depth", F.lit(0)).withColumn("path_ids", F.array(F.col("node_id").cast("string"))).withColumn("path_rewards", F.array().cast("array<double>")).withColumn("terminal", F.lit(False))


def _grown(frontier: DataFrame, children: Model) -> DataFrame:
    base = frontier.drop("terminal").withColumnRenamed("node_id", "parent_id")
    c = children(base)
    return c.withColumn("depth", F.col("depth") + 1).withColumn("path_ids", F.concat("path_ids", F.array(F.col("node_id").cast("string")))).withColumn("path_rewards", F.concat("path_rewards", F.array(F.col("reward").cast("double")))).drop("parent_id")


def _redrawn(grown: DataFrame, share: Column, beam_size: int, seed: int) -> DataFrame:
    """beam_size draws with replacement for each example, in proportion to share; a row drawn k times comes k times."""
    w = Window.partitionBy("example_id").orderBy("path_ids")
    mass = F.sum("_s").over(Window.partitionBy("example_id"))
    run = grown.withColumn("_s", share).withColumn("_hi", F.sum("_s").over(w) / mass).withColumn("_lo", F.col("_hi") - F.col("_s") / mass)
    n = F.least(F.lit(beam_size), F.count("*").over(Window.partitionBy("example_id")))
    u = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: (F.pmod(F.xxhash64(F.lit(seed), "example_id", k), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    hits = run.withColumn("_u", F.filter(u, lambda x: (x > F.col("_lo")) & (x <= F.col("_hi"))))
    return hits.withColumn("_u", F.explode("_u")).drop("_s", "_hi", "_lo", "_u")


def _draw(p: Column, seed: int) -> Column:
    """Key of a draw without replacement in proportion to p: the largest keys win. Seeded, so that reruns agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "example_id", F.array_join("path_ids", "/")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return F.ln(F.greatest(p, F.lit(1e-12))) - F.ln(-F.ln(u))


def beam_search(roots: DataFrame, children: Model, beam_size: int, max_depth: int, aggregator: str = "sum", strategy: str = "argmax", temperature: float = 1.0, temperature_decay: float = 1.0, min_reward: float | None = None, dedup: bool = False, early_terminate: bool = True, return_beam: bool = False, seed: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None, replace: bool = False, unbiased: bool = False) -> DataFrame:
    """(example_id, node_id, depth, path_ids, path_rewards, score, rank): the best finished path of each example, or the whole last beam.

    strategy: argmax, or sample (drawn in proportion to the softmax of the score at the level's temperature; with replacement if asked for; unbiased: the children's column `prob`, with which they were proposed, is divided out). min_reward: paths below are rejected; when sampling, the bound is no higher than just below the best. dedup: of a level's equal actions in an example the best stays. With early_terminate terminal nodes leave the beam; at max_depth all are terminal. Ties go by path. keep: called on each level, to cut its lineage.
    """
    if strategy not in ("argmax", "sample") or (strategy == "sample" and 0 < temperature < 1e-4):
        strategy = "argmax"
    return_beam = return_beam or not early_terminate
    frontier, done = _start(roots), None
    for level in range(max_depth):
        grown = _grown(frontier, children).withColumn("score", aggregated(F.col("path_rewards"), aggregator))
        ex = Window.partitionBy("example_id")
        if min_reward is not None:
            bound = F.lit(min_reward) if strategy == "argmax" else F.least(F.lit(min_reward), F.max("score").over(ex) - 1e-5)
            grown = grown.withColumn("_bound", bound).where(F.col("score") >= F.col("_bound")).drop("_bound")
        if dedup:
            w = Window.partitionBy("example_id", "action").orderBy(F.desc("score"), "path_ids")
            grown = grown.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        if strategy == "sample":
            t = temperature * temperature_decay**level
            share = unbiased_softmax(F.col("score"), F.col("prob"), ex, t) if unbiased else softmax(F.col("score"), ex, t)
            if replace:
                grown = _redrawn(grown, share, beam_size, seed + level)
            grown = grown.withColumn("_key", F.lit(0.0) if replace else _draw(share, seed + level))
            order = [F.desc("_key")]
        else:
            order = [F.desc("score")]
        w = ex.orderBy(*order, "path_ids")
        grown = grown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam_size).drop("_key")
        grown = keep(grown) if keep else grown
        last = level == max_depth - 1
        ended = grown if last else grown.where("terminal") if early_terminate else None
        if ended is not None:
            ended = ended.select("example_id", "node_id", "depth", "path_ids", "path_rewards", "score")
            done = ended if done is None else done.unionByName(ended)
        frontier = (grown.where("not terminal") if early_terminate else grown).drop("score", "rank", *(c for c in _NEW if c not in ("node_id", "terminal")))
    w = Window.partitionBy("example_id").orderBy(F.desc("score"), "path_ids")
    ranked = done.withColumn("rank", F.row_number().over(w))
    return ranked if return_beam else ranked.where("rank = 1")


def adaptive_beam(roots: DataFrame, children: Model, beam_size: int, depth: int, limit: int, aggregator: str = "sum") -> DataFrame:
    """(example_id, node_id, depth, budget, path_ids, path_rewards, score): the best finished path of each example, by a beam whose depth the model may raise.

    Each example has a budget of `depth` levels. children() also gives `more`, levels that a child asks for beyond that (null: none); what the kept child that asks for most gets is added to its example's budget, to `limit` at most. Nodes end as terminal ones or when their example's budget is used up, and leave the beam; those without children leave it without an end. Levels are made while any example has a beam: each is written, so lineage doesn't grow. Ties go by path.
    """
    frontier, done = _start(roots).withColumn("budget", F.lit(min(depth, limit))), None
    while True:
        ex = Window.partitionBy("example_id")
        grown = _grown(frontier, children).withColumn("score", aggregated(F.col("path_rewards"), aggregator))
        grown = grown.withColumn("_r", F.row_number().over(ex.orderBy(F.desc("score"), "path_ids"))).where(F.col("_r") <= beam_size).drop("_r")
        asked = F.coalesce(F.max("more").over(ex), F.lit(0))
        grown = grown.withColumn("budget", F.least(F.lit(limit), F.col("budget") + F.greatest(asked, F.lit(0))).cast("int"))
        grown = written(grown.drop("action", "reward", "pos", "more"))
        over = F.col("terminal") | (F.col("depth") >= F.col("budget"))
        ended = grown.where(over).select("example_id", "node_id", "depth", "budget", "path_ids", "path_rewards", "score")
        done = ended if done is None else done.unionByName(ended)
        frontier = grown.where(~over).drop("score")
        if frontier.isEmpty():
            break
    best = Window.partitionBy("example_id").orderBy(F.desc("score"), "path_ids")
    return done.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def greedy_search(roots: DataFrame, children: Model, max_depth: int, **options) -> DataFrame:
    """Beam search of width 1."""
    return beam_search(roots, children, 1, max_depth, **options)


def dfs(roots: DataFrame, children: Model, max_per_state: int, depth: int, prior: bool = True, total_states: int | None = None, max_terminals: int | None = None, single_first: bool = False) -> DataFrame:
    """(example_id, node_id, depth, path_ids, path_rewards, score, rank): terminals of the depth-bounded search, best path sum first.

    Each state keeps its max_per_state children of highest reward (prior), else the first ones. The search goes level by level over all examples; what depth-first order would have reached within its caps is cut afterwards by the pre-order of the nodes: the first total_states of an example, and of the terminals among these the first max_terminals. single_first: a root with one child answers with that child.
    """
    frontier, levels = _start(roots).withColumn("_order", F.array().cast("array<int>")), []
    cols = ["example_id", "node_id", "depth", "path_ids", "path_rewards", "_order"]
    for level in range(depth):
        grown = _grown(frontier, children)
        up = F.slice("path_ids", 1, level + 1)
        w = Window.partitionBy("example_id", up).orderBy(*([F.desc("reward")] if prior else []), "pos", "node_id")
        grown = grown.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_per_state)
        grown = grown.withColumn("_order", F.array_append("_order", F.col("_r"))).drop("_r")
        ends = F.lit(True) if level == depth - 1 else F.col("terminal")
        if single_first and level == 0:
            ends = ends | (F.count("*").over(Window.partitionBy("example_id", up)) == 1)
        grown = grown.withColumn("terminal", ends)
        levels.append(grown.select(*cols, "terminal"))
        frontier = grown.where("not terminal").drop(*(c for c in _NEW if c not in ("node_id", "terminal")))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    preorder = Window.partitionBy("example_id").orderBy("_order")
    if total_states is not None:
        nodes = nodes.withColumn("_n", F.row_number().over(preorder)).where(F.col("_n") <= total_states)
    done = nodes.where("terminal")
    if max_terminals is not None:
        done = done.withColumn("_n", F.row_number().over(preorder)).where(F.col("_n") <= max_terminals)
    done = done.select("example_id", "node_id", "depth", "path_ids", "path_rewards", aggregated(F.col("path_rewards"), "sum").alias("score"))
    return done.withColumn("rank", F.row_number().over(Window.partitionBy("example_id").orderBy(F.desc("score"), "path_ids")))


def random_shooting(steps: DataFrame, example: str, order: list[str], reward: str, n_shoot: int, max_depth: int, pick: Callable[[Column, Column], Column] | None = None, seed: int = 0) -> DataFrame:
    """(example, shot, total): the best of n_shoot random walks of max_depth steps over each example's numbered steps, the first on ties. pick(shot, depth): the step's number, else drawn by seeded hash. A walk's place is found by one join on (example, number)."""
    numbered = steps.withColumn("_i", F.row_number().over(Window.partitionBy(example).orderBy(*order)) - 1)
    n = numbered.groupBy(example).agg(F.count("*").alias("_n"))
    walks = n.select(example, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_shoot - 1))).alias("shot")).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("_d"))
    drawn = pick(F.col("shot"), F.col("_d")) if pick else F.xxhash64(F.lit(seed), example, "shot", "_d")
    walks = walks.withColumn("_i", F.pmod(drawn, F.col("_n")).cast("int"))
    total = walks.join(numbered.select(example, "_i", reward), [example, "_i"]).groupBy(example, "shot").agg(F.round(F.sum(reward), 4).alias("total"))
    w = Window.partitionBy(example).orderBy(F.desc("total"), "shot")
    return total.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


VISIT = "iter long, pos long, node_id {0}, ret double, reward double, terminal boolean, sibling long"


def search_tree(
    nodes: pd.DataFrame, n_iters: int = 10, w_exp: float = 1.0, depth_limit: int = 5, cum_reward: str = "sum", calc_q: str = "mean", simulate: str = "max", seed: int = 0, uct_with_fast_reward: bool = True
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Monte-Carlo tree search over one example's table-driven model: nodes (node_id, parent_id, reward, terminal), root with null parent, siblings in row order.

    Returns (visits, tree): visits (iter, pos, node_id, ret, reward, terminal, sibling), the back-propagated returns of each iteration's path; tree (node_id, n_visits, q).

    Selection goes down expanded nodes by the highest q + w_exp * sqrt(ln N / max(1, n)), unvisited children counting their reward as q; without uct_with_fast_reward the unvisited child of highest reward comes first while there is one. What it ends at is expanded; simulation goes on by the highest reward, or a seeded draw (sample: in proportion, random: even), and expands what it visits. Terminal nodes and those at depth_limit have no children. Ties go to the first child.
    """
    rng = np.random.default_rng(seed)
    ids = list(nodes["node_id"])
    at = {n: i for i, n in enumerate(ids)}
    reward, terminal = nodes["reward"].astype(float).tolist(), nodes["terminal"].astype(bool).tolist()
    below: list[list[int]] = [[] for _ in ids]
    sibling, root = [0] * len(ids), None
    for i, p in enumerate(nodes["parent_id"]):
        if pd.isna(p):
            root = i if root is None else root
        elif p in at:
            sibling[i] = len(below[at[p]])
            below[at[p]].append(i)
    visits, total, most = [0] * len(ids), [0.0] * len(ids), [-math.inf] * len(ids)
    expanded = [False] * len(ids)

    def q(i: int) -> float:
        return reward[i] if not visits[i] else most[i] if calc_q == "max" else total[i] if calc_q == "sum" else total[i] / visits[i]

    out: tuple[list, ...] = ([], [], [], [])
    for it in range(n_iters if root is not None else 0):
        path = [root]
        while expanded[path[-1]] and below[path[-1]] and len(path) <= depth_limit:
            kids = below[path[-1]]
            fresh = [] if uct_with_fast_reward else [c for c in kids if not visits[c]]
            if fresh:
                path.append(max(fresh, key=reward.__getitem__))
            else:
                log = math.log(max(1, visits[path[-1]]))
                path.append(max(kids, key=lambda c: q(c) + w_exp * math.sqrt(log / max(1, visits[c]))))
        while not terminal[path[-1]] and len(path) <= depth_limit:
            expanded[path[-1]] = True
            kids = below[path[-1]]
            if not kids:
                break
            if simulate == "max":
                path.append(max(kids, key=reward.__getitem__))
            else:
                w = np.array([max(reward[c], 0.0) for c in kids]) if simulate == "sample" else np.ones(len(kids))
                path.append(kids[int(rng.choice(len(kids), p=w / w.sum() if w.sum() else None))])
        run = 0.0
        for pos in range(len(path) - 1, -1, -1):
            i = path[pos]
            run += reward[i]
            ret = run if cum_reward == "sum" else run / (len(path) - pos)
            visits[i] += 1
            total[i] += ret
            most[i] = max(most[i], ret)
            for column, v in zip(out, (it, pos, i, ret), strict=True):
                column.append(v)
    i = np.array(out[2], int)
    told = pd.DataFrame({"iter": out[0], "pos": out[1], "node_id": [ids[k] for k in i], "ret": out[3], "reward": np.array(reward)[i], "terminal": np.array(terminal, bool)[i], "sibling": np.array(sibling, int)[i]})
    told = told.sort_values(["iter", "pos"], kind="stable", ignore_index=True)
    return told, pd.DataFrame([(n, visits[k], q(k)) for k, n in enumerate(ids)], columns=["node_id", "n_visits", "q"])


def mcts(nodes: DataFrame, example: str = "example_id", **options) -> DataFrame:
    """(example, iter, pos, node_id, ret, reward, terminal, sibling): search_tree() of every example; searches are sequential inside an example and run in parallel across examples. nodes: (example, node_id, parent_id, reward, terminal, pos)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        visits, _ = search_tree(pdf.sort_values(["pos", "node_id"]), **options)
        if visits.empty:  # an example without a root
            return pd.DataFrame()
        visits.insert(0, example, key[0])
        return visits

    kinds = dict(nodes.dtypes)
    return nodes.groupBy(example).applyInPandas(one, f"{example} {kinds[example]}, " + VISIT.format(kinds["node_id"]))


def snapshots(visits: DataFrame, example: str = "example_id") -> DataFrame:
    """(example, iter, node_id, n_visits, q): the visited tree as it is after each iteration, q the mean of its returns so far."""
    iters = visits.select(example, F.col("iter").alias("_k")).distinct()
    upto = iters.join(visits, example).where(F.col("iter") <= F.col("_k"))
    return upto.groupBy(example, F.col("_k").alias("iter"), "node_id").agg(F.count("*").alias("n_visits"), F.avg("ret").alias("q"))


STRATEGIES = ("max_iter", "max_reward", "last_iter", "last_terminal_iter", "follow_max", "max_visit")


def output_path(visits: DataFrame, example: str = "example_id", strategy: str = "max_iter", max_depth: int = 64) -> DataFrame:
    """(example, iter, path): what a search answers with by one strategy of output_paths()."""
    return output_paths(visits, [strategy], example, max_depth).drop("strategy")


def output_paths(visits: DataFrame, strategies: list[str] | tuple[str, ...] = STRATEGIES, example: str = "example_id", max_depth: int = 64) -> DataFrame:
    """(example, strategy, iter, path): what a search answers with by each strategy; iter: the first iteration that goes that way.

    max_iter: of the iterations that end at a terminal that of highest return, the first on ties. max_reward: of the visited terminals' paths that of highest reward sum without the root, the first in pre-order on ties. last_iter; last_terminal_iter: the last iteration (that ends at a terminal). follow_max: from the root the visited child of highest reward, the first on ties, down to a terminal or a node without visited children. max_visit: the iteration whose nodes are visited most. Examples without such an iteration have no row.

    Visits are shuffled once, by example, for all strategies together.
    """
    for s in strategies:
        if s not in STRATEGIES:
            raise ValueError(f"unknown strategy {s}")
    mine = visits.repartition(example).withColumn("_n", F.count("*").over(Window.partitionBy(example, "node_id")))
    paths = mine.groupBy(example, "iter").agg(
        F.sort_array(F.collect_list(F.struct("pos", "node_id", "reward", "sibling"))).alias("p"), F.max_by("terminal", "pos").alias("ended"), F.max_by("ret", -F.col("pos")).alias("ret"), F.sum("_n").alias("met")
    )
    paths = paths.select(example, "iter", "ended", "ret", "met", F.transform("p", lambda x: x["node_id"]).alias("path"), F.transform("p", lambda x: x["reward"]).alias("rewards"), F.transform("p", lambda x: x["sibling"]).alias("siblings"))
    below = aggregated(F.slice("rewards", 2, F.greatest(F.size("rewards") - 1, F.lit(0))), "sum")
    # arrays go by their first difference and the longer one is the greater: the greatest is where the walk by best children ends
    walk = F.slice(F.transform("rewards", lambda r, d: F.struct(r.alias("r"), (-F.get("siblings", d)).alias("s"))), 2, max_depth - 1)
    paths = paths.select(example, F.struct("iter", "ended", "ret", "met", "path", "siblings", below.alias("below"), walk.alias("walk"), F.size("path").alias("size")).alias("p"))
    per = paths.groupBy(example).agg(F.collect_list("p").alias("p"))
    all_, ended = F.col("p"), F.filter("p", lambda x: x["ended"])
    most = lambda p, field: F.get(F.transform(F.array(F.array_max(F.transform(p, lambda x: x[field]))), lambda m: F.filter(p, lambda x: x[field].eqNullSafe(m))), 0)
    least = lambda p, *fields: F.array_min(F.transform(p, lambda x: F.struct(*[x[f].alias(f) for f in (*fields, "iter", "path")])))
    told = {
        "last_iter": lambda: least(most(all_, "iter")),
        "last_terminal_iter": lambda: least(most(ended, "iter")),
        "max_iter": lambda: least(most(ended, "ret")),
        "max_reward": lambda: least(most(ended, "below"), "siblings"),
        "max_visit": lambda: least(most(all_, "met")),
        "follow_max": lambda: least(most(most(all_, "walk"), "size")),
    }
    answers = [(s, told[s]()) for s in strategies]
    out = F.array(*[F.struct(F.lit(s).alias("strategy"), a["iter"].alias("iter"), a["path"].alias("path")) for s, a in answers])
    return per.select(example, F.inline(F.filter(out, lambda x: x["path"].isNotNull())))
