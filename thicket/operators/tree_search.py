"""Monte-Carlo tree search of all examples at once, as joins: no example's tree goes to one task, however wide it is.

A table-driven model: nodes (example, node_id, parent_id, reward, terminal, pos), the root of an example with null parent; siblings go by (pos, node_id). A node_id stands for one node of its example; rows repeated in these columns count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.storage import written


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _reachable(nodes: DataFrame, example: str, n_iters: int, depth_limit: int) -> DataFrame:
    """(example, root, found): of each example with a root the children (_at, fan) of every node that n_iters iterations can go on from, in order of reward, pos and node_id.

    Unvisited siblings are visited in this order, so the child with j before it is visited j times less than its parent at most: no other child can be met. Found level by level from the root, by joins that share one shuffle of the nodes, cut to n_iters a parent before and after it; what is found goes along in the same chain.
    """
    kids = nodes.where("parent_id is not null").select(example, "parent_id", "node_id", F.col("reward").cast("double").alias("reward"), F.col("terminal").cast("boolean").alias("terminal"), F.col("pos").cast("long").alias("pos"))
    order = Window.partitionBy(example, "parent_id").orderBy(-F.col("reward"), "pos", "node_id")
    ahead = kids.withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") <= n_iters)
    child = F.struct((-F.col("reward")).alias("s"), "pos", "node_id", "reward", "terminal")
    fans = ahead.groupBy(F.col(example).alias("_e"), F.col("parent_id").alias("_p")).agg(F.sort_array(F.collect_set(child)).alias("fan"))
    top = F.struct(F.col("pos").cast("long").alias("pos"), "node_id", F.col("reward").cast("double").alias("reward"), F.col("terminal").cast("boolean").alias("terminal"))
    roots = nodes.where("parent_id is null").groupBy(example).agg(F.min(top).alias("root"))
    entry = f"struct<_at:{dict(fans.dtypes)['_p']},fan:{dict(fans.dtypes)['fan']}>"
    none = F.array().cast(f"array<{entry}>")
    on_from = lambda x: F.when(~x["terminal"], x["node_id"])
    rows = roots.select(example, on_from(F.col("root")).alias("_at"), F.lit(n_iters).alias("_left"), "root", none.alias("found"))
    for level in range(depth_limit):
        j = rows.join(fans, (F.col(example) == F.col("_e")) & (F.col("_at") == F.col("_p")), "left").withColumn("fan", F.slice("fan", F.lit(1), F.col("_left")))
        found = F.when(F.col("fan").isNull(), F.col("found")).otherwise(F.array_append("found", F.struct("_at", "fan")))
        if level + 1 == depth_limit:
            rows = j.select(example, "root", found.alias("found"))
            break
        # the first child takes along what is found so far; of the others those that may go on are needed
        first = F.struct(F.lit(None).cast(dict(rows.dtypes)["_at"]).alias("_at"), F.lit(0).alias("_left"), F.col("root").alias("root"), found.alias("found"))
        each = lambda x, i: F.struct(on_from(x).alias("_at"), (F.col("_left") - i).alias("_left"), F.when(i == 0, F.col("root")).alias("root"), F.when(i == 0, found).otherwise(none).alias("found"))
        below = F.filter(F.transform("fan", each), lambda x: x["_at"].isNotNull() | x["root"].isNotNull() | (F.size(x["found"]) > 0))
        rows = j.select(example, F.explode(F.when(F.col("fan").isNull(), F.array(first)).otherwise(below)).alias("x")).select(example, "x.*")
    return rows.groupBy(example).agg(F.first("root", ignorenulls=True).alias("root"), F.flatten(F.collect_list("found")).alias("found"))


def search(nodes: DataFrame, example: str = "example_id", n_iters: int = 10, w_exp: float = 1.0, depth_limit: int = 5, cum_reward: str = "sum", calc_q: str = "mean", uct_with_fast_reward: bool = True) -> tuple[DataFrame, DataFrame]:
    """(visits, tree): visits (example, iter, pos, node_id, ret, reward, terminal, sibling), the path of each iteration with its back-propagated returns, sibling the node's pos; tree (example, node_id, n, total, most).

    Selection goes down expanded nodes by the highest q + w_exp * sqrt(ln N / max(1, n)), unvisited children counting their reward as q; without uct_with_fast_reward the unvisited child of highest reward comes first while there is one. What it ends at is expanded, and simulation goes on by the highest reward, expanding what it visits. Terminal nodes and those at depth_limit have no children. Of several roots of an example the first is its root; examples without a root have no rows.

    Joins find what the iterations can reach, see _reachable(): at most C(n_iters + depth_limit, depth_limit) nodes an example, fewer where the tree has fewer, whatever its width. These are a row of the example, and the iterations are column expressions on it: no iteration shuffles or writes anything. The paths are written, so that they are found once.
    """
    if depth_limit < 1 or n_iters < 1:
        raise ValueError("a search has a depth and iterations")
    if calc_q not in ("mean", "sum", "max"):
        raise ValueError(f"unknown calc_q {calc_q}")
    node_type = dict(nodes.dtypes)["node_id"]
    last = lambda path: F.element_at(path, -1)
    returns = lambda seen, node: F.transform(F.filter(seen, lambda v: v["node_id"] == node), lambda v: v["ret"])

    def ranked(x: Column, n_up: Column, rets: Column) -> Column:
        """A child with what it is chosen by, least first."""
        n = F.size(rets)
        total = F.aggregate(rets, F.lit(None).cast("double"), lambda a, r: F.coalesce(a + r, a, r))
        q = {"mean": F.when(n > 0, total / n), "sum": total, "max": F.array_max(rets)}[calc_q]
        score = F.coalesce(q, x["reward"]) + w_exp * F.sqrt(F.log(n_up.cast("double")) / F.greatest(n, F.lit(1)))
        # below a node that is not expanded yet, and without fast rewards, unvisited ones go by reward
        by_reward = (n_up == 0) if uct_with_fast_reward else (n == 0)
        ahead = F.lit(0) if uct_with_fast_reward else F.when(n == 0, -1).otherwise(0)
        return F.struct(ahead.alias("u"), F.when(by_reward, x["s"]).otherwise(-score).alias("s"), x["pos"].alias("p"), x["node_id"].alias("i"), F.struct(x["node_id"], x["reward"], x["terminal"], x["pos"]).alias("child"))

    def gone_on(path: Column, seen: Column) -> Column:
        at = last(path)["node_id"]
        fan = F.get(F.filter("found", lambda f: f["_at"] == at), 0)["fan"]
        best = lambda fan, n_up: F.array_min(F.transform(fan, lambda x: _let(returns(seen, x["node_id"]), lambda rets: ranked(x, n_up, rets))))["child"]
        return _let(fan, lambda fan: F.when(fan.isNull(), path).otherwise(F.array_append(path, _let(F.size(returns(seen, at)), lambda n_up: best(fan, n_up)))))

    def told(path: Column) -> Column:
        size = F.size(path)
        below = lambda i: F.aggregate(F.slice(path, i + 1, size - i), F.lit(0.0), lambda a, x: a + x["reward"])
        ret = below if cum_reward == "sum" else lambda i: below(i) / (size - i)
        return F.transform(path, lambda x, i: F.struct(i.cast("long").alias("pos"), x["node_id"].alias("node_id"), ret(i).alias("ret"), x["reward"].alias("reward"), x["terminal"].alias("terminal"), x["pos"].alias("sibling")))

    root = F.array(F.struct("root.node_id", "root.reward", "root.terminal", "root.pos"))
    levels, turns = (F.sequence(F.lit(1), F.lit(k)) for k in (depth_limit, n_iters))
    path = lambda seen: F.aggregate(levels, root, lambda path, _: gone_on(path, seen))
    none = F.array().cast(f"array<array<struct<pos:bigint,node_id:{node_type},ret:double,reward:double,terminal:boolean,sibling:bigint>>>")
    plays = F.aggregate(turns, none, lambda plays, _: F.array_append(plays, _let(_let(F.flatten(plays), path), told)))
    done = written(_reachable(nodes, example, n_iters, depth_limit).select(example, plays.alias("plays")))
    each = done.select(example, F.posexplode("plays").alias("iter", "path"))
    visits = each.select(example, F.col("iter").cast("long").alias("iter"), F.inline("path"))
    return visits, visits.groupBy(example, "node_id").agg(F.count("*").alias("n"), F.sum("ret").alias("total"), F.max("ret").alias("most"))
