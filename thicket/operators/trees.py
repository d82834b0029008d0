"""Trees as node tables: (example, node_id, parent_id, ...), root with null parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closure(nodes: DataFrame, example: str = "example_id") -> DataFrame:
    """(example, node_id, ancestor_id, distance) for every node and ancestor, itself at 0. Paths of length 1 are doubled until none gets longer, so a tree of depth d takes log d joins; a cycle raises an error."""
    own = nodes.select(example, "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    step = nodes.where("parent_id is not null").select(example, "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    out, reach = step, 1
    while True:
        # a path of more than `reach` steps is one of `reach` steps and one of at most as many
        far = out.where(F.col("distance") == reach).withColumnRenamed("ancestor_id", "_via").withColumnRenamed("distance", "_d")
        on = out.select(F.col(example).alias("_e"), F.col("node_id").alias("_n"), "ancestor_id", "distance")
        more = far.join(on, (F.col(example) == F.col("_e")) & (F.col("_via") == F.col("_n"))).select(example, "node_id", "ancestor_id", (F.col("_d") + F.col("distance")).alias("distance"))
        if more.where(F.col("node_id") == F.col("ancestor_id")).limit(1).count():
            raise ValueError("a node is its own ancestor")
        longest = more.agg(F.max("distance")).first()[0]
        out, reach = out.unionByName(more), reach * 2
        if longest is None or longest < reach:
            return own.unionByName(out)


def valid(nodes: DataFrame, example: str = "example_id") -> DataFrame:
    """(example, n_nodes, n_roots, n_orphans, is_tree): one root, ids unique, every parent there, every node reached from the root."""
    per = nodes.groupBy(example).agg(F.count("*").alias("n_nodes"), F.sum(F.col("parent_id").isNull().cast("long")).alias("n_roots"), F.countDistinct("node_id").alias("_ids"))
    up = nodes.select(example, F.col("node_id").alias("parent_id")).distinct()
    orphans = nodes.where("parent_id is not null").join(up, [example, "parent_id"], "left_anti").groupBy(example).agg(F.count("*").alias("n_orphans"))
    j = per.join(orphans, example, "left").fillna(0, ["n_orphans"])
    return j.withColumn("is_tree", (F.col("n_roots") == 1) & (F.col("n_orphans") == 0) & (F.col("_ids") == F.col("n_nodes"))).drop("_ids")


def selected_edges(nodes: DataFrame, value: str, example: str = "example_id") -> DataFrame:
    """(example, parent_id, node_id): of each parent the child of highest value, the first by id on ties; null values come last."""
    w = Window.partitionBy(example, "parent_id").orderBy(F.desc_nulls_last(value), "node_id")
    return nodes.where("parent_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(example, "parent_id", "node_id")


#: Leaves of one task.
LEAVES = 500_000


def answer_weights(leaves: DataFrame, example: str, path: list[str], answer: str, reward: str, depth: int, how: str, n_leaves: int | None = None) -> DataFrame:
    """(example, answer, weight): answers of a tree weighed by the rewards above them.

    leaves: one row a terminal, with the ids of its ancestors from the root in the columns `path` and their rewards in `r_<column>`. A terminal adds its reward (by depth, for edge_inverse_depth); an ancestor adds its reward once for each distinct answer below it, over the mean depth of that answer's terminals below it. uniform: a terminal adds 1 and nothing else counts.

    n_leaves, if it is known about: leaves are dealt by example to so many tasks that each has some LEAVES, whatever the session's number of partitions, and nothing is aggregated before.
    """
    if n_leaves is not None:
        leaves = leaves.repartition(max(1, -(-n_leaves // LEAVES)), example)
    if how == "uniform":
        return leaves.groupBy(example, answer).agg(F.count("*").cast("double").alias("weight"))
    by = depth if how == "edge_inverse_depth" else 1
    # the leaves are met once; what is above them is found from their groups
    per = leaves.groupBy(example, *path, answer).agg(F.sum(F.col(reward) / by).alias("_own"), *[F.max(f"r_{c}").alias(f"_r{k}") for k, c in enumerate(path)])
    last = [F.col(f"_r{len(path) - 1}") / by] if path else []
    out = per.select(example, answer, F.explode(F.array("_own", *last)).alias("weight"))
    for k in range(len(path) - 1):
        up = per.groupBy(example, *path[: k + 1], answer).agg(F.max(f"_r{k}").alias("_r"))
        out = out.unionByName(up.select(example, answer, (F.col("_r") / by).alias("weight")))
    return out.groupBy(example, answer).agg(F.sum("weight").alias("weight"))


def best_answer(weights: DataFrame, example: str, answer: str) -> DataFrame:
    w = Window.partitionBy(example).orderBy(F.desc(F.round("weight", 4)), answer)
    return weights.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snapshot(nodes: DataFrame, example: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for display: edges numbered by their target in id order inside each example."""
    e = nodes.where("parent_id is not null").select(example, F.col("parent_id").alias("source"), F.col("node_id").alias("target"))
    return nodes, e.withColumn("edge_id", F.row_number().over(Window.partitionBy(example).orderBy("target")) - 1)


def to_json(nodes: DataFrame, example: str, data: list[str]) -> DataFrame:
    """(example, tree): each example's nodes as JSON, in id order."""
    return nodes.groupBy(example).agg(F.to_json(F.sort_array(F.collect_list(F.struct("node_id", "parent_id", *data)))).alias("tree"))
