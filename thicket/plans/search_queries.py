"""Search and tree queries: region -> nation -> customer -> order, and customer -> order -> line, as natural trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions.score import uct
from thicket.operators import search, trees, windows
from thicket.plans.tables import STEPS, read, steps


def _by_level(levels: list[DataFrame]) -> search.Model:
    """A model whose children at each level are the rows of that level's table (parent_id, node_id, action, reward, terminal, pos)."""
    at = iter(levels)
    return lambda frontier: frontier.join(next(at), "parent_id")


def _region_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, search.Model]:
    t = lambda n: read(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    roots = t("region").select(F.col("r_regionkey").alias("example_id"), key("r", "r_regionkey").alias("node_id"))
    row = lambda parent, node, action, reward, end: [parent.alias("parent_id"), node.alias("node_id"), action.alias("action"), reward.cast("double").alias("reward"), F.lit(end).alias("terminal"), F.lit(0).alias("pos")]
    nations = t("nation").select(*row(key("r", "n_regionkey"), key("n", "n_nationkey"), F.col("n_name"), F.col("n_nationkey") % 7, False))
    customers = t("customer").select(*row(key("n", "c_nationkey"), key("c", "c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal"), False))
    orders = t("orders").select(*row(key("c", "o_custkey"), key("o", "o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"), True))
    return roots, _by_level([nations, customers, orders])


def _beam(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        roots, model = _region_tree(spark, sf_dir)
        found = search.beam_search(roots, model, max_depth=3, **options)
        return found.select("example_id", "node_id", F.array_join("path_ids", ">").alias("path"), F.round("score", 4).alias("score"), "rank")

    return run


def _beam_sql(beam_size: int, aggregator: str = "sum", min_reward: float | None = None, dedup: bool = False, return_beam: bool = False) -> str:
    score = {"sum": "list_sum(rs)", "mean": "list_sum(rs) / len(rs)"}[aggregator]
    levels = [
        ("nation", "'r' || n_regionkey", "'n' || n_nationkey", "n_name", "n_nationkey % 7"),
        ("customer", "'n' || c_nationkey", "'c' || c_custkey", "c_mktsegment", "c_acctbal"),
        ("orders", "'c' || o_custkey", "'o' || o_orderkey", "o_orderpriority", "o_totalprice"),
    ]
    out = ["b0 AS (SELECT r_regionkey AS ex, 'r' || r_regionkey AS id, ['r' || r_regionkey] AS path, CAST([] AS DOUBLE[]) AS rs FROM region)"]
    for i, (table, parent, node, action, reward) in enumerate(levels):
        out.append(f"g{i} AS (SELECT b.ex, {node} AS id, list_append(b.path, {node}) AS path, list_append(b.rs, CAST({reward} AS DOUBLE)) AS rs, {action} AS action FROM b{i} b JOIN {table} ON b.id = {parent})")
        out.append(f"s{i} AS (SELECT *, {score} AS score FROM g{i})")
        bound = f"WHERE score >= {min_reward}" if min_reward is not None else ""
        out.append(f"m{i} AS (SELECT * FROM s{i} {bound})")
        first = "QUALIFY row_number() OVER (PARTITION BY ex, action ORDER BY score DESC, path) = 1" if dedup else ""
        out.append(f"d{i} AS (SELECT * FROM m{i} {first})")
        out.append(f"b{i + 1} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY ex ORDER BY score DESC, path) <= {beam_size})")
    return f"WITH {', '.join(out)} SELECT CAST(ex AS INTEGER) AS example_id, id AS node_id, array_to_string(path, '>') AS path, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY ex ORDER BY score DESC, path) AS INTEGER) AS rank FROM b3" + ("" if return_beam else " QUALIFY rank = 1")


def _line_id(sep: str = "-") -> Column:
    return F.concat_ws(sep, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def _order_levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    roots = o.select(F.col("o_custkey").alias("example_id")).distinct().withColumn("node_id", F.col("example_id").cast("string"))
    up = o.select(F.col("o_custkey").cast("string").alias("parent_id"), F.col("o_orderkey").cast("string").alias("node_id"), F.lit("order").alias("action"), F.col("o_totalprice").alias("reward"), F.lit(False).alias("terminal"), F.lit(0).alias("pos"))
    low = li.select(F.col("l_orderkey").cast("string").alias("parent_id"), _line_id().alias("node_id"), F.col("l_returnflag").alias("action"), F.col("l_extendedprice").alias("reward"), F.lit(True).alias("terminal"), F.col("l_linenumber").alias("pos"))
    return roots, up, low


def dfs_bounded_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, up, low = _order_levels(spark, sf_dir)
    found = search.dfs(roots, _by_level([up, low]), max_per_state=2, depth=2)
    return found.where("rank = 1").select("example_id", "node_id", F.round("score", 4).alias("score"))


DFS_SQL = f"""
WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) <= 2),
l AS (SELECT *, {LINE_ID} AS id FROM lineitem),
g AS (SELECT o_custkey, o_orderkey, id, o_totalprice + l_extendedprice AS score FROM o JOIN l ON o_orderkey = l_orderkey
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY l_extendedprice DESC, l_linenumber, id) <= 2)
SELECT o_custkey AS example_id, id AS node_id, round(score, 4) AS score FROM g
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, CAST(o_orderkey AS VARCHAR), id) = 1
"""


def random_shooting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.random_shooting(steps(spark, sf_dir), "user_id", ["pos"], "value", 10, 5, pick=lambda shot, depth: shot * 7 + depth * 3)


SHOOT_SQL = f"""
WITH {STEPS}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
w AS (SELECT user_id, shot, (shot * 7 + d * 3) % n AS pos FROM n, range(10) a(shot), range(5) b(d)),
t AS (SELECT w.user_id, w.shot, round(sum(value), 4) AS total FROM w JOIN s ON w.user_id = s.user_id AND w.pos = s.pos GROUP BY w.user_id, w.shot)
SELECT user_id, CAST(shot AS INTEGER) AS shot, total FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, shot) = 1
"""


def _table_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, up, low = _order_levels(spark, sf_dir)
    top = roots.select("example_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("reward"), F.lit(False).alias("terminal"), F.lit(0).alias("pos"))
    mid = up.select(F.col("parent_id").cast("long").alias("example_id"), F.concat(F.lit("o"), "node_id").alias("node_id"), "parent_id", (F.col("reward") / 1e6).alias("reward"), "terminal", "pos")
    of = up.select(F.col("parent_id").cast("long").alias("example_id"), F.col("node_id").alias("order"))
    leaf = low.join(of, low["parent_id"] == of["order"]).select("example_id", "node_id", F.concat(F.lit("o"), "order").alias("parent_id"), (F.col("reward") / 1e6).alias("reward"), "terminal", "pos")
    return top.unionByName(mid).unionByName(leaf)


def _backprop(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.returns(steps(spark, sf_dir), ["user_id"], "pos", "value", how).select("user_id", "pos", F.round(F.col("ret") + 1e-7, 4).alias("ret"))  # off exact ties of rounding

    return run


def _backprop_sql(how: str) -> str:
    return f"WITH {STEPS} SELECT user_id, pos, round({how}(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-7, 4) AS ret FROM s"


def mcts_uct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("q"))
    w = Window.partitionBy("user_id")
    s = per.withColumn("score", F.round(uct(F.col("q"), F.sum("n").over(w), F.col("n"), 10.0), 4))
    return s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "event_type"))).select("user_id", "event_type", "n", "score", "rank")


UCT_SQL = """
WITH p AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS q FROM events GROUP BY ALL),
s AS (SELECT *, round(q + 10.0 * sqrt(ln(sum(n) OVER (PARTITION BY user_id)) / greatest(n, 1)), 4) AS score FROM p)
SELECT user_id, event_type, n, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS INTEGER) AS rank FROM s
"""


def mcts_max_reward_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all visited terminals the path of highest reward sum, the first in pre-order on ties: one aggregation by example."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    leaf = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("example_id"), F.col("o_orderkey").cast("string").alias("o"), _line_id().alias("l"), F.round(F.col("o_totalprice") + F.col("l_extendedprice"), 4).alias("reward"))
    best = leaf.groupBy("example_id").agg(F.min(F.struct((-F.col("reward")).alias("n"), "o", "l")).alias("b"))
    return best.select("example_id", F.concat_ws(">", "b.o", "b.l").alias("path"), (-F.col("b.n")).alias("reward"))


MAX_PATH_SQL = f"""
WITH t AS (SELECT o_custkey AS example_id, CAST(o_orderkey AS VARCHAR) AS o, {LINE_ID} AS l, round(o_totalprice + l_extendedprice, 4) AS reward FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT example_id, o || '>' || l AS path, reward FROM t QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY reward DESC, o, l) = 1
"""


def _tree_answer(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
        leaves = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("example_id"), "o_orderkey", F.col("o_totalprice").alias("r_o_orderkey"), F.col("l_returnflag").alias("answer"), F.col("l_extendedprice").alias("reward"))
        w = trees.answer_weights(leaves, "example_id", ["o_orderkey"], "answer", "reward", 2, how, li.count())
        return trees.best_answer(w, "example_id", "answer").select("example_id", "answer", F.round("weight", 3).alias("weight"))

    return run


def _tree_answer_sql(how: str) -> str:
    by = " / 2" if how == "edge_inverse_depth" else ""
    parts = "SELECT example_id, answer, 1.0 AS w FROM t" if how == "uniform" else f"SELECT example_id, answer, reward{by} AS w FROM t UNION ALL SELECT example_id, answer, max(r){by} FROM t GROUP BY example_id, o, answer"
    return f"""
WITH t AS (SELECT o_custkey AS example_id, o_orderkey AS o, o_totalprice AS r, l_returnflag AS answer, l_extendedprice AS reward FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT example_id, answer, CAST(sum(w) AS DOUBLE) AS weight FROM ({parts}) GROUP BY example_id, answer)
SELECT example_id, answer, round(weight, 3) AS weight FROM a QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY round(weight, 4) DESC, answer) = 1"""


def _nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    n = t("nation").select(F.col("n_nationkey").alias("example_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("q"))
    c = t("customer").select(F.col("c_nationkey").alias("example_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_acctbal").alias("q"))
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("example_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.col("o_totalprice").alias("q"))
    return n.unionByName(c).unionByName(o)


NODES = """n AS (SELECT n_nationkey AS example_id, 'n' || n_nationkey AS node_id, NULL AS parent_id, 0.0 AS q FROM nation
UNION ALL SELECT c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer
UNION ALL SELECT c_nationkey, 'o' || o_orderkey, 'c' || o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tree_snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = trees.snapshot(_nation_nodes(spark, sf_dir))
    return edges.select("example_id", "source", "target", F.col("edge_id").cast("long").alias("edge_id"))


def tree_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = trees.snapshot(_nation_nodes(spark, sf_dir))
    return nodes


def tree_selected_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.selected_edges(_nation_nodes(spark, sf_dir), "q")


def tree_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.valid(_nation_nodes(spark, sf_dir))


VALID_SQL = f"""
WITH {NODES} SELECT example_id, count(*) AS n_nodes, CAST(count(*) FILTER (parent_id IS NULL) AS BIGINT) AS n_roots,
  CAST(count(*) FILTER (parent_id IS NOT NULL AND NOT found) AS BIGINT) AS n_orphans,
  count(*) FILTER (parent_id IS NULL) = 1 AND count(*) FILTER (parent_id IS NOT NULL AND NOT found) = 0 AND count(DISTINCT node_id) = count(*) AS is_tree
FROM (SELECT a.*, EXISTS (SELECT 1 FROM n b WHERE b.example_id = a.example_id AND b.node_id = a.parent_id) AS found FROM n a) GROUP BY example_id
"""


def _region_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    r = t("region").select(F.col("r_regionkey").alias("example_id"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    n = t("nation").select(F.col("n_regionkey").alias("example_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("example_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(c)


def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.closure(_region_nodes(spark, sf_dir))


CLOSURE_SQL = """
WITH RECURSIVE n AS (SELECT r_regionkey AS example_id, 'r' || r_regionkey AS node_id, NULL AS parent_id FROM region
UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT example_id, node_id, node_id AS ancestor_id, 0 AS distance FROM n
UNION ALL SELECT c.example_id, c.node_id, n.parent_id, c.distance + 1 FROM c JOIN n ON c.example_id = n.example_id AND c.ancestor_id = n.node_id WHERE n.parent_id IS NOT NULL)
SELECT CAST(example_id AS INTEGER) AS example_id, node_id, ancestor_id, distance FROM c
"""


QUERIES = {
    "beam_topk_path": _beam(beam_size=3),
    "greedy_path": _beam(beam_size=1),
    "beam_reward_mean": _beam(beam_size=3, aggregator="mean"),
    "beam_reward_sum": _beam(beam_size=5, aggregator="sum", return_beam=True),
    "beam_reject_min": _beam(beam_size=4, min_reward=2.0, return_beam=True),
    "beam_action_dedup": _beam(beam_size=4, dedup=True, return_beam=True),
    "dfs_bounded_width": dfs_bounded_width,
    "random_shooting": random_shooting,
    "mcts_backprop_sum": _backprop("sum"),
    "mcts_backprop_mean": _backprop("mean"),
    "mcts_uct_rank": mcts_uct_rank,
    "mcts_max_reward_path": mcts_max_reward_path,
    "tree_answer_edge": _tree_answer("edge"),
    "tree_answer_inverse_depth": _tree_answer("edge_inverse_depth"),
    "tree_answer_uniform": _tree_answer("uniform"),
    "tree_snapshot_nodes": tree_snapshot_nodes,
    "tree_snapshot_edges": tree_snapshot_edges,
    "tree_selected_edge": tree_selected_edge,
    "tree_valid": tree_valid,
    "tree_closure": tree_closure,
}
ORACLES = {
    "beam_topk_path": _beam_sql(3),
    "greedy_path": _beam_sql(1),
    "beam_reward_mean": _beam_sql(3, "mean"),
    "beam_reward_sum": _beam_sql(5, return_beam=True),
    "beam_reject_min": _beam_sql(4, min_reward=2.0, return_beam=True),
    "beam_action_dedup": _beam_sql(4, dedup=True, return_beam=True),
    "dfs_bounded_width": DFS_SQL,
    "random_shooting": SHOOT_SQL,
    "mcts_backprop_sum": _backprop_sql("sum"),
    "mcts_backprop_mean": _backprop_sql("avg"),
    "mcts_uct_rank": UCT_SQL,
    "mcts_max_reward_path": MAX_PATH_SQL,
    "tree_answer_edge": _tree_answer_sql("edge"),
    "tree_answer_inverse_depth": _tree_answer_sql("edge_inverse_depth"),
    "tree_answer_uniform": _tree_answer_sql("uniform"),
    "tree_snapshot_nodes": f"WITH {NODES} SELECT example_id, node_id, parent_id, CAST(q AS DOUBLE) AS q FROM n",
    "tree_snapshot_edges": f"WITH {NODES} SELECT example_id, parent_id AS source, node_id AS target, row_number() OVER (PARTITION BY example_id ORDER BY node_id) - 1 AS edge_id FROM n WHERE parent_id IS NOT NULL",
    "tree_selected_edge": f"WITH {NODES} SELECT example_id, parent_id, node_id FROM n WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY example_id, parent_id ORDER BY q DESC NULLS LAST, node_id) = 1",
    "tree_valid": VALID_SQL,
    "tree_closure": CLOSURE_SQL,
}
