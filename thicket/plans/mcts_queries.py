"""Monte-Carlo tree search over customers, their orders and the order lines, and what is read off its visits. The SQL plays the same eight iterations, written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import search, tree_search
from thicket.plans.search_queries import LINE_ID, _table_model

QUERIES, ORACLES = {}, {}
ITERATIONS = 8
STRATEGIES = ("last_iter", "last_terminal_iter", "max_iter", "max_reward", "follow_max", "max_visit")


def _plays(n: int = ITERATIONS) -> str:
    """p: each customer's iterations as (ex, iter, oid, lid, orr, lr): the order and the line that upper confidence leads to, given all iterations before."""
    best = "coalesce(s.total / s.n, r) + sqrt(ln(greatest({up}, 1)) / greatest(coalesce(s.n, 0), 1))"
    steps = [
        "o AS MATERIALIZED (SELECT o_custkey AS ex, 'o' || o_orderkey AS oid, o_orderkey AS k, o_totalprice / 1e6 AS r FROM orders)",
        f"l AS MATERIALIZED (SELECT l_orderkey AS k, {LINE_ID} AS lid, l_extendedprice / 1e6 AS r, l_linenumber AS pos FROM lineitem)",
        "p0 AS (SELECT 0 AS ex, 0 AS iter, '' AS oid, '' AS lid, 0.0 AS orr, 0.0 AS lr WHERE false)",
    ]
    for i in range(n):
        steps += [
            f"so{i} AS MATERIALIZED (SELECT ex, oid, count(*) AS n, sum(orr + coalesce(lr, 0)) AS total FROM p{i} GROUP BY ex, oid)",
            f"sl{i} AS MATERIALIZED (SELECT ex, lid, count(*) AS n, sum(lr) AS total FROM p{i} WHERE lid IS NOT NULL GROUP BY ex, lid)",
            f"co{i} AS MATERIALIZED (SELECT o.*, coalesce(s.n, 0) AS n FROM o LEFT JOIN so{i} s ON o.ex = s.ex AND o.oid = s.oid QUALIFY row_number() OVER (PARTITION BY o.ex ORDER BY {best.format(up=i)} DESC, o.oid) = 1)",
            f"cl{i} AS MATERIALIZED (SELECT c.ex, l.lid, l.r FROM co{i} c JOIN l ON c.k = l.k LEFT JOIN sl{i} s ON c.ex = s.ex AND l.lid = s.lid"
            f" QUALIFY row_number() OVER (PARTITION BY c.ex ORDER BY {best.format(up='c.n').replace(', r)', ', l.r)')} DESC, l.pos, l.lid) = 1)",
            f"p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} UNION ALL SELECT c.ex, {i}, c.oid, d.lid, c.r, d.r FROM co{i} c LEFT JOIN cl{i} d ON c.ex = d.ex)",
        ]
    whole = "CAST(round({} * 1e8) AS BIGINT)"
    steps.append(f"p AS MATERIALIZED (SELECT *, CAST(ex AS VARCHAR) || '>' || oid || coalesce('>' || lid, '') AS path, {whole.format('(orr + coalesce(lr, 0))')} AS ret, lid IS NOT NULL AS ended FROM p{n})")
    return "WITH " + ",\n".join(steps)


PLAYS = _plays()


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search.search(_table_model(spark, sf_dir), n_iters=ITERATIONS, depth_limit=3)[0]


def _cents(ret: Column) -> Column:
    """Returns are sums of hundredths of a cent of a million: whole numbers, so that no rounding tie can differ."""
    return F.round(ret * 1e8).cast("long")


@query(PLAYS + " SELECT ex AS example_id, CAST(iter AS BIGINT) AS iter, path, ret FROM p")
def mcts_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path and return of each of eight iterations of all customers with orders; good orders and lines are visited again."""
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), ">")
    return _visits(spark, sf_dir).groupBy("example_id", "iter").agg(path.alias("path"), _cents(F.max_by("ret", -F.col("pos"))).alias("ret"))


@query(PLAYS + " SELECT ex AS example_id, CAST(iter AS BIGINT) AS iter, path FROM p WHERE ended QUALIFY row_number() OVER (PARTITION BY ex ORDER BY ret DESC, iter) = 1")
def mcts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iteration of highest return of each customer."""
    return search.output_path(_visits(spark, sf_dir)).select("example_id", "iter", F.array_join("path", ">").alias("path"))


@query(PLAYS + """, n AS (SELECT ex, id, count(*) AS n FROM (SELECT ex, oid AS id FROM p UNION ALL SELECT ex, lid FROM p WHERE lid IS NOT NULL) GROUP BY ALL)
SELECT ex AS example_id, 'last_iter' AS strategy, arg_max(path, iter) AS path FROM p GROUP BY ex
UNION ALL SELECT ex, 'last_terminal_iter', arg_max(path, iter) FROM p WHERE ended GROUP BY ex
UNION ALL SELECT ex, 'max_iter', path FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY ret DESC, iter) AS b FROM p WHERE ended) WHERE b = 1
UNION ALL SELECT ex, 'max_reward', path FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY ret DESC, iter) AS b FROM p WHERE ended) WHERE b = 1
UNION ALL SELECT ex, 'follow_max', path FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY orr DESC, oid, lr DESC NULLS LAST, iter) AS b FROM p) WHERE b = 1
UNION ALL SELECT ex, 'max_visit', path FROM (SELECT p.*, row_number() OVER (PARTITION BY p.ex ORDER BY a.n + coalesce(b.n, 0) DESC, iter) AS b FROM p JOIN n a ON p.ex = a.ex AND p.oid = a.id LEFT JOIN n b ON p.ex = b.ex AND p.lid = b.id) WHERE b = 1""")
def mcts_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy answers with; one search serves all."""
    return search.output_paths(_visits(spark, sf_dir), STRATEGIES).select("example_id", "strategy", F.array_join("path", ">").alias("path"))


@query(PLAYS + """, v AS (SELECT ex, iter, CAST(ex AS VARCHAR) AS node_id, ret FROM p UNION ALL SELECT ex, iter, oid, ret FROM p UNION ALL SELECT ex, iter, lid, CAST(round(lr * 1e8) AS BIGINT) FROM p WHERE lid IS NOT NULL)
SELECT a.ex AS example_id, CAST(b.iter AS BIGINT) AS iter, a.node_id, count(*) AS n_visits, CAST(sum(a.ret) AS BIGINT) AS total FROM v a JOIN (SELECT DISTINCT ex, iter FROM p) b ON a.ex = b.ex AND a.iter <= b.iter GROUP BY ALL""")
def mcts_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visited tree after each iteration: visits and return sums of every node."""
    v = _visits(spark, sf_dir)
    return search.snapshots(v).select("example_id", "iter", "node_id", "n_visits", _cents(F.col("q") * F.col("n_visits")).alias("total"))
