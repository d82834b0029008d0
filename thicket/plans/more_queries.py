"""Sets, cursors, pruning and report queries over events, orders and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import rewards
from thicket.operators import windows
from thicket.plans.tables import STEPS, labelled, read, steps

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n),
c AS (SELECT *, sum(p) OVER w AS cum, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, coalesce(lag(round(cum, 9) > 0.5) OVER (PARTITION BY user_id ORDER BY rank), false) AS gone FROM c) SELECT user_id, event_type, CAST(rank AS INTEGER) AS rank FROM s WHERE NOT gone""")
def nucleus_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleus that keeps the first candidate to cross the mass."""
    w = Window.partitionBy("user_id").orderBy(F.desc("p"), "event_type")
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    c = p.withColumn("over", F.round(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9) > 0.5).withColumn("rank", F.row_number().over(w))
    return c.withColumn("gone", F.lag("over", 1, False).over(w)).where("not gone").select("user_id", "event_type", "rank")


@query(f"""WITH {STEPS} SELECT user_id, pos, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS recent FROM s""")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-4, 0)
    return steps(spark, sf_dir).select("user_id", "pos", F.array_join(F.collect_list("event_type").over(w), ",").alias("recent"))


@query(f"""WITH {STEPS}, x AS (SELECT *, first_value(value) OVER w AS root, lag(value) OVER w AS parent, max(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, count(*) AS n, CAST(count(*) FILTER (value < (parent + root) / 2) AS BIGINT) AS below, CAST(count(*) FILTER (value > best) AS BIGINT) AS above FROM x GROUP BY user_id""")
def prune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a search would stop at: below the mean of parent and root, or above the best before."""
    w = Window.partitionBy("user_id").orderBy("pos")
    x = steps(spark, sf_dir).withColumn("root", F.first("value").over(w)).withColumn("parent", F.lag("value").over(w)).withColumn("best", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") < (F.col("parent") + F.col("root")) / 2).alias("below"), F.count_if(F.col("value") > F.col("best")).alias("above"))


@query(f"""WITH {STEPS}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f) SELECT user_id, pos, event_type, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY pos) - 1 AS INTEGER) AS cursor FROM i""")
def lookup_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which result of a repeated lookup each step is at; a new keyword starts again."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("pos"))
    return windows.run_lengths(steps(spark, sf_dir), ["user_id"], ["pos"], F.col("event_type") == before).select("user_id", "pos", "event_type", F.col("run").alias("cursor"))


@query(f"""WITH {STEPS}, x AS (SELECT user_id, pos, value, k, max(k) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s) SELECT user_id, pos, k FROM x WHERE best IS NULL OR k >= best""")
def monotone_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinements kept only if their confidence isn't below all before."""
    return windows.best_so_far(steps(spark, sf_dir), ["user_id"], ["pos"], "k").where("improved").select("user_id", "pos", "k")


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT a.o_custkey, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority GROUP BY a.o_custkey""")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    both = o.where("o_orderstatus = 'F'").drop("o_orderstatus").intersectAll(o.where("o_orderstatus = 'O'").drop("o_orderstatus"))
    return both.groupBy("o_custkey").agg(F.count("*").alias("common"))


@query("""WITH w AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value < 50))) AS a, list_sort(list_distinct(list(event_type) FILTER (value >= 50))) AS b FROM events GROUP BY user_id)
SELECT user_id, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS n_new, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) <= 1 AS terminal FROM w""")
def few_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("b"))
    n = F.size(F.array_except("b", "a")).cast("long")
    return g.select("user_id", n.alias("n_new"), (n <= 1).alias("terminal"))


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def distinct_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (customer, priority), the first by key, with what it carries."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_totalprice", "o_orderkey").alias("price"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 2) AS cost, round(coalesce(sum(value) / nullif(count(*), 0), 0), 4) AS latency FROM events WHERE value >= 0 GROUP BY event_type")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value >= 0")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("cost"), F.round(F.coalesce(F.try_divide(F.sum("value"), F.count("*")), F.lit(0.0)), 4).alias("latency"))


@query("SELECT lang, round(avg(quality), 6) AS success_rate, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (quality = 1) AS success_ids FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def success_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.sort_array(F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id")))), ",")
    return labelled(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("success_rate"), ids.alias("success_ids"))


@query("SELECT user_id, round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END), 6) AS critic FROM events GROUP BY user_id")
def critic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.functions.score import critic

    verdict = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "on-track").otherwise("off")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(critic(verdict)), 6).alias("critic"))


@query("SELECT user_id, round(CAST(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.1 WHEN 'error' THEN 0.0001 ELSE 0 END) AS DOUBLE), 4) AS worth FROM events GROUP BY user_id")
def verdict_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("event_type") == "purchase", "sure").when(F.col("event_type") == "click", "likely").when(F.col("event_type") == "error", "impossible").otherwise("other")
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(word).alias("v"))
    return g.select("user_id", F.round(rewards.verdicts(F.col("v"), F.lit(1), 5), 4).alias("worth"))


@query("""WITH p AS (SELECT l_orderkey, sum(ln(1 - l_discount)) AS lp, sum(l_quantity) AS len, exp(sum(ln(1 - l_tax))) AS conf FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(sqrt(exp(lp / greatest(len, 1))) * sqrt(conf), 6) AS reward FROM p""")
def chain_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.ln(1 - F.col("l_discount")).alias("p"), F.col("l_quantity").alias("n"), (1 - F.col("l_tax")).alias("c"))).alias("x"))
    part = lambda k: F.transform("x", lambda v: v[k])
    return g.select("l_orderkey", F.round(rewards.step_probability(part("p"), part("n"), part("c")), 6).alias("reward"))


@query("SELECT p_size AS num_constraints, count(*) AS n FROM part GROUP BY p_size")
def constraint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("num_constraints")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def first_layer_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's best orders the customer below the root that leads to them: what a planner would do first."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    j = c.join(o, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", "o_orderkey")
