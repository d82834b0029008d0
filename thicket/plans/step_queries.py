"""Votes, guards, running scores and statistics over events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions.extract import outcome as outcome_label
from thicket.functions.score import geometric, softmax
from thicket.operators import evaluate, votes, windows
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


_TOP = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) = 1"


@query(f"WITH {STEPS}, c AS (SELECT user_id, event_type AS answer, count(*) AS votes, min(pos) AS first FROM s GROUP BY ALL), t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM c) SELECT user_id, answer, votes, total, round(votes / total, 6) AS confidence FROM t {_TOP}")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(steps(spark, sf_dir), ["user_id"], "event_type", "pos").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {STEPS}, u AS (SELECT user_id, pos, nullif(event_type, 'error') AS answer FROM s WHERE k < 5), c AS (SELECT user_id, answer, count(*) AS votes, min(pos) AS first FROM u WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, answer, votes, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total, first FROM c {_TOP}) SELECT a.user_id, answer, coalesce(votes, 0) AS votes, coalesce(total, 0) AS total FROM (SELECT DISTINCT user_id FROM u) a LEFT JOIN t ON a.user_id = t.user_id")
def vote_drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).where("k < 5").withColumn("answer_", F.nullif("event_type", F.lit("error")))
    return votes.majority(s, ["user_id"], "answer_", "pos", drop_null=True).drop("confidence")


@query(f"WITH {STEPS}, u AS (SELECT user_id, pos, CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' WHEN event_type IN ('error', 'view') THEN 'no' END AS answer FROM s), c AS (SELECT user_id, answer, count(*) AS votes, min(pos) AS first FROM u WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, answer, votes, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total, first FROM c {_TOP}) SELECT a.user_id, answer, coalesce(votes, 0) AS votes, coalesce(total, 0) AS total FROM (SELECT DISTINCT user_id FROM u) a LEFT JOIN t ON a.user_id = t.user_id")
def vote_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("answer_", votes.canonical_yes_no(F.col("event_type"), ["purchase", "signup"], ["error", "view"]))
    return votes.majority(s, ["user_id"], "answer_", "pos", drop_null=True).drop("confidence")


@query(f"WITH {STEPS}, c AS (SELECT user_id, k AS answer, count(*) AS votes, min(pos) AS first, arg_min(event_type, pos) AS event_type FROM s GROUP BY user_id, k), t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM c) SELECT user_id, answer, votes, total, event_type, round(votes / total, 6) AS confidence FROM t {_TOP}")
def vote_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(steps(spark, sf_dir), ["user_id"], "k", "pos", text="event_type").withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {STEPS}, last AS (SELECT user_id, max(pos) AS last FROM s GROUP BY user_id),
e AS (SELECT user_id, least(unnest(range(0, last // 4 + 1)) * 4 + 3, last) AS e, last FROM last),
c AS (SELECT e.user_id, e.e, event_type, count(*) AS n FROM e JOIN s ON e.user_id = s.user_id AND s.pos <= e.e GROUP BY ALL),
v AS (SELECT user_id, e, list(n ORDER BY n DESC) AS v FROM c GROUP BY user_id, e),
st AS (SELECT user_id, min(e) AS stop FROM v WHERE v[1] >= 0.5 * (e + 1) AND coalesce(v[2], 0) < v[1] GROUP BY user_id),
u AS (SELECT s.* FROM s JOIN last l ON s.user_id = l.user_id LEFT JOIN st ON s.user_id = st.user_id WHERE s.pos <= coalesce(st.stop, l.last)),
g AS (SELECT user_id, event_type AS answer, count(*) AS votes, min(pos) AS first FROM u GROUP BY ALL), t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM g)
SELECT user_id, answer, votes, total, round(votes / total, 6) AS confidence FROM t {_TOP}""")
def vote_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.early_stopped(steps(spark, sf_dir), ["user_id"], "event_type", "pos", 4, 0.5).withColumn("confidence", F.round("confidence", 6))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), sh AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS share FROM n),
m AS (SELECT user_id, event_type, props, avg(value) AS mean FROM events GROUP BY ALL)
SELECT m.user_id, m.event_type AS answer, props AS text, round((mean + share) / 2, 6) AS confidence FROM m JOIN sh ON m.user_id = sh.user_id AND m.event_type = sh.event_type
QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY round((mean + share) / 2, 6) DESC, m.event_type, props) = 1""")
def vote_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.composite(read(spark, sf_dir, "events"), ["user_id"], "event_type", "props", "value")


@query("""SELECT doc_id, lang, count(*) OVER w AS n, CAST(sum(quality) OVER w AS BIGINT) AS n_correct, round(sum(quality) OVER w / count(*) OVER w, 6) AS accuracy FROM labels JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.running_accuracy(labelled(spark, sf_dir).withColumn("correct", F.col("quality") == 1), ["lang"], ["doc_id"], "correct")
    return r.select("doc_id", "lang", "n", "n_correct", "accuracy")


@query("SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct, round(avg(quality), 6) AS accuracy FROM labels")
def final_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(read(spark, sf_dir, "labels"), F.col("quality") == 1)


@query("SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct, round(avg(quality), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(labelled(spark, sf_dir), F.col("quality") == 1, ["lang", "source"], rollup=True)


_P = "p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM p)"


@query(f"""WITH {_P}, r AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING) - p AS before, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS rank FROM q),
k AS (SELECT * FROM r WHERE round(before, 9) <= 0.7 AND rank <= 4) SELECT user_id, event_type, CAST(rank AS INTEGER) AS rank, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS prob FROM k""")
def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return windows.nucleus(p, ["user_id"], "p", ["event_type"], 0.7, 4).select("user_id", "event_type", "rank", F.round("prob", 6).alias("prob"))


@query("""WITH a AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), e AS (SELECT *, exp((x - max(x) OVER (PARTITION BY user_id)) / 20) AS e FROM a)
SELECT user_id, event_type, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS share FROM e""")
def softmax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    return a.select("user_id", "event_type", F.round(softmax(F.col("x"), Window.partitionBy("user_id"), 20.0), 6).alias("share"))


@query(f"""WITH {STEPS}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AND event_type <> 'view' THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f), r AS (SELECT user_id, count(*) - 1 AS run FROM i GROUP BY user_id, island)
SELECT user_id, CAST(max(run) AS INTEGER) AS longest, max(run) >= 2 AS tripped FROM r GROUP BY user_id""")
def repeat_action_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeat_guard(steps(spark, sf_dir), ["user_id"], ["pos"], "event_type", ["view"], 2)


@query(f"""WITH {STEPS}, i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM s),
r AS (SELECT user_id, count(*) AS n FROM i WHERE event_type = 'error' GROUP BY user_id, island), m AS (SELECT user_id, max(n) AS n FROM r GROUP BY user_id)
SELECT a.user_id, coalesce(n, 0) AS longest, coalesce(n, 0) > 3 AS tripped FROM (SELECT DISTINCT user_id FROM s) a LEFT JOIN m ON a.user_id = m.user_id""")
def error_streak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.error_guard(steps(spark, sf_dir), ["user_id"], ["pos"], F.col("event_type") == "error")


@query(f"WITH {STEPS} SELECT user_id, event_id, CAST(pos + 1 AS INTEGER) AS step FROM s WHERE pos < 30")
def max_step_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cutoff(steps(spark, sf_dir), ["user_id"], ["pos"], 30).select("user_id", "event_id", "step")


@query(f"""WITH {STEPS}, l AS (SELECT user_id, count(*) AS steps, arg_max(event_type, pos) AS last FROM s GROUP BY user_id)
SELECT CASE WHEN last = 'error' THEN 'action error' WHEN steps >= 70 THEN 'max steps reached' ELSE 'response returned' END AS outcome, count(*) AS n, round(avg(steps), 6) AS mean_steps FROM l GROUP BY 1""")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("steps"), F.max_by("event_type", "pos").alias("last"))
    return s.groupBy(outcome_label(F.col("last"), F.col("steps"), 70).alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("steps"), 6).alias("mean_steps"))


@query("SELECT quality = 1 AS judge, toxic = 0 AS human, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM labels GROUP BY ALL")
def judge_human_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(read(spark, sf_dir, "labels").withColumn("j", F.col("quality") == 1).withColumn("h", F.col("toxic") == 0), "j", "h", "doc_id")


@query("""WITH h AS (SELECT user_id, value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2 <= count(*) OVER (PARTITION BY user_id) THEN 1 ELSE 2 END AS half FROM events),
p AS (SELECT user_id, avg(value) FILTER (half = 1) AS a, avg(value) FILTER (half = 2) AS b FROM h GROUP BY user_id)
SELECT count(*) AS n, round(avg(a - b), 4) AS mean_difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_ttest_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    h = read(spark, sf_dir, "events").withColumn("half", F.when(F.row_number().over(w.orderBy("ts", "event_id")) * 2 <= F.count("*").over(w), 1).otherwise(2))
    p = h.groupBy("user_id").agg(F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("b"))
    return evaluate.paired_t(p, "a", "b")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, round(avg(CASE WHEN k < 8 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type <> 'view' GROUP BY event_type""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = steps(spark, sf_dir).where("event_type <> 'view'")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg((F.col("k") < 8).cast("double")), 6).alias("success_rate"))


@query(f"WITH {STEPS}, f AS (SELECT user_id, event_type, min(pos) AS p FROM s GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS types FROM f GROUP BY user_id")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = steps(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("pos").alias("p"))
    return f.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rank FROM labels)
SELECT doc_id, quality, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= (SELECT min(n) FROM c)""")
def balance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.balanced(read(spark, sf_dir, "labels"), "quality", ["doc_id"]).select("doc_id", "quality", "rank")


@query("SELECT p_brand, p_type, count(*) AS frequency, arg_max(p_name, p_partkey) AS last_name FROM part GROUP BY p_brand, p_type QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) <= 2")
def frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = votes.frequencies(read(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_name", "p_partkey")
    w = Window.partitionBy("p_brand").orderBy(F.desc("frequency"), "p_type")
    return f.withColumn("r", F.row_number().over(w)).where("r <= 2").select("p_brand", "p_type", "frequency", F.col("p_name").alias("last_name"))


@query("""WITH f AS (SELECT p_brand, p_type, count(*) AS frequency FROM part GROUP BY ALL), m AS (SELECT DISTINCT p_brand, p_type, left(p_type, 1) AS cluster FROM part)
SELECT m.p_brand, cluster, CAST(sum(frequency) AS BIGINT) AS frequency, max(m.p_type) AS last_member FROM m JOIN f ON m.p_brand = f.p_brand AND m.p_type = f.p_type GROUP BY m.p_brand, cluster""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    f = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("frequency"))
    members = p.select("p_brand", "p_type", F.substring("p_type", 1, 1).alias("cluster"), F.col("p_type").alias("pos")).distinct()
    return votes.rolled_up(f, members, ["p_brand"], "p_type", "cluster", "pos")


@query(f"""WITH {STEPS} SELECT user_id, pos, max(value) OVER (PARTITION BY user_id ORDER BY pos) AS best, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM s""")
def refine_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.best_so_far(steps(spark, sf_dir), ["user_id"], ["pos"], "value").select("user_id", "pos", "best", "improved")


@query("SELECT l_orderkey, count(*) AS n, round(sum(pow(l_quantity / 50, 0.5) * pow(1 - l_discount, 0.5)), 4) AS reward FROM lineitem GROUP BY l_orderkey")
def geometric_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometric(F.col("l_quantity") / 50, 1 - F.col("l_discount"), 0.5)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(g), 4).alias("reward"))


@query("SELECT r_name AS prompt, count(*) AS n, round(avg(CASE WHEN (doc_id + r_regionkey) % 3 = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM region, labels GROUP BY r_name")
def prompt_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt of a small set against every question; the prompts' number is checked before they are broadcast."""
    return evaluate.prompt_accuracy(read(spark, sf_dir, "region"), read(spark, sf_dir, "labels"), "r_name", (F.col("doc_id") + F.col("r_regionkey")) % 3 == F.col("quality"))


@query("SELECT source, count(*) AS n, round(avg(coalesce(quality, 0)), 6) AS loose, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS strict, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def left_join_missing_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("loose"), F.round(F.avg(F.coalesce((F.col("quality") == 1).cast("double"), F.lit(0.0))), 6).alias("strict"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderstatus")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluate.unfinished(read(spark, sf_dir, "orders"), done, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
