"""Readers, writers, streams and small relational operators: what is written from the driver tables is read back, and SQL says what must come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import extract, judge
from thicket.model import few_shot, filled
from thicket.operators import alignment, evaluate, programs, search, trees, votes
from thicket.plans.search_queries import LINE_ID, _by_level, _order_levels
from thicket.plans.tables import STEPS, folder, read, steps
from thicket.sources import readers, writers
from thicket.streaming import guards

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


# readers


@query("SELECT 'q ' || doc_id AS question, 'so' || chr(10) || '#### ' || n_chars || ',5' AS answer, n_chars || '5' AS gold FROM documents")
def read_word_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/a"
    answer = F.concat(F.lit("so\n#### "), "n_chars", F.lit(",5"))
    _numbered(spark, sf_dir).select(F.concat(F.lit("q "), "doc_id").alias("question"), answer.alias("answer")).write.json(path)
    return readers.word_problems(spark, path)


@query("SELECT 'q' || doc_id || ' Options: A) ' || n_chars || ', B) ' || lang || '.' AS question, 'A' AS correct, CAST(n_chars AS DOUBLE) AS a, 'A. ' || lang || chr(10) || 'B. ' || source AS lettered FROM documents")
def read_multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/m"
    options = F.array(F.concat(F.lit("A)"), "n_chars"), F.concat(F.lit("B)"), "lang"))
    d = _numbered(spark, sf_dir)
    d.select(F.concat(F.lit("q"), "doc_id").alias("question"), options.alias("options"), F.lit("A").alias("correct")).write.json(path)
    got = readers.multiple_choice(spark, path).select("question", "correct", F.try_element_at("option_values", F.lit("A")).alias("a"))
    lettered = d.select(F.concat(F.lit("q"), "doc_id", F.lit(" ")).alias("_q"), readers.lettered_options(F.array("lang", "source")).alias("lettered"))
    return got.join(lettered, F.substring_index("question", "Options", 1) == F.col("_q")).drop("_q")


@query("SELECT n_name AS question, CAST(n_nationkey AS VARCHAR) AS answer, 2 AS n_steps, n_regionkey AS root, n_nationkey AS target FROM nation")
def read_graph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array in one file, as the tables of 25 nations give it."""
    path = folder(spark) + "/g"
    row = F.struct(F.col("n_name").alias("question"), F.col("n_nationkey").cast("string").alias("answer"), F.array(F.lit("a"), F.lit("b")).alias("steps"), F.array(F.lit("s")).alias("idx_to_symbol"), F.array(F.array("n_regionkey", "n_nationkey")).alias("edges"), F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("target"), F.lit(0).alias("neg_target"), F.lit("more").alias("extra"))
    read(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(row)).alias("value")).write.text(path)
    return readers.graph_questions(spark, path).select("question", "answer", F.size("steps").alias("n_steps"), "root", "target")


@query("SELECT n_name AS example, 'test_example' AS part, 'q' || n_nationkey AS question, 'True' AS answer, 2 AS n_steps FROM nation UNION ALL SELECT n_name, 'in_context_example0', 'c' || n_nationkey, 'False', 1 FROM nation")
def read_keyed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/k"
    part = lambda q, a, *chain: F.struct(F.concat(F.lit(q), "n_nationkey").alias("question"), F.lit("x").alias("query"), F.array(*map(F.lit, chain)).alias("chain_of_thought"), F.lit(a).alias("answer"))
    parts = F.struct(part("q", "True", "a", "b").alias("test_example"), part("c", "False", "a").alias("in_context_example0"))
    read(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", parts)))).alias("value")).write.text(path)
    return readers.keyed_examples(spark, path).select("example", "part", "question", "answer", F.size("chain_of_thought").alias("n_steps"))


@query("SELECT doc_id % 13 || ' ' || n_chars || ' 3 4' AS puzzle, CAST(doc_id % 13 + n_chars + 7 AS BIGINT) AS total FROM documents")
def read_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/p"
    _numbered(spark, sf_dir).select("doc_id", F.concat_ws(" ", F.col("doc_id") % 13, "n_chars", F.lit(3), F.lit(4)).alias("Puzzles")).write.option("header", True).csv(path)
    return readers.puzzles(spark, path).select("puzzle", F.aggregate("numbers", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT 2 AS num_constraints, lang || '|it is ' || source AS constraints, 'q, ' || doc_id AS question, CAST(doc_id AS INTEGER) AS seed_id FROM documents")
def read_constrained_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/c"
    literal = F.concat(F.lit("['"), "lang", F.lit("', 'it is "), "source", F.lit("']"))
    _numbered(spark, sf_dir).select(F.lit(2).alias("num_constraints"), literal.alias("constraints"), F.concat(F.lit("q, "), "doc_id").alias("question"), F.col("doc_id").alias("seed_id")).write.option("header", True).option("escape", '"').csv(path)
    return readers.constrained_questions(spark, path).withColumn("constraints", F.array_join("constraints", "|"))


@query("SELECT CAST(doc_id AS INTEGER) AS \"case\", quality = 1 AS correct, coalesce(CASE WHEN toxic = 0 THEN CAST(doc_id AS VARCHAR) END, '') AS output, CAST(quality AS VARCHAR) AS answer FROM labels")
def read_log_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, written and read back; a null output reads back empty."""
    path = folder(spark) + "/l"
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("case"), (F.col("quality") == 1).alias("correct"), F.when(F.col("toxic") == 0, F.col("doc_id").cast("string")).alias("output"), F.col("quality").cast("string").alias("answer"))
    writers.log_lines(rows, "case", "correct", "output", "answer").write.text(path)
    return readers.log_results(spark, path).drop("file")


@query("SELECT CAST(n_nationkey AS INTEGER) AS index, n_name FROM nation WHERE n_nationkey >= 5")
def read_numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose index is in the file name, from the fifth on."""
    named = read(spark, sf_dir, "nation").select(F.concat(F.lit("out/"), "n_nationkey", F.lit(".pkl")).alias("file"), "n_name")
    return readers.numbered_files(named, 5).select("index", "n_name")


@query("SELECT 'go ' || conv_id AS goal, 'web.' || conv_id AS instance_id, count(*) AS n_steps, arg_max(role, turn) AS last_action FROM conversations GROUP BY conv_id")
def read_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/t"
    history = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: F.array(F.lit("obs"), s["role"], F.lit("info")))
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(history.alias("history"))
    g.select(F.concat(F.lit("go "), "conv_id").alias("goal"), F.concat(F.lit("web."), "conv_id").alias("instance_id"), "history", F.lit(True).alias("is_complete")).write.json(path)
    return readers.trajectories(spark, path, whole=False).select("goal", "instance_id", F.col("n_steps").cast("long").alias("n_steps"), "last_action")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents QUALIFY row >= 20 AND row < (SELECT count(*) FROM documents) - 10")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from the twentieth to ten before the last, numbered without one window over all."""
    return readers.ranged(_numbered(spark, sf_dir).select("doc_id"), ["doc_id"], 20, -10)


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS index, o_orderkey FROM nation JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) ON n = n_nationkey + 1")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results numbered from 1 with their dataset rows."""
    results = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("index"))
    return evaluate.numbered_rows(results, "index", read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT conv_id, turn, doc_id FROM conversations c JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) d ON c.text = d.text UNION ALL SELECT doc_id, -1, doc_id FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)")
def asked_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the question that their goal is; the questions themselves are among the sessions."""
    q = read(spark, sf_dir, "documents").groupBy(F.col("text").alias("question")).agg(F.min("doc_id").alias("doc_id"))
    s = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(q.select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.col("question").alias("text")))
    return evaluate.asked_for(s, q, "text", "question").select("conv_id", "turn", "doc_id")


# writers


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'two' ELSE 'one' END AS run_id FROM documents UNION ALL SELECT doc_id, 'again', 'three' FROM documents")
def write_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended side by side, one of them written anew."""
    path, d = folder(spark) + "/r", _numbered(spark, sf_dir).select("doc_id", "lang")
    writers.append_results(d.where("lang <> 'en'"), path, "one")
    writers.append_results(d, path, "two")
    writers.append_results(d.withColumn("lang", F.lit("again")), path, "three")
    writers.replace_run(d.where("lang = 'en'"), path, "two")
    return spark.read.parquet(path).select("doc_id", "lang", F.col("run_id").cast("string").alias("run_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'late' ELSE lang END AS state, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def write_merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as one table: of each key the latest row."""
    path, d = folder(spark), _numbered(spark, sf_dir).select("doc_id", F.col("lang").alias("state"))
    d.withColumn("version", F.lit(1)).write.parquet(path + "/a")
    d.where("doc_id % 2 = 0").withColumns({"state": F.lit("late"), "version": F.lit(2)}).write.parquet(path + "/b")
    return writers.merged(spark, [path + "/a", path + "/b"], ["doc_id"], "version").select("doc_id", "state", "version")


@query("SELECT source AS run_id, 'beam' AS algorithm, CAST(count(*) AS VARCHAR) AS n_examples FROM documents GROUP BY source")
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for the run of each source, with its number of examples among the settings."""
    path = folder(spark) + "/m"
    runs = read(spark, sf_dir, "documents").groupBy("source").agg(F.lit("beam").alias("algorithm"), F.count("*").alias("n_examples"))
    writers.manifests(runs, path, "source", ["algorithm", "n_examples"])
    return spark.read.schema("run_id string, settings struct<algorithm:string,n_examples:string>").json(path).select("run_id", "settings.*")


@query("""SELECT '{"' || doc_id || '":"' || lang || '"}' AS value FROM documents""")
def write_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.by_key(_numbered(spark, sf_dir), "doc_id", "lang")


@query("SELECT doc_id, lang AS kept, source AS changed FROM documents")
def write_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field at a dotted path set, its neighbours as they were."""
    d = _numbered(spark, sf_dir).select("doc_id", "source", F.struct(F.struct(F.col("lang").alias("a"), F.lit("old").alias("b")).alias("in")).alias("m"))
    return writers.updated(d, "m.in.b", F.col("source")).select("doc_id", F.col("m.in.a").alias("kept"), F.col("m.in.b").alias("changed"))


@query("SELECT lang AS dataset, CASE WHEN quality = 1 THEN 'missed' ELSE 'wrong' END AS kind, CAST(doc_id AS VARCHAR) AS value FROM labels JOIN documents USING (doc_id) WHERE quality <> toxic")
def write_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/d"
    j = read(spark, sf_dir, "labels").join(_numbered(spark, sf_dir), "doc_id").where("quality <> toxic").withColumn("kind", F.when(F.col("quality") == 1, "missed").otherwise("wrong")).withColumn("text", F.col("doc_id").cast("string"))
    writers.disagreements(j, path, "kind", "text", "lang")
    return spark.read.text(path).select("dataset", "kind", "value")


# streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event*.parquet")


def _ended(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """What a stream gives over all there is, as a table in the shared folder (update and complete modes: the last rows)."""
    path = folder(spark)
    put = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path + "/out")
    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", path + "/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path + "/out")


@query("""WITH s AS (SELECT *, row_number() OVER w AS step, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(CASE WHEN event_type = before AND event_type <> 'view' THEN 0 ELSE 1 END) OVER w AS r, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS e FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, r ORDER BY event_id) - 1 AS repeats, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, e ORDER BY event_id) AS BIGINT) AS errors FROM i)
SELECT CAST(user_id AS VARCHAR) AS key, step, event_type AS action, repeats, errors, repeats >= 5 AS repeat_tripped, errors > 3 AS error_tripped, step > 30 AS cut_off FROM n""")
def stream_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful guards over the events as a stream."""
    out = guards.guarded(_stream(spark, sf_dir), "user_id", "event_id", "event_type", free=("view",))
    return _ended(out, "append", spark)


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY event_type")
def stream_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = guards.running_accuracy(_stream(spark, sf_dir).withColumn("ok", F.col("value") > 50), "event_type", "ok")
    return _ended(out, "complete", spark).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = guards.windowed_counts(_stream(spark, sf_dir), "ts", "event_type", late="1000 days")
    return _ended(out, "complete", spark).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# votes and sets


@query(f"""WITH {STEPS}, a AS (SELECT user_id, pos, TRY_CAST(CASE WHEN k % 3 = 0 THEN 'x' ELSE CAST(k % 5 AS VARCHAR) END AS DOUBLE) AS a FROM s), c AS (SELECT user_id, a, count(*) AS votes, min(pos) AS first FROM a WHERE a IS NOT NULL GROUP BY ALL)
SELECT user_id, a AS answer, votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) = 1""")
def vote_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("k") % 3 == 0, "x").otherwise((F.col("k") % 5).cast("string"))
    return votes.numeric_majority(steps(spark, sf_dir).withColumn("a", answer), ["user_id"], "a", "pos").where("votes > 0").select("user_id", "answer", "votes")


@query(f"WITH {STEPS} SELECT user_id, event_type, round(sum(value), 4) AS score, min(pos) AS first FROM s GROUP BY ALL")
def vote_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = votes.candidate_scores(steps(spark, sf_dir), ["user_id"], "event_type", "value", "pos")
    return c.withColumn("score", F.round("score", 4))


@query(f"WITH {STEPS} SELECT user_id, pos, event_type FROM s QUALIFY row_number() OVER (PARTITION BY user_id, lower(substr(event_type, 1, 1)) || k % 2 ORDER BY pos) = 1")
def dedup_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of actions with the same canonical code the first."""
    code = F.concat(F.lower(F.substring("event_type", 1, 1)), F.col("k") % 2)
    return votes.first_of_each(steps(spark, sf_dir), ["user_id"], code, "pos").select("user_id", "pos", "event_type")


@query("SELECT user_id, event_type, bool_or(value >= 50) AS visited FROM events GROUP BY ALL")
def all_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return votes.all_sampled(e.where("value >= 50"), e.where("value < 50"), ["user_id", "event_type"])


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 ELSE 2 END AS priority, o_orderstatus || '-' || o_orderkey AS text FROM orders) SELECT g, string_agg(text, ',' ORDER BY priority, text) AS ordered FROM p GROUP BY g""")
def state_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a state by priority, then by text."""
    priority = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2)
    facts = F.sort_array(F.collect_list(F.struct(priority.alias("p"), F.concat_ws("-", "o_orderstatus", "o_orderkey").alias("t"))))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.array_join(F.transform(facts, lambda x: x["t"]), ",").alias("ordered"))


@query("SELECT doc_id, list_sort(list_filter([instr(text, 'the '), instr(text, 'and '), instr(text, 'der ')], lambda x: x > 0))[1] AS first_at, len(list_filter([instr(text, 'the '), instr(text, 'and '), instr(text, 'der ')], lambda x: x > 0)) AS n FROM documents")
def ordered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a text names, in the order of their first place."""
    at = F.filter(F.array(*[F.struct(F.locate(w, F.col("text")).alias("at"), F.lit(w).alias("w")) for w in ("the ", "and ", "der ")]), lambda x: x["at"] > 0)
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_sort(at).alias("o"))
    return d.select("doc_id", F.get("o", 0)["at"].cast("long").alias("first_at"), F.size("o").cast("long").alias("n"))


# searches


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS r FROM orders QUALIFY r <= 3),
l AS (SELECT l_orderkey, l_extendedprice, {LINE_ID} AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, {LINE_ID}) AS r2 FROM lineitem QUALIFY r2 <= 3),
n AS (SELECT o_custkey AS ex, [r] AS ord, NULL AS id, 0.0 AS score, o_orderkey FROM o UNION ALL SELECT o_custkey, [r, r2], id, o_totalprice + l_extendedprice, o_orderkey FROM o JOIN l ON o_orderkey = l_orderkey),
c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY ex ORDER BY ord) <= 7),
t AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ex ORDER BY ord) <= 4)
SELECT ex AS example_id, id AS node_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY ex ORDER BY score DESC, CAST(o_orderkey AS VARCHAR), id) AS INTEGER) AS rank FROM t""")
def dfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first search that stops at seven states and four terminals."""
    roots, up, low = _order_levels(spark, sf_dir)
    found = search.dfs(roots, _by_level([up, low]), max_per_state=3, depth=2, total_states=7, max_terminals=4)
    return found.select("example_id", "node_id", F.round("score", 4).alias("score"), "rank")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g')), ' +'), lambda x: x <> '') AS a,
  lead(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g')), ' +'), lambda x: x <> '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
d AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(b, lambda x: 0) AS row FROM t WHERE b IS NOT NULL
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]), lambda k: coalesce(CASE WHEN k > 1 THEN row[k - 1] END, 0) + 1)), 0))) FROM d WHERE i < len(a))
SELECT conv_id, turn, CAST(coalesce(list_max(row), 0) AS BIGINT) AS lcs, CAST(len(a) AS INTEGER) AS n_a, CAST(len(b) AS INTEGER) AS n_b FROM d WHERE i = len(a)""")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of each turn and its reply."""
    tokens = lambda c: F.array_remove(F.split(F.lower(F.regexp_replace(c, "[^A-Za-zÀ-ÿ0-9]+", " ")), " +"), "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(w)).where("reply is not null")
    p = c.select("conv_id", "turn", tokens(F.col("text")).alias("x"), tokens(F.col("reply")).alias("y"))
    return p.select("conv_id", "turn", alignment.lcs_length("x", "y").alias("lcs"), F.size("x").alias("n_a"), F.size("y").alias("n_b"))


@query("SELECT o_custkey AS example_id, CAST(to_json(list({'node_id': CAST(o_orderkey AS VARCHAR), 'parent_id': CAST(o_custkey AS VARCHAR), 'action': o_orderpriority} ORDER BY CAST(o_orderkey AS VARCHAR))) AS VARCHAR) AS tree FROM orders GROUP BY o_custkey")
def nodes_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("example_id"), F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_custkey").cast("string").alias("parent_id"), F.col("o_orderpriority").alias("action"))
    return trees.to_json(o, "example_id", ["action"])


@query("""SELECT n_nationkey || '.pddl' AS instance_path, n_name AS plan, CAST(n_nationkey AS INTEGER) AS n_steps, 1 AS n_goals, 'Start: the red block is clear and the red block is on the table. End: the red block is clear.' AS question FROM nation WHERE n_nationkey >= 3""")
def read_planning_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their problem files: a file for each nation, cases for all but three."""
    path, n = folder(spark), read(spark, sf_dir, "nation")
    text = "(define (problem x) (:objects a ) (:init (ontable a) (clear a)) (:goal (and (clear a))))"
    n.select(F.lit(text).alias("value"), F.concat("n_nationkey", F.lit(".pddl")).alias("file")).write.partitionBy("file").text(path + "/all")
    files = spark.read.text(path + "/all", wholetext=True)
    n.where("n_nationkey >= 3").select(F.concat("n_nationkey", F.lit(".pddl")).alias("instance_path"), F.col("n_name").alias("plan"), F.col("n_nationkey").alias("n_steps")).write.json(path + "/cases")
    got = readers.planning_cases(spark.read.schema("instance_path string, plan string, n_steps int").json(path + "/cases"), files.select(F.col("file").alias("_file"), "value"), "Start: <init>. End: <goals>.")
    return got.select("instance_path", "plan", "n_steps", F.size("goals").alias("n_goals"), "question")


@query("SELECT 'beam' || n_nationkey AS key, n_name AS value FROM nation")
def read_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/y"
    line = F.concat(F.lit("beam"), "n_nationkey", F.lit(": '"), "n_name", F.lit("'\n  nested: no\n# remark"))
    read(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return readers.settings(spark, path)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, (doc_id % 3 = 0) = (quality = 1) AS agrees FROM labels")
def chain_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains scored by the verdicts on their steps, and whether a person agrees."""
    k = F.col("doc_id") % 3
    texts = F.array(F.when(k == 2, "step 1 INCORRECT").otherwise("step 1 right"), F.when(k == 0, "step 2 right").otherwise("step 2: INCORRECT"))
    d = read(spark, sf_dir, "labels").withColumn("v", texts).withColumn("human", F.col("quality") == 1)
    return programs.graded(d, "v", "human").select("doc_id", "score", "agrees")


@query("SELECT CAST(o_custkey AS VARCHAR) AS example_id, 'dfs' AS algorithm, round(max(o_totalprice), 4) AS score FROM orders GROUP BY o_custkey")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search found in the form all searches share."""
    roots, up, _ = _order_levels(spark, sf_dir)
    found = search.dfs(roots, _by_level([up]), max_per_state=1, depth=1)
    return programs.as_result(found.where("rank = 1"), "dfs").select("example_id", "algorithm", F.round("score", 4).alias("score"))


# more composites


@query("SELECT CAST(o_orderkey AS VARCHAR) AS node_id, CAST(o_custkey AS VARCHAR) AS parent_id, o_orderpriority AS action FROM orders")
def read_tree_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees saved as gzipped JSON and read back as nodes."""
    path = folder(spark) + "/t"
    writers.compressed(nodes_to_json(spark, sf_dir).select("tree"), path)
    return readers.tree_logs(spark, path)


@query("SELECT 'q' || n_nationkey AS qid, n_name AS question, n_regionkey = 1 AS answer, CASE WHEN n_regionkey = 1 THEN 'yes' ELSE 'no' END AS gold FROM nation")
def read_strategy_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/s"
    row = F.struct(F.concat(F.lit("q"), "n_nationkey").alias("qid"), F.col("n_name").alias("question"), (F.col("n_regionkey") == 1).alias("answer"), F.lit("x").alias("extra"))
    read(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(row)).alias("value")).write.text(path)
    return readers.strategy_questions(spark, path)


@query("SELECT doc_id % 5 AS n_constraints, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS grounded, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS relevant FROM labels GROUP BY 1")
def flight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of grounded and relevant answers by the number of constraints."""
    d = read(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("n_constraints"), (F.col("quality") == 1).alias("grounded"), (F.col("toxic") == 0).alias("relevant"))
    return evaluate.flag_means(d, ["n_constraints"], ["grounded", "relevant"])


@query("""WITH s AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n >= 6 THEN 'max steps reached' ELSE 'response returned' END AS outcome, (CAST(contains(' ' || trim(regexp_replace(regexp_replace(lower(said), '[^a-z0-9à-ÿ]+', ' ', 'g'), ' +', ' ', 'g')) || ' ', ' of ') AS INTEGER) + CAST(contains(' ' || trim(regexp_replace(regexp_replace(lower(said), '[^a-z0-9à-ÿ]+', ' ', 'g'), ' +', ' ', 'g')) || ' ', ' zzz ') AS INTEGER)) / 2.0 AS recall FROM s""")
def fanout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sessions end, and the share of the asked entries that their text recalls."""
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("said"))
    return g.select("conv_id", extract.outcome(F.lit("fine"), F.col("n"), 6).alias("outcome"), judge.recalled(F.array(F.lit("of"), F.lit("zzz")), F.col("said")).alias("recall"))


REEVALUATED = """WITH t AS (SELECT o_custkey AS example_id, l_returnflag AS answer, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY w DESC, answer) = 1)"""


@query(REEVALUATED + " SELECT c_custkey AS example_id, a.answer, coalesce(a.answer = CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'N' END, false) AS correct FROM customer LEFT JOIN a ON a.example_id = c_custkey")
def reevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved trees, their terminals counted alike, judged against golds; customers without a tree are wrong."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    leaves = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("example_id"), F.col("l_returnflag").alias("answer"), F.col("l_extendedprice").alias("reward"))
    best = trees.best_answer(trees.answer_weights(leaves, "example_id", [], "answer", "reward", 1, "uniform"), "example_id", "answer")
    golds = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("example_id"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("N").alias("gold"))
    return evaluate.reevaluated(best, golds, "example_id", "answer", "gold", judge.same).select("example_id", "answer", "correct")


@query("""WITH l AS (SELECT lang, substr('ABCDE', CAST(n_chars % 5 AS INTEGER) + 1, 1) AS answer, count(*) AS votes, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT lang, answer, votes FROM l QUALIFY row_number() OVER (PARTITION BY lang ORDER BY votes DESC, first) = 1""")
def vote_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter most sampled answers give."""
    said = F.concat(F.lit("Thus the answer is ("), F.substr(F.lit("ABCDE"), (F.col("n_chars") % 5 + 1).cast("int"), F.lit(1)), F.lit(")."))
    d = _numbered(spark, sf_dir).select("lang", "doc_id", extract.choice_letter(said).alias("a"))
    return votes.majority(d, ["lang"], "a", "doc_id").select("lang", "answer", "votes")


@query("SELECT doc_id, 'Q: ' || lang || '?' AS asked, 'P one;two;' || source AS shown, 2::BIGINT AS n_steps, 'then ' || lang AS last_step FROM documents")
def prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled, few-shot prompts, and the steps of a written solution."""
    text = F.concat(F.lit("Plan. ## Step 1: first\n## Step 2: then "), "lang", F.lit("\n"))
    d = _numbered(spark, sf_dir).withColumn("s", extract.solution_steps(text))
    return d.select("doc_id", filled("Q: <q>?", q=F.col("lang")).alias("asked"), few_shot(["one;", "two;", "three;"], F.col("source"), 2, "P ").alias("shown"), F.size("s").cast("long").alias("n_steps"), F.element_at("s", -1).alias("last_step"))
