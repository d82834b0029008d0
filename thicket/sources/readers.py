"""Readers. Each gives a DataFrame of examples; nothing is pulled to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.storage import written

KEYED = "map<string,map<string,struct<question:string,query:string,chain_of_thought:array<string>,answer:string>>>"


def word_problems(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (question, answer with a gold marker) -> question, answer, gold."""
    from thicket.functions.extract import gold_answer

    d = spark.read.schema("question string, answer string").json(path)
    return d.withColumn("gold", gold_answer(F.col("answer")))


def multiple_choice(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (question, options, correct) -> question with its options on one line, correct, and the map of options that are numbers."""
    d = spark.read.schema("question string, options array<string>, correct string").json(path)
    letter = lambda o: F.substring(o, 1, 1)
    number = lambda o: F.regexp_extract(o, r"(-?[0-9][0-9,.]*)", 1)
    values = F.map_from_entries(F.transform(F.filter("options", lambda o: number(o) != ""), lambda o: F.struct(letter(o), F.translate(number(o), ",", "").try_cast("double"))))
    return d.select(F.concat("question", F.lit(" Options: "), F.array_join(F.transform("options", lambda o: F.regexp_replace(o, r"\)", ") ")), ", "), F.lit(".")).alias("question"), "correct", values.alias("option_values"))


def lettered_options(options: Column) -> Column:
    """Options as `A. text` lines."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(i + 65), F.lit(". "), o)), "\n")


def graph_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of graph questions, with the fields of the engine alone."""
    schema = "question string, answer string, steps array<string>, idx_to_symbol array<string>, edges array<array<int>>, root int, target int, neg_target int"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_examples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of objects: (example, part, question, query, chain_of_thought, answer), a row a part."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", KEYED).alias("m"))
    outer = whole.select(F.explode("m").alias("example", "parts"))
    return outer.select("example", F.explode("parts").alias("part", "v")).select("example", "part", "v.*")


def puzzles(spark: SparkSession, path: str, column: str = "Puzzles") -> DataFrame:
    """A CSV column of puzzles with the numbers of each."""
    d = spark.read.option("header", True).csv(path).select(F.col(column).alias("puzzle"))
    return d.withColumn("numbers", F.transform(F.split("puzzle", " "), lambda x: x.try_cast("int")))


def constrained_questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV of questions whose constraints are written as a list literal: the list as an array, and its stated size."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    items = F.regexp_extract_all("constraints", F.lit(r"'((?:[^'\\]|\\.)*)'"), F.lit(1))
    return d.select(F.col("num_constraints").cast("int").alias("num_constraints"), items.alias("constraints"), "question", F.col("seed_id").cast("int").alias("seed_id"))


def trajectories(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Session files, one JSON object each (or one a line, if not whole): goal, instance_id, steps, last action, error, result."""
    schema = "goal string, instance_id string, history array<array<string>>, is_complete boolean, error string, rewards array<double>, test_result double"
    d = spark.read.schema(schema).option("multiLine", whole).json(path)
    return d.select("goal", "instance_id", F.size("history").alias("n_steps"), F.get(F.element_at("history", -1), 1).alias("last_action"), "is_complete", "error", "test_result", F.input_file_name().alias("file"))


def log_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines `Case #n: correct=True, output='..', answer='..';accuracy=..` -> case, correct, output, answer, file."""
    line = F.col("value")
    return spark.read.text(path).where(line.rlike(r"^Case #\d+: correct=(True|False)")).select(
        F.regexp_extract(line, r"^Case #(\d+)", 1).cast("int").alias("case"),
        (F.regexp_extract(line, r"correct=(True|False)", 1) == "True").alias("correct"),
        F.regexp_extract(line, r"output=(?:'([^']*)'|None)", 1).alias("output"),
        F.regexp_extract(line, r"answer='([^']*)'", 1).alias("answer"),
        F.input_file_name().alias("file"),
    )


def numbered_files(results: DataFrame, start: int = 0, file: str = "file") -> DataFrame:
    """results whose file name is a number of at least `start`, with that number as `index`."""
    n = F.regexp_extract(file, r"/(\d+)\.[a-z]+$", 1).try_cast("int")
    return results.withColumn("index", n).where(F.col("index") >= start)


def ranged(examples: DataFrame, order: list[str], start: int = 0, end: int | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """Rows start to end (one past; negative: that many before the last) in order, or in a seeded shuffle of it, with `row` from 0.

    Rows are range-partitioned, numbered inside partitions and written, since another run may sample other bounds; one count a partition is gathered.
    """
    keys = order if shuffle_seed is None else ["_key"]
    d = examples if shuffle_seed is None else examples.withColumn("_key", F.xxhash64(F.lit(shuffle_seed), *order))
    d = written(d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts, total, starts = d.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect(), 0, []
    for r in sorted(counts):
        starts.append((r["_p"], total))
        total += r["n"]
    offsets = examples.sparkSession.createDataFrame(starts, "_p long, _start long")
    stop = total if end is None else total + end if end < 0 else end
    d = d.join(F.broadcast(offsets), part == F.col("_p")).withColumn("row", F.col("_start") + place)
    return d.where((F.col("row") >= start) & (F.col("row") < stop)).drop("_at", "_p", "_start", "_key")


def split_by_hash(examples: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """examples with `split`: each goes to a part in proportion to its share, by seeded hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    total, upto, out = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return examples.withColumn("split", out.otherwise(list(shares)[-1]))


def paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the texts of their paragraphs and list items, tags dropped."""
    raw = F.regexp_extract_all(html, F.lit(r"(?s)<(?:p|li)>(.*?)(?=<(?:p|li|/p|/li|/ul|/article)>)"), F.lit(1))
    return pages.withColumn("paragraphs", F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", " "))), lambda x: x != ""))


def planning_problems(spark: SparkSession, cases: str, folder: str, template: str) -> DataFrame:
    """planning_cases() of a JSON file of cases and a folder of problem files."""
    listed = spark.read.schema("instance_path string, plan string, n_steps int").json(cases)
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), "value")
    return planning_cases(listed, files, template)


def planning_cases(cases: DataFrame, files: DataFrame, template: str) -> DataFrame:
    """Planning cases (instance_path, plan, n_steps) with their problem files (_file, value), parsed: objects, init, goals, and the question that the template makes of them. Files that no case names are left out."""
    from thicket.operators import planning

    parsed = files.select("_file", planning.problem(F.col("value")).alias("_p"))
    j = cases.join(parsed, F.element_at(F.split("instance_path", "/"), -1) == F.col("_file"))
    return j.select("instance_path", "plan", "n_steps", "_p.*", planning.statement(F.lit(template), F.col("_p")).alias("question"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the top-level entries of simple YAML files, quotes dropped; nested lines belong to no entry."""
    line = F.col("value")
    kept = spark.read.text(path).where(line.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    value = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    return kept.select(F.regexp_extract(line, r"^([^:]*):", 1).alias("key"), F.regexp_replace(value, "^['\"](.*)['\"]$", "$1").alias("value"))


def tree_logs(spark: SparkSession, path: str) -> DataFrame:
    """Saved trees, a JSON array of nodes a line (gzipped or not): a row a node (node_id, parent_id, action)."""
    nodes = F.from_json("value", "array<struct<node_id:string,parent_id:string,action:string>>")
    return spark.read.text(path).select(F.explode(nodes).alias("n")).select("n.*")


def strategy_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of (qid, question, answer), the answer a boolean, with gold `yes` or `no`."""
    d = spark.read.schema("qid string, question string, answer boolean").json(path)
    return d.withColumn("gold", F.when(F.col("answer"), "yes").otherwise("no"))
