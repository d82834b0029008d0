import json
import time

import pytest
from pyspark.sql import functions as F

from thicket.sources import readers, writers
from thicket.streaming import guards


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"question": "q", "answer": "x #### 1,000"}) + "\n")
    assert readers.word_problems(spark, str(tmp_path / "a.jsonl")).first()["gold"] == "1000"
    (tmp_path / "m.jsonl").write_text(json.dumps({"question": "q", "options": ["A)5", "B)x"], "correct": "A"}) + "\n")
    r = readers.multiple_choice(spark, str(tmp_path / "m.jsonl")).first()
    assert r["question"] == "q Options: A) 5, B) x." and r["option_values"] == {"A": 5.0}
    (tmp_path / "k.json").write_text(json.dumps({"e1": {"test_example": {"question": "q", "query": "y", "chain_of_thought": ["c"], "answer": "True"}}}))
    assert readers.keyed_examples(spark, str(tmp_path / "k.json")).first()["part"] == "test_example"
    (tmp_path / "p.csv").write_text("Rank,Puzzles\n1,1 2 3 4\n")
    assert readers.puzzles(spark, str(tmp_path / "p.csv")).first()["numbers"] == [1, 2, 3, 4]
    (tmp_path / "7.log").write_text("Case #1: correct=True, output='5', answer='5';accuracy=1.0 (1/1)\nnoise\nCase #2: correct=False, output=None, answer='6';accuracy=0.5 (1/2)\n")
    got = readers.numbered_files(readers.log_results(spark, str(tmp_path / "7.log"))).orderBy("case").collect()
    assert [(x["case"], x["correct"], x["output"], x["index"]) for x in got] == [(1, True, "5", 7), (2, False, "", 7)]


def test_ranged_where_bounds_are_sampled(spark):
    """More rows than a range partitioning samples whole, and partitions that stay apart: two runs of it have other bounds."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        _sampled(spark)
    finally:
        spark.conf.set(key, before)


def _sampled(spark):
    d = spark.range(300_000).select((F.col("id") * 7 % 300_000).alias("id")).repartition(7)
    r = readers.ranged(d, ["id"], 20, -10)
    assert tuple(r.agg(F.count("*"), F.countDistinct("row"), F.min("row"), F.max("row"), F.sum((F.col("row") != F.col("id")).cast("int"))).first()) == (299_970, 299_970, 20, 299_989, 0)


def test_ranged(spark):
    d = spark.range(100).repartition(7)
    assert [r["id"] for r in readers.ranged(d, ["id"], 10, 13).orderBy("row").collect()] == [10, 11, 12]
    assert readers.ranged(d, ["id"], 0, -1).count() == 99
    a, b = (readers.ranged(d, ["id"], 0, 5, shuffle_seed=1).orderBy("row").collect() for _ in range(2))
    assert a == b and [r["id"] for r in a] != [0, 1, 2, 3, 4]


def test_split(spark):
    n = {r["split"]: r["count"] for r in readers.split_by_hash(spark.range(1000), "id", {"train": 8, "test": 2}).groupBy("split").count().collect()}
    assert sum(n.values()) == 1000 and 700 < n["train"] < 900


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, True, "5", "5"), (2, False, None, "6")], "case int, correct boolean, output string, answer string")
    p = str(tmp_path / "r")
    writers.append_results(d, p, "a")
    writers.replace_run(d.where("case = 1"), p, "b")
    writers.replace_run(d.where("case = 2"), p, "b")
    assert spark.read.parquet(p).groupBy("run_id").count().count() == 2 and spark.read.parquet(p).count() == 3
    lines = [r["value"] for r in writers.log_lines(d, "case", "correct", "output", "answer").orderBy("value").collect()]
    assert lines == ["Case #1: correct=True, output='5', answer='5'", "Case #2: correct=False, output=None, answer='6'"]
    s = spark.sql("select struct(struct(1 as c) as b) as a")
    assert writers.updated(s, "a.b.c", F.lit(2)).first()["a"]["b"]["c"] == 2


def test_streaming_guards(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema("user string, n int, action string").json(str(src))
    q = guards.guarded(stream, "user", "n", "action", ("scroll",), max_repeats=2, max_steps=4).writeStream.format("memory").queryName("guards").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, actions in enumerate((["a", "a"], ["a", "error", "scroll"])):
            (src / f"{k}.json").write_text("".join(json.dumps({"user": "u", "n": k * 10 + i, "action": a}) + "\n" for i, a in enumerate(actions)))
            q.processAllAvailable()
            time.sleep(0.1)
        rows = spark.sql("select * from guards order by step").collect()
    finally:
        q.stop()
    assert [r["repeats"] for r in rows] == [0, 1, 2, 0, 0] and [r["repeat_tripped"] for r in rows] == [False, False, True, False, False]
    assert rows[-1]["cut_off"] and rows[3]["errors"] == 1


def test_prompts_in_blocks(spark):
    from thicket.operators import evaluate

    prompts = spark.range(5)
    questions = spark.range(6).withColumnRenamed("id", "q")
    right = F.col("q") % (F.col("id") + 1) == 0
    want = {p: (6, round(sum(q % (p + 1) == 0 for q in range(6)) / 6, 6)) for p in range(5)}
    for at_once in (1, 2, 100):
        got = evaluate.prompt_accuracy(prompts, questions, "id", right, at_once=at_once).collect()
        assert {r["prompt"]: (r["n"], r["accuracy"]) for r in got} == want
