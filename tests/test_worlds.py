from pyspark.sql import Window
from pyspark.sql import functions as F

from thicket.functions import render, rewards
from thicket.operators import worlds


def one(spark, f, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {KINDS[k]}" for k in values))
    return d.select(f(**{k: F.col(k) for k in values}).alias("x")).first()["x"]


KINDS = {"s": "array<string>", "a": "string", "b": "string", "n": "array<double>", "u": "array<double>", "r": "double", "board": "array<string>", "slot": "string", "word": "string", "m": "map<string,int>"}


def test_terminals(spark):
    assert one(spark, lambda s, a: worlds.appended(s, a), s=["x"], a="y") == ["x", "y"]
    assert one(spark, lambda s: worlds.ends_by_phrase(s, "Now we can answer"), s=["a", "Now we can answer: b"]) is True
    assert one(spark, lambda s: worlds.ends_by_phrase(s, "x"), s=[]) is False
    assert one(spark, lambda a, b: worlds.ends_by_few_new_words(a, b), a="is it so", b="it is true") is True
    assert one(spark, lambda s: worlds.ends_by_box(s, F.lit(False)), s=[r"\boxed{3}"]) is True
    assert one(spark, lambda s: worlds.ends_by_line(s), s=["x", " return result "]) is True


def test_numbers(spark):
    assert one(spark, lambda a: worlds.numbers_left(a), a="1 + 2 = 3 (left: 3 3.5 8)") == [3.0, 3.5, 8.0]
    assert one(spark, lambda n, u, r: worlds.after_operation(n, u, r), n=[4.0, 4.0, 8.0], u=[4.0, 8.0], r=12.0) == [4.0, 12.0]
    assert one(spark, lambda n, u, r: worlds.after_operation(n, u, r), n=[4.0], u=[5.0], r=1.0) is None
    assert one(spark, lambda a: worlds.proposals(a), a="x\n1 left\ny") == ["1 left"]


def test_crosswords(spark):
    board = ["_"] * 25
    across = one(spark, lambda board, slot, word: worlds.placed(board, slot, word), board=board, slot="h2", word="apple")
    assert across[5:10] == list("APPLE") and across[:5] == ["_"] * 5
    down = one(spark, lambda board, slot, word: worlds.placed(board, slot, word), board=board, slot="v1", word="apple")
    assert down[::5] == list("APPLE")
    assert one(spark, lambda board: worlds.words_on(board), board=across)[1] == "APPLE"
    assert one(spark, lambda board, s: worlds.letters_right(board, s), board=across, s=across) == 1.0
    got = one(spark, lambda a: worlds.candidates(a), a="h1. apple (high)\nbad\nv3. Grape (low) x")
    assert [(c["slot"], c["word"], c["confidence"]) for c in got] == [("h1", "apple", 0.5), ("v3", "grape", 0.1)]
    status = one(spark, lambda s, board: worlds.word_status(s, board), s=["AB", "A_", "__"], board=["AC", "AB", "__"])
    assert status == [2, 1, 0]


def test_tools(spark):
    c = one(spark, lambda a: worlds.tool_call(a), a="Search[the moon]")
    assert (c["tool"], c["argument"]) == ("search", "the moon")
    assert one(spark, lambda a: worlds.calls_valid(a, ["click", "fill"]), a="click('1')\nfill('2', 'x')") is True
    assert one(spark, lambda a: worlds.calls_valid(a, ["click"]), a="exec('1')") is False


def test_render(spark):
    assert one(spark, lambda s: render.shortened_plans(s, 3), s=list("abcde")) == [list("abcde"), list("cde"), ["e"]]
    assert one(spark, lambda s, a: render.capped_with_final(s, a, 2), s=["x", "q", "y"], a="q") == ["x", "q"]
    assert one(spark, lambda s: render.claims(s), s=["a", "b", "c", "d"]) == "b\nc"
    assert one(spark, lambda a, s: render.with_definitions(a, s), a="aa bb aa", s=["aa"]) == "{{c1}} bb {{c1}}\n\nDefinitions:\n{{c1}}: aa"
    text = "\n".join(["[1] x"] + ["StaticText"] * 3 + ["end"])
    assert one(spark, lambda a: render.truncated_lines(a, "StaticText", 2, 10), a=text) == "[1] x\nStaticText\nStaticText\nend"
    assert one(spark, lambda a: render.sentences(a, F.lit("moon"), 1), a="A sun. The Moon is. A moon") == ["The Moon is"]
    assert one(spark, lambda a: render.computation(a), a="so <<3+4=") == "3+4" and one(spark, lambda a: render.computation(a), a="<<import=") is None
    r = one(spark, lambda a: render.thought_action(a), a="think ```click(1)")
    assert (r["thought"], r["action"]) == ("think", "click(1)")
    assert one(spark, lambda a: render.stamped_name(a), a="x/job_2024-10-02-11-12-13.json").hour == 11
    assert one(spark, lambda m: render.stringified(m.cast("map<string,string>"), "map"), m={"a": 1}) == "a: 1"


def test_rewards(spark):
    assert one(spark, lambda s: rewards.verdicts(s, F.lit(1), 3), s=["it is sure", "likely", "hm"]) == 1.1
    assert one(spark, lambda m: rewards.rubric(m), m={"a": 4, "b": 5}) == 4.5 and one(spark, lambda m: rewards.rubric(m), m={}) == 0.0
    assert one(spark, lambda m: rewards.perfect(m), m={"a": 5}) is True
    assert one(spark, lambda r: rewards.decomposed(r), r=0.3) == 0.3
    assert one(spark, lambda r: rewards.at_leaf(r, F.lit(2), 3), r=0.3) == 0.0
    d = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 0.0)], "g int, lm double, disc double")
    got = [r["x"] for r in d.select(rewards.discriminated(F.col("lm"), F.col("disc"), Window.partitionBy("g"), 0.5).alias("x")).collect()]
    assert all(abs(x - 0.5) < 1e-9 for x in got)
