from pyspark.sql import functions as F

from thicket.functions import extract, judge, score


def one(spark, f, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(f(*cols).alias("x")).first()["x"]


def test_final_number(spark):
    f = lambda t: one(spark, extract.final_number, t)
    assert f("So. The answer is $1,234.") == "1234"
    assert f("The answer is 3 = 7.") == "7"
    assert f("first\nThe answer is 5.") is None  # the first line alone
    assert f("no answer") is None
    assert one(spark, lambda t: extract.final_number(t, "answer_number_dotall"), "first\nthe answer is 5.") == "5"


def test_gold_and_marks(spark):
    assert one(spark, extract.gold_answer, "a #### 1\nb #### 2,000") == "2000"
    assert one(spark, extract.gold_answer, "none") is None
    assert one(spark, extract.marked_number, "x #### -1,5") == "-15"
    assert one(spark, extract.marked_number, "x") == "[invalid]"


def test_letters(spark):
    assert one(spark, extract.choice_letter, "x\nthe answer is (B).") == "B"
    assert one(spark, lambda t: extract.choice_letter(t, True), "The answer is C") == "C"
    assert one(spark, extract.choice_tag, "<answer> D. text</answer>") == "D"
    assert one(spark, extract.choice_tag, "<answer> D </answer>") == "D"
    assert one(spark, extract.last_choice, "A or B, so E!") == "E"


def test_yes_no(spark):
    assert one(spark, extract.yes_no, "So the answer is yes.\nmore") == "yes"
    assert one(spark, extract.yes_no, "it is not so") == "no"
    assert one(spark, extract.yes_no, "hm") == ""
    assert one(spark, extract.parsed_answer, "the answer is Yes") == "yes"
    assert one(spark, extract.parsed_answer, "that is true") == "yes"


def test_boxed(spark):
    assert one(spark, extract.boxed, r"so \boxed{\frac{1}{2}} it is") == r"\frac{1}{2}"
    assert one(spark, extract.boxed, r"\boxed{1} and \boxed{2}") == "2"
    assert one(spark, extract.boxed, r"\boxed{1") is None
    assert one(spark, extract.boxed, "none") is None


def test_tags(spark):
    v = one(spark, lambda t: extract.validated_tags(t, ["a", "b"]), "<a>1</a><b>2</b><b>3</b>")
    assert v["value"]["a"] == "1" and not v["valid"] and v["message"] == "several b"
    assert one(spark, extract.fenced, "x ```py\nclick(1)``` y") == "click(1)"
    assert one(spark, extract.json_score, 'so {"score": 7}') == 0.7
    assert one(spark, extract.sub_questions, "1. Who? 2. What?") == ["Who?", "What?"]
    assert one(spark, extract.so_steps, "A. So b is c. So d") == "b is c\nd"


def test_normalised(spark):
    assert one(spark, extract.normalised, "The  Cat, a dog!") == "cat dog"
    assert one(spark, extract.spelled_number, "1,200") == 1200
    assert one(spark, extract.spelled_number, "50%") == 0.5


def test_ladder(spark):
    j = lambda a, b: one(spark, judge.numeric_ladder, a, b)
    assert j("12", "12.0") and j("1e3", "1000") and not j("x", "y") and j("x", "x")
    assert spark.sql("select cast(null as string) a, '1' b").select(judge.numeric_ladder(F.col("a"), F.col("b")).alias("x")).first()["x"] is False


def test_maths_equal(spark):
    j = lambda a, b: one(spark, judge.maths_equal, a, b)
    assert j("(1, 2)", "[1,2.0]") and j("50", "0.5") and j("x", "X") and not j("1", "2") and not j("(1,2)", "(2,1)")


def test_arithmetic(spark):
    assert judge.arithmetic("(1+2)*8") == 24 and judge.arithmetic("__import__('os')") is None and judge.arithmetic("1/0") is None
    assert one(spark, judge.makes_target, "1 2 8 1", "(1+2)*8*1=24") and not one(spark, judge.makes_target, "1 2 8 3", "(1+2)*8*1=24")


def test_recalled(spark):
    d = spark.createDataFrame([(["the cat", "dog", None], "A Cat!"), ([], "x")], "r array<string>, t string")
    assert [r["x"] for r in d.select(judge.recalled(F.col("r"), F.col("t")).alias("x")).collect()] == [0.5, None]


def test_scores(spark):
    assert abs(one(spark, lambda a, b: score.geometric(a, b), 0.25, 1.0) - 0.5) < 1e-9
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    r = d.select(score.cosine(F.col("a"), F.col("b")).alias("c"), score.aggregated(F.col("b"), "mean").alias("m"), score.shrunk_mean(F.col("b")).alias("s")).first()
    assert abs(r["c"] - 0.5**0.5) < 1e-9 and r["m"] == 1 and abs(r["s"] - 2 / 3) < 1e-9


def test_maths_forms(spark):
    from thicket.functions import maths

    forms = {r"\frac12": r"\frac{1}{2}", r"\dfrac{1}{2}": r"\frac{1}{2}", "1/2": r"\frac{1}{2}", "5 miles": "5", "10 square feet": "10", "x=5.00": "5", "twenty-one": "21", r"\sqrt3": r"\sqrt{3}", r"5\text{ cm}": "5", ".5": "0.5", "feet": "feet", "$12$": "12", "7\\%": "7"}
    d = spark.createDataFrame([(k, v) for k, v in forms.items()] + [(None, None)], "a string, want string")
    assert [tuple(r) for r in d.select("a", "want", maths.normal_form(F.col("a")).alias("f")).where("not f <=> want").collect()] == []
    pairs = [(r"\frac{1}{2}", "0.5", True), ("(1, 2)", r"\left(1,2\right)", True), ("(1,3)", "(1,2)", False), ("the answer is (B)", "B", True), ("0.07", "7%", True), (r"\begin{bmatrix}1&2\\3&4\end{bmatrix}", r"\begin{pmatrix} 1 & 2 \\ 3 & 4.0 \end{pmatrix}", True), (None, "5", False), ("6", "5", False), (r"-\frac{3}{4}", "-3/4", True)]
    d = spark.createDataFrame(pairs, "a string, g string, want boolean")
    assert d.where(judge.maths_equal(F.col("a"), F.col("g")) != F.col("want")).collect() == []
