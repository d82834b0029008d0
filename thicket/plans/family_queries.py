"""Families of rules over texts and numbers built from the driver tables: extractors, judges, rewards, world models, rendering. Each input is one SQL text that Spark and DuckDB both read; each rule is a Column function here and SQL of its own in the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import extract, judge, maths, render, rewards, score
from thicket.operators import planning, programs, worlds
from thicket.plans.tables import read

QUERIES, ORACLES = {}, {}


def family(name: str, tables: list[str], source: str, keys: list[str], rules: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """Registers a query: `keys` and the rules' columns over the rows of `source`, a SELECT that names its tables in braces; sql: each rule in DuckDB's terms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark.sql(source, **{t: read(spark, sf_dir, t) for t in tables})
        return d.select(*keys, *[c.alias(k) for k, c in rules().items()])

    QUERIES[name] = run
    plain = source.format(**{t: t for t in tables})
    ORACLES[name] = f"WITH t AS ({plain}) SELECT {', '.join([*keys, *[f'{x} AS {k}' for k, x in sql.items()]])} FROM t"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _match(text: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches({text}, {_q(pattern)}) THEN regexp_extract({text}, {_q(pattern)}, {group}) END"


def _drop(text: str, chars: str) -> str:
    return f"translate({text}, {_q(chars)}, '')"


REPLIES = """SELECT doc_id, CASE doc_id % 9
  WHEN 0 THEN 'So 3 + 4 = 7. The answer is 1 + 2 = $' || CAST(n_chars AS STRING) || ',5.' || chr(10) || 'So the answer is yes.'
  WHEN 1 THEN 'Hence the answer is (' || substr('ABCDE', CAST(doc_id % 5 AS INT) + 1, 1) || ') as said.' || chr(10) || '#### ' || CAST(n_chars AS STRING)
  WHEN 2 THEN '<answer> ' || substr('ABCDE', CAST(doc_id % 5 AS INT) + 1, 1) || '. of all </answer> Finish[' || lang || ' it is]'
  WHEN 3 THEN 'This is not it. No way.' || chr(10) || 'Answer: ' || source || chr(10) || '#### abc'
  WHEN 4 THEN 'We get ' || chr(92) || 'boxed{{' || chr(92) || 'frac{{1}}{{' || CAST(n_chars AS STRING) || '}}}} and A or C'
  WHEN 5 THEN 'So the answer is ' || lang || '.'
  WHEN 6 THEN 'The answer is true' || chr(10) || '#### 1,234.5'
  WHEN 7 THEN 'The answer is ' || CAST(n_chars AS STRING) || ' - 3.' || chr(10) || 'then 8 more'
  ELSE source END AS text FROM {documents}"""


def _forms() -> dict[str, Column]:
    t = F.col("text")
    return {
        "final_number": extract.final_number(t),
        "final_dotall": extract.final_number(t, "answer_number_dotall"),
        "gold": extract.gold_answer(t),
        "marked": extract.marked_number(t),
        "letters": extract.lettered_gold(t),
        "letter_strict": extract.choice_letter(t, True),
        "letter_loose": extract.choice_letter(t),
        "tag": extract.choice_tag(t),
        "last_choice": extract.last_choice(t),
        "yes_no": extract.yes_no(t),
        "parsed": extract.parsed_answer(t),
        "labelled": extract.labelled_answer(t),
        "free": extract.free_answer(t),
        "closed": extract.closed_answer(t),
        "finished": extract.finished(t),
        "wide": extract.wide_answer(t),
        "last_number": extract.last_number(t),
        "boxed": extract.boxed(t),
        "maths_choice": maths.choice(t),
    }


def _forms_sql() -> dict[str, str]:
    p = extract.PATTERNS
    tail = "regexp_extract(text, '(?s).*So the answer is(.*)$', 1)"
    neg = "contains(text, ' not ') OR contains(text, ' no ') OR contains(text, 'Not ') OR contains(text, 'No ')"
    number = lambda k: f"string_split({_drop(_match('text', p[k]), ', $')}, '=')[-1]"
    low = "lower(text)"
    return {
        "final_number": number("answer_number"),
        "final_dotall": number("answer_number_dotall"),
        "gold": f"CASE WHEN contains(text, '#### ') AND NOT contains(string_split(text, '#### ')[-1], chr(10)) THEN {_drop("string_split(text, '#### ')[-1]", ', ')} END",
        "marked": f"coalesce(replace({_match('text', p['gold_number'])}, ',', ''), '[invalid]')",
        "letters": _match("text", p["gold_letters"]),
        "letter_strict": _match("text", p["letter_strict"]),
        "letter_loose": _match("text", p["letter_loose"]),
        "tag": "coalesce(" + ", ".join(_match("text", x) for x in extract.CHOICE_TAGS) + ")",
        "last_choice": r"(regexp_extract_all(text, '\b([A-E])\b', 1))[-1]",
        "yes_no": f"CASE WHEN contains(text, 'So the answer is') THEN trim(replace(string_split({tail}, chr(10))[1], '.', '')) WHEN {neg} THEN 'no' ELSE '' END",
        "parsed": f"CASE WHEN regexp_matches(text, {_q(p['answer_word'])}) THEN lower(regexp_extract(text, {_q(p['answer_word'])}, 1)) WHEN contains({low}, 'yes') OR contains({low}, 'true') THEN 'yes' WHEN contains({low}, 'no') OR contains({low}, 'false') THEN 'no' ELSE '' END",
        "labelled": f"coalesce(nullif({_match('text', p['answer_label'])}, ''), text)",
        "free": _match("text", p["answer_free"]),
        "closed": _match("text", p["answer_closed"]),
        "finished": _match("text", p["finish"]),
        "wide": _drop(_match("text", r"(?s)^.*[Tt]he answer is .*?([ $.0-9,\-=A-Za-z/]+)\."), ", $"),
        "last_number": f"(regexp_extract_all(text, {_q(p['number'])}))[-1]",
        "boxed": r"(regexp_extract_all(text, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1))[-1]",
        "maths_choice": "coalesce(upper(nullif(regexp_extract(lower(replace(string_split(text, 'Problem:')[1], 'choice is', 'answer is')), 'answer is \\(?([abcde])\\)?', 1), '')), 'placeholder')",
    }


family("answer_forms", ["documents"], REPLIES, ["doc_id"], _forms, _forms_sql())
family("rule_extractors", ["conversations"], "SELECT conv_id, turn, text FROM {conversations}", ["conv_id", "turn"], _forms, _forms_sql())

BLOCKS = """SELECT doc_id, lang, 'First. So one is ' || lang || '. So two is ' || source || '. End. ```python' || chr(10) || 'x = ' || CAST(n_chars AS STRING) || '```'
  || ' {{"score": ' || CAST(doc_id % 11 AS STRING) || '}} <START>' || lang || '<END> and <START>' || source || '<END> 1. What is ' || lang || '? 2. Who?' AS text,
  'Tom has <<3*' || CAST(doc_id % 7 AS STRING) || '=' || CAST(3 * (doc_id % 7) AS STRING) || '>>' || CAST(3 * (doc_id % 7) AS STRING) || ' apples, and more. how many are left in ' || lang || '?' AS problem,
  'body of ' || source || chr(10) || 'Confidence score: 0.' || CAST(1 + doc_id % 9 AS STRING) AS judged,
  'click(' || chr(39) || 'a' || chr(92) || 'n' || lang || chr(39) || ')' AS call,
  'think: a: b' || chr(10) || 'act: ' || lang AS yaml,
  'The ' || upper(lang) || ', 1,' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || ' an  apple! ' || CASE WHEN doc_id % 3 = 0 THEN 'May' ELSE 'mayor' END AS entry,
  CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS STRING) || ',000' WHEN 1 THEN '12%' WHEN 2 THEN lang ELSE '-7.5' END AS spelled FROM {documents}"""


def _blocks() -> dict[str, Column]:
    t = F.col("text")
    return {
        "so_steps": extract.so_steps(t),
        "chain": F.array_join(extract.gold_chain(F.split(t, " ")), ","),
        "fenced": extract.fenced(t),
        "json_score": extract.json_score(t),
        "prompts": F.array_join(extract.prompts_between(t), ","),
        "sub_questions": F.array_join(extract.sub_questions(t), "|"),
        "without_computations": extract.without_computations(F.col("problem")),
        "overall": extract.overall_question(F.col("problem")),
        "body": extract.confidence_section(F.col("judged"))["body"],
        "confidence": extract.confidence_section(F.col("judged"))["score"],
        "argument": extract.unescaped_argument(F.col("call")),
        "cleaned_call": extract.unescaped(F.col("call")),
        "repaired": extract.repaired_yaml(F.col("yaml")),
        "yaml_think": extract.yaml_field(F.col("yaml"), "think"),
        "yaml_act": extract.yaml_field(F.col("yaml"), "act"),
        "normalised": extract.normalised(F.col("entry")),
        "plain_entry": extract.plain_entry(F.col("entry")),
        "allowed": extract.without_banned(F.col("entry"), ["may", "june"]),
        "digits": extract.spelled_number(F.col("spelled")),
        "valid_tags": extract.validated_tags(F.regexp_replace(t, "START|END", "a"), ["a"])["valid"],
        "tag_trouble": extract.validated_tags(F.concat(F.lit("<k>"), "lang", F.lit("</k>")), ["k", "z"])["message"],
    }


def _blocks_sql() -> dict[str, str]:
    normal = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(entry), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"
    return {
        "so_steps": "array_to_string(list_transform(list_filter(string_split(text, '. '), lambda s: contains(s, 'So ')), lambda s: string_split(s, 'So ')[-1]), chr(10))",
        "chain": "array_to_string(list_filter(string_split(text, ' '), lambda x, i: i >= 3 AND i % 2 = 1), ',')",
        "fenced": "'x = ' || regexp_extract(text, 'x = ([0-9]+)', 1)",
        "json_score": "CAST(doc_id % 11 AS DOUBLE) / 10",
        "prompts": "array_to_string(regexp_extract_all(text, '(?s)<START>(.*?)<END>', 1), ',')",
        "sub_questions": "'What is ' || lang || '?|Who?'",
        "without_computations": "regexp_replace(problem, '<<.*?>>', '', 'g')",
        "overall": "'How many are left in ' || lang || '?'",
        "body": "trim(string_split(judged, 'Confidence score')[1], ' ' || chr(10))",
        "confidence": "CAST('0.' || (1 + doc_id % 9) AS DOUBLE)",
        "argument": "'a' || chr(10) || lang",
        "cleaned_call": "replace(call, chr(92) || 'n', chr(10))",
        "repaired": "'think: ' || chr(39) || 'a: b' || chr(39) || chr(10) || 'act: ' || lang",
        "yaml_think": "'a: b'",
        "yaml_act": "lang",
        "normalised": normal,
        "plain_entry": "trim(regexp_replace(regexp_replace(regexp_replace(lower(entry), '([0-9]),([0-9])', '\\1\\2', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))",
        "allowed": "doc_id % 3 <> 0",
        "digits": "CASE doc_id % 4 WHEN 0 THEN CAST(replace(spelled, ',', '') AS DOUBLE) WHEN 1 THEN 0.12 WHEN 3 THEN -7.5 END",
        "valid_tags": "false",
        "tag_trouble": "'missing z'",
    }


family("text_blocks", ["documents"], BLOCKS, ["doc_id"], _blocks, _blocks_sql())

FORMS_OF_NUMBERS = """SELECT doc_id, lang, CASE doc_id % 10
  WHEN 0 THEN chr(92) || 'frac1' || CAST(2 + doc_id % 8 AS STRING) WHEN 1 THEN CAST(n_chars AS STRING) || ' miles' WHEN 2 THEN 'x=' || CAST(n_chars AS STRING) || '.00'
  WHEN 3 THEN chr(92) || 'dfrac{{1}}{{' || CAST(n_chars AS STRING) || '}}' WHEN 4 THEN '(1, ' || CAST(n_chars AS STRING) || ')' WHEN 5 THEN 'twenty-one' WHEN 6 THEN CAST(doc_id AS STRING) || '/' || CAST(n_chars AS STRING)
  WHEN 7 THEN '$' || CAST(n_chars AS STRING) || '$' WHEN 8 THEN chr(92) || 'sqrt' || CAST(n_chars AS STRING) ELSE '25^{{' || chr(92) || 'circ}}.' END AS answer FROM {documents}"""


def _maths() -> dict[str, Column]:
    a = F.col("answer")
    gold = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("1/"), (2 + F.col("doc_id") % 8).cast("string"))).when(F.col("doc_id") % 10 == 4, F.regexp_replace(a, " ", "")).when(F.col("doc_id") % 10 == 5, "21").otherwise("0")
    return {
        "form": maths.normal_form(a),
        "value": F.round(maths.fraction_value(maths.normal_form(a)), 9),
        "equal": judge.maths_equal(a, gold),
        "same_row": judge.maths_equal(a, a),
    }


def _maths_sql() -> dict[str, str]:
    n = "regexp_extract(answer, '([0-9]+)[^0-9]*$', 1)"
    return {
        "form": maths.sql("answer"),
        "value": f"round(CASE doc_id % 10 WHEN 0 THEN 1.0 / (2 + doc_id % 8) WHEN 1 THEN CAST({n} AS DOUBLE) WHEN 2 THEN CAST(regexp_extract(answer, '=([0-9]+)', 1) AS DOUBLE) WHEN 3 THEN 1.0 / CAST({n} AS DOUBLE) WHEN 5 THEN 21 WHEN 6 THEN CAST(doc_id AS DOUBLE) / CAST({n} AS DOUBLE) WHEN 7 THEN CAST({n} AS DOUBLE) WHEN 9 THEN 25 END, 9)",
        "equal": "doc_id % 10 IN (0, 4, 5)",
        "same_row": "true",
    }


family("maths_forms", ["documents"], FORMS_OF_NUMBERS, ["doc_id"], _maths, _maths_sql())

ANSWERS = """SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN CAST(n_chars AS STRING) || '.0' WHEN doc_id % 5 = 2 THEN upper(lang) WHEN doc_id % 5 = 3 THEN 'The ' || lang || '!' ELSE '1e3' END AS answer,
  CASE WHEN doc_id % 5 = 1 THEN CAST(n_chars AS STRING) WHEN doc_id % 5 = 4 THEN '1000' ELSE lang END AS gold, doc_id % 2 = 0 AS flag, CASE doc_id % 3 WHEN 0 THEN 'Yes ' WHEN 1 THEN 'no' ELSE lang END AS said,
  CAST(doc_id % 10 AS DOUBLE) + 0.00005 AS x, CAST(doc_id % 10 AS DOUBLE) AS y, '10^' || CAST(doc_id % 3 AS STRING) || ' m' AS unit,
  CASE doc_id % 3 WHEN 0 THEN '(4 + 4) * 3 * 1 = 24' WHEN 1 THEN '4 * 4 + 3 + 1 = 20' ELSE '8 * 3 = 24' END AS equation, '4 4 3 1' AS puzzle, 'an ' || lang || ' text of ' || source AS passage, source FROM {documents}"""


def _judges() -> dict[str, Column]:
    a, g = F.col("answer"), F.col("gold")
    xs, ys = F.col("x").cast("string"), F.col("y").cast("string")
    return {
        "numeric": judge.numeric_ladder(a, g),
        "folded": judge.same_fold(a, g),
        "exact": judge.same(a, g),
        "normal": judge.exact_normalised(a, g),
        "yes_no": judge.yes_no_is(F.col("said"), F.col("flag")),
        "within": judge.within(xs, ys),
        "within_relative": judge.within(xs, ys, relative=1e-5),
        "quasi": judge.quasi_equal(xs, F.lit("5"), F.col("unit")),
        "makes_24": judge.makes_target(F.col("puzzle"), F.col("equation")),
        "calculated": judge.calculated(F.substring_index("equation", "=", 1)),
        "recalled": judge.recalled(F.array("lang", F.lit(None), F.lit("missing thing"), F.lit("text of")), F.col("passage")),
        "same_multiset": judge.same_multiset(F.array("lang", "source"), F.array("source", F.lit("en"))),
    }


def _judges_sql() -> dict[str, str]:
    return {
        "numeric": "doc_id % 5 IN (1, 4)",
        "folded": "doc_id % 5 = 2",
        "exact": "coalesce(answer = gold, false)",
        "normal": "doc_id % 5 IN (2, 3)",
        "yes_no": "CASE doc_id % 3 WHEN 0 THEN flag WHEN 1 THEN NOT flag END",
        "within": "true",
        "within_relative": "abs(x - y) <= 1e-5 * greatest(abs(x), abs(y))",
        "quasi": "abs(x - 5) <= 0.15 OR abs(x - 5 * pow(10.0, doc_id % 3)) <= 0.15 * pow(10.0, doc_id % 3)",
        "makes_24": "doc_id % 3 = 0",
        "calculated": "CASE doc_id % 3 WHEN 1 THEN 20 ELSE 24 END::DOUBLE",
        "recalled": "2.0 / 3",
        "same_multiset": "lang = 'en'",
    }


family("judge_rules", ["documents"], ANSWERS, ["doc_id"], _judges, _judges_sql())

STEPS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount AS d, l_tax AS t, l_quantity AS q, 1 - l_discount AS c, l_linenumber % 7 AS depth, l_returnflag AS flag FROM {lineitem}"""
STEP_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _rewards() -> dict[str, Column]:
    c = F.col
    r = lambda x: F.round(x, 6)
    scores = F.create_map(F.lit("a"), c("depth"), F.lit("b"), F.lit(5))
    words = F.array(F.lit("maybe SURE"), F.when(c("flag") == "A", "it is likely").otherwise("impossible"), F.lit(""))
    return {
        "nothing": rewards.nothing(),
        "useful": r(rewards.usefulness(c("c"), c("t") + 0.5)),
        "useful_before": r(rewards.usefulness(c("c"), None, 0.25)),
        "decomposed": r(rewards.decomposed(c("c"), 0.5)),
        "planned": r(rewards.planned(c("d"), c("t"), F.when(c("flag") == "A", 1.0).otherwise(c("c")))),
        "intuitive": r(rewards.intuitive(c("d"), c("t"))),
        "intuitive_share": r(rewards.intuitive(c("d"), c("t"), 0.3)),
        "verdicts": r(rewards.verdicts(words, c("depth"), 4)),
        "chain": r(rewards.step_probability(F.array(F.ln("c"), F.ln(F.lit(0.5))), F.array("q", F.lit(1.0)), F.array("c", "c"))),
        "process": r(rewards.process(F.ln("c"))),
        "rubric": r(rewards.rubric(scores)),
        "rubric_sum": r(rewards.rubric(scores, True)),
        "perfect": rewards.perfect(scores),
        "environment": r(rewards.environment(c("d"), c("t"))),
        "at_leaf": r(rewards.at_leaf(c("c"), c("depth"), 3)),
        "temperature": r(rewards.temperature(0.7, 0.9, c("depth"))),
        "logical": r(rewards.logical(c("d"), c("c"), c("t"))),
        "outcome": r(rewards.outcome(F.when(c("flag") != "N", c("c")))),
        "chosen": rewards.chosen_step(F.array(F.struct(F.lit("a").alias("s"), c("d").alias("score")), F.struct(F.lit("b").alias("s"), c("t").alias("score"))))["s"],
        "shrunk": r(score.shrunk_mean(F.array("d", "t"))),
        "path_max": r(score.aggregated(F.array("d", "t"), "max")),
        "path_last": r(score.aggregated(F.array("d", "t"), "last")),
        "path_mean": r(score.aggregated(F.array("d", "t"), "mean")),
        "sequence": r(score.sequence_probability(F.array(F.ln("c"), F.ln("c")))),
        "first_token": r(extract.first_token_confidence(F.array(F.struct(F.lit(" Yes").alias("token"), F.ln("c").alias("log_prob")), F.struct(F.lit("no").alias("token"), F.lit(0.0).alias("log_prob"))), ["yes"])),
    }


def _rewards_sql() -> dict[str, str]:
    return {
        "nothing": "0.0::DOUBLE",
        "useful": "round(sqrt(c) * sqrt(t + 0.5), 6)",
        "useful_before": "round(pow(c, 0.25) * pow(0.8, 0.75), 6)",
        "decomposed": "round(sqrt(c), 6)",
        "planned": "round((d + t) * 0.5 + CASE WHEN flag = 'A' OR c = 1 THEN 100.0 ELSE c END * 0.5, 6)",
        "intuitive": "round(d + t, 6)",
        "intuitive_share": "round(0.3 * d + 0.7 * t, 6)",
        "verdicts": "round(CASE WHEN depth > 4 THEN 0.0 WHEN flag = 'A' THEN 1.1 ELSE 1.0001 END::DOUBLE, 6)",
        "chain": "round(sqrt(exp((ln(c) + ln(0.5)) / (q + 1))) * sqrt(c * c), 6)",
        "process": "round(c, 6)",
        "rubric": "round((depth + 5) / 2.0, 6)",
        "rubric_sum": "round(depth + 5.0, 6)::DOUBLE",
        "perfect": "depth = 5",
        "environment": "round(d + 100 * t, 6)",
        "at_leaf": "round(CASE WHEN depth = 3 THEN c ELSE 0.0 END, 6)",
        "temperature": "round(0.7 * pow(0.9, depth), 6)",
        "logical": "round(0.5 * d + 0.5 * exp(c) / (exp(c) + exp(t)), 6)",
        "outcome": "round(CASE WHEN flag <> 'N' THEN c ELSE 0.0 END, 6)",
        "chosen": "CASE WHEN t > d THEN 'b' ELSE 'a' END",
        "shrunk": "round((d + t) / 3, 6)",
        "path_max": "round(greatest(d, t), 6)",
        "path_last": "round(t, 6)",
        "path_mean": "round((d + t) / 2, 6)",
        "sequence": "round(c * c, 6)",
        "first_token": "round(c, 6)",
    }


family("reward_rules", ["lineitem"], STEPS, STEP_KEYS, _rewards, _rewards_sql())

STATES = """SELECT doc_id, lang, source, n_chars, CAST(doc_id % 6 AS INT) AS n, CASE doc_id % 4 WHEN 0 THEN 'Now we can answer ' || lang WHEN 1 THEN '[PLAN END]' WHEN 2 THEN 'return result' ELSE 'The answer is ' || chr(92) || 'boxed{{' || lang || '}}.' END AS step FROM {documents}"""


def _worlds() -> dict[str, Column]:
    c = F.col
    state = F.array(F.lit("start"), c("step"))
    answered = worlds.answered(F.array().cast("array<struct<sub_question:string,sub_answer:string,confidence:double>>"), c("lang"), c("source"), c("n") / 10)
    buffered = lambda b: worlds.buffered(c("n"), F.lit("now"), F.lit("before"), b, c("lang"), c("source"))
    prompt = F.struct(F.lit("p").alias("prompt"), c("n").alias("depth"))
    refinement = F.array(F.struct(F.lit("x").alias("body"), F.lit(0.3).alias("confidence")))
    return {
        "appended": F.array_join(worlds.appended(F.array("lang"), c("step")), ">"),
        "from_nothing": F.array_join(worlds.appended(F.lit(None).cast("array<string>"), c("lang")), ">"),
        "answered": F.to_json(answered),
        "by_phrase": worlds.ends_by_phrase(state, "Now we can answer"),
        "by_suffix": worlds.ends_by_suffix(state, "}."),
        "by_steps": worlds.ends_by_steps(c("n"), 4),
        "by_equality": worlds.ends_by_equality(state, F.lit("[PLAN END]")),
        "by_line": worlds.ends_by_line(state),
        "by_box": worlds.ends_by_box(state, c("n") > 3),
        "by_words": worlds.ends_by_few_new_words(F.concat(F.lit("What is the "), "lang"), F.concat(F.lit("what IS "), "source")),
        "by_environment": worlds.ends_by_environment(c("n") == 1, F.lit(None).cast("boolean"), c("n"), 5),
        "claims": F.to_json(worlds.rewritten(F.struct(c("lang").alias("body")), c("source"))),
        "buffer_first": F.to_json(buffered(F.lit(""))),
        "buffer_second": F.to_json(buffered(F.lit("a"))),
        "prompt": F.to_json(worlds.rewritten_prompt(prompt, c("lang"))),
        "prompt_ends": worlds.ends_by_score(c("n"), c("n") / 10, F.lit(0.2), F.lit(0.3), F.lit(0.45), 5, 1),
        "refined": F.size(worlds.refined(refinement, c("lang"), c("n") / 10)).cast("long"),
        "tool": worlds.tool_call(F.concat(F.lit("Search["), "lang", F.lit("]")))["tool"],
        "tool_argument": worlds.tool_call(F.concat(F.lit("Search["), "lang", F.lit("]")))["argument"],
        "calls": worlds.calls_valid(F.when(c("n") > 2, "click('a') then noop()").otherwise("fly()"), ["click", "noop"]),
        "left": F.array_join(F.transform(worlds.numbers_left(F.concat(F.lit("1 + 2 = 3 (left: 3 "), "n", F.lit(" 7)"))), lambda x: x.cast("int").cast("string")), " "),
        "after_operation": F.array_join(F.transform(worlds.after_operation(F.array(F.lit(4.0), F.lit(4.0), F.lit(9.0)), F.array(F.lit(4.0), F.lit(9.0)), c("n") + 0.0), lambda x: x.cast("int").cast("string")), " "),
        "proposals": F.size(worlds.proposals(F.concat(F.lit("a (left: 1)\nb\n"), F.when(c("n") > 2, "c (left: 2)").otherwise("")))).cast("long"),
        "goal_share": score.goals_met(c("step"), F.array(F.lit("answer"), c("lang")))["share"],
        "goal_all": score.goals_met(c("step"), F.array(F.lit("answer"), c("lang")))["all"],
        "state_answer": worlds.answer_of(F.array(F.concat(F.lit("it is "), "n", F.lit(" of 12")))),
    }


def _worlds_sql() -> dict[str, str]:
    return {
        "appended": "lang || '>' || step",
        "from_nothing": "lang",
        "answered": """'[{"sub_question":"' || lang || '","sub_answer":"' || source || '","confidence":' || CAST(n / 10.0 AS VARCHAR) || '}]'""",
        "by_phrase": "doc_id % 4 = 0",
        "by_suffix": "doc_id % 4 = 3",
        "by_steps": "n >= 4",
        "by_equality": "doc_id % 4 = 1",
        "by_line": "doc_id % 4 = 2",
        "by_box": "doc_id % 4 = 3 AND n <= 3",
        "by_words": "true",
        "by_environment": "n IN (1, 5)",
        "claims": """'{"last_state":"' || lang || '","last_action":"' || source || '","body":"' || source || '"}'""",
        "buffer_first": """'{"step":' || (n + 1) || ',"last_state":"before","state":"' || source || '","buffer":"' || lang || '"}'""",
        "buffer_second": """'{"step":' || (n + 1) || ',"last_state":"now","state":"' || source || '","buffer":""}'""",
        "prompt": """'{"prompt":"' || lang || '","depth":' || (n + 1) || '}'""",
        "prompt_ends": "n >= 5 OR n = 2",
        "refined": "CASE WHEN n >= 3 THEN 2 ELSE 1 END::BIGINT",
        "tool": "'search'",
        "tool_argument": "lang",
        "calls": "n > 2",
        "left": "'3 ' || n || ' 7'",
        "after_operation": "least(4, n) || ' ' || greatest(4, n)",
        "proposals": "CASE WHEN n > 2 THEN 2 ELSE 1 END::BIGINT",
        "goal_share": "(CAST(contains(step, 'answer') AS INTEGER) + CAST(contains(step, lang) AS INTEGER)) / 2.0",
        "goal_all": "contains(step, 'answer') AND contains(step, lang)",
        "state_answer": "'12'",
    }


family("world_rules", ["documents"], STATES, ["doc_id"], _worlds, _worlds_sql())

BOARDS = """SELECT doc_id, lang, 'h' || CAST(1 + doc_id % 5 AS STRING) AS across, 'v' || CAST(1 + doc_id % 5 AS STRING) AS down, CAST(doc_id % 5 AS INT) AS n,
  'h' || CAST(1 + doc_id % 5 AS STRING) || '. Apple (high)' || chr(10) || 'v2. berry (certain)' || chr(10) || 'h9. wrong (low)' || chr(10) || 'v1. ' || lang || ' (low)' AS text FROM {documents}"""


def _boards() -> dict[str, Column]:
    c = F.col
    empty = F.array_repeat(F.lit("_"), 25)
    one = worlds.placed(empty, c("across"), F.lit("apple"))
    two = worlds.placed(one, c("down"), F.lit("berry"))
    status = worlds.word_status(worlds.words_on(one), worlds.words_on(two))
    return {
        "board": F.array_join(one, ""),
        "row": F.array_join(worlds.row(two, 0), ""),
        "word_down": worlds.words_on(two)[F.col("n") + 5],
        "changed": F.size(F.filter(status, lambda s: s == 2)).cast("long"),
        "searchable": worlds.searchable(status, c("n"), 4),
        "letters_right": worlds.letters_right(two, one),
        "words_right": F.round(worlds.words_right(one, one), 6),
        "candidates": F.to_json(worlds.candidates(c("text"))),
    }


def _boards_sql() -> dict[str, str]:
    return {
        "board": "repeat('_____', n) || 'APPLE' || repeat('_____', 4 - n)",
        "row": "CASE n WHEN 0 THEN 'BPPLE' WHEN 1 THEN '_B___' WHEN 2 THEN '__B__' WHEN 3 THEN '___B_' ELSE '____B' END",
        "word_down": "'BERRY'",
        "changed": "CASE WHEN substr('APPLE', n + 1, 1) = substr('BERRY', n + 1, 1) THEN 0 ELSE 1 END::BIGINT",
        "searchable": "substr('APPLE', n + 1, 1) = substr('BERRY', n + 1, 1) AND n < 4",
        "letters_right": "(20 + CASE WHEN substr('APPLE', n + 1, 1) = substr('BERRY', n + 1, 1) THEN 1 ELSE 0 END) / 25.0",
        "words_right": "1.0::DOUBLE",
        "candidates": """'[{"slot":"' || across || '","word":"apple","confidence":0.5},{"slot":"v2","word":"berry","confidence":1.0}]'""",
    }


family("crossword_rules", ["documents"], BOARDS, ["doc_id"], _boards, _boards_sql())

RENDERED = """SELECT doc_id, lang, source, n_chars, CAST(doc_id % 6 AS INT) AS n, 'StaticText a' || chr(10) || '[1] b' || chr(10) || 'StaticText c' || chr(10) || lang AS page,
  'Think of ' || lang || ' ```click(' || CAST(doc_id AS STRING) || ')' AS reply, 'run-2024-03-0' || CAST(1 + doc_id % 9 AS STRING) || '-10-20-30.json' AS file FROM {documents}"""


def _rendered() -> dict[str, Column]:
    c = F.col
    pool = F.array(F.lit("a;"), c("lang"), F.lit(";c;"))
    plan = F.array(*[F.lit(x) for x in "abcdef"])
    pair = render.thought_action(c("reply"))
    return {
        "pooled": render.pooled(pool, 2, F.lit("P: ")),
        "shortened": F.array_join(F.transform(render.shortened_plans(plan, 4), lambda x: F.array_join(x, "")), "|"),
        "capped": F.array_join(render.capped_with_final(F.array(F.lit("a"), c("lang"), F.lit("z"), F.lit("d"), F.lit("e"), F.lit("f")), F.lit("z")), ","),
        "claims": render.claims(F.array(F.lit("s0"), F.lit("s1"), c("lang"), F.lit("end"))),
        "plan_text": render.plan_text(F.array("lang", "source")),
        "definitions": render.with_definitions(F.concat("lang", F.lit(" and "), "lang"), F.array("lang")),
        "truncated": render.truncated_lines(c("page"), "StaticText", 0, 2),
        "sentences": F.array_join(render.sentences(F.concat(F.lit("One "), "lang", F.lit(". Two. Three "), "lang"), c("lang")), "|"),
        "steps": F.array_join(render.steps(c("page")), "|"),
        "question": render.question_line(F.concat(F.lit("  what\n\n of "), "lang")),
        "computation": render.computation(F.concat(F.lit("so <<3*"), "n", F.lit("="))),
        "no_computation": render.computation(F.concat(F.lit("so <<x*"), "n", F.lit("="))),
        "indent": F.length(render.indent(F.concat(F.repeat(F.lit(" "), c("n")), "lang"))).cast("long"),
        "progress": render.progress(c("n"), F.lit(10)),
        "stamp": F.date_format(render.stamped_name(c("file")), "yyyyMMdd HHmmss"),
        "thought": pair["thought"],
        "action": pair["action"],
        "message": render.thought_action(c("lang"))["action"],
        "step_block": render.step_block(c("n"), c("lang"), c("source"), F.lit("o")),
        "identity": render.identity("N", "D"),
        "as_list": render.stringified(F.array("lang", "source"), "list"),
        "as_map": render.stringified(F.create_map(F.lit("k"), c("lang")), "map"),
        "as_bool": render.stringified(c("n") > 2, "bool"),
        "as_text": render.stringified(F.when(c("n") > 2, c("n")), "text"),
    }


def _rendered_sql() -> dict[str, str]:
    return {
        "pooled": "'P: a;' || lang",
        "shortened": "'abcdef|cdef|ef|'",
        "capped": "'a,' || lang || ',d,e,z'",
        "claims": "'s1' || chr(10) || lang",
        "plan_text": "lang || chr(10) || source",
        "definitions": "'{{c1}} and {{c1}}' || chr(10) || chr(10) || 'Definitions:' || chr(10) || '{{c1}}: ' || lang",
        "truncated": "'[1] b'",
        "sentences": "'One ' || lang || '|Three ' || lang",
        "steps": "replace(page, chr(10), '|')",
        "question": "'Q: what of ' || lang",
        "computation": "'3*' || n",
        "no_computation": "NULL::VARCHAR",
        "indent": "n::BIGINT",
        "progress": "CAST(100 - 10 * n AS VARCHAR) || '.0%'",
        "stamp": "'2024030' || (1 + doc_id % 9) || ' 102030'",
        "thought": "'Think of ' || lang",
        "action": "'click(' || doc_id || ')'",
        "message": "'send_msg_to_user(' || chr(39) || lang || chr(39) || ')'",
        "step_block": "'Thought ' || n || ': ' || lang || chr(10) || 'Action ' || n || ': ' || source || chr(10) || 'Observation ' || n || ': o' || chr(10)",
        "identity": "'# Name:' || chr(10) || 'N' || chr(10) || chr(10) || '# Description:' || chr(10) || 'D'",
        "as_list": "lang || ', ' || source",
        "as_map": "'k: ' || lang",
        "as_bool": "CASE WHEN n > 2 THEN 'yes' ELSE 'no' END",
        "as_text": "CASE WHEN n > 2 THEN CAST(n AS VARCHAR) ELSE '' END",
    }


family("render_rules", ["documents"], RENDERED, ["doc_id"], _rendered, _rendered_sql())

PLANS = """SELECT doc_id, CAST(doc_id % 3 AS INT) AS n, 'The red block is clear, the red block is on the table, the hand is empty, the blue block is clear and the blue block is on the table.' AS start FROM {documents}"""


def _plans() -> dict[str, Column]:
    start = planning.facts(F.col("start"))
    lift, put = F.lit("pick up the red block"), F.lit("stack the red block on top of the blue block")
    plan = F.when(F.col("n") == 0, F.array(lift, put)).when(F.col("n") == 1, F.array(put)).otherwise(F.array(lift))
    goals = F.array(F.lit("the red block is on top of the blue block"))
    states = planning.states_of(start, plan)
    return {
        "n_facts": F.size(start).cast("long"),
        "legal": F.array_join(planning.legal_actions(start), "|"),
        "valid": planning.plan_valid(start, plan, goals),
        "n_states": F.size(states).cast("long"),
        "last_state": F.array_join(F.element_at(states, -1), "|"),
    }


def _plans_sql() -> dict[str, str]:
    return {
        "n_facts": "5::BIGINT",
        "legal": "'pick up the blue block|pick up the red block'",
        "valid": "n = 0",
        "n_states": "CASE n WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT",
        "last_state": "CASE n WHEN 0 THEN 'the blue block is on the table|the hand is empty|the red block is clear|the red block is on top of the blue block' WHEN 1 THEN 'the blue block is clear|the blue block is on the table|the hand is empty|the red block is clear|the red block is on the table' ELSE 'the blue block is clear|the blue block is on the table|the hand is currently holding the red block' END",
    }


family("planning_rules", ["documents"], PLANS, ["doc_id"], _plans, _plans_sql())

PROGRAMS = """SELECT doc_id, lang, source, CAST(doc_id % 4 AS INT) AS n FROM {documents}"""


def _programs() -> dict[str, Column]:
    c = F.col
    long_as = lambda p: F.concat(F.lit("n"), F.length(p).cast("string"))
    solved = programs.decomposed_then_solved(F.array("lang", "source"), long_as)
    policy = lambda history, n: F.when(n <= c("n"), F.concat(F.lit("Search["), "lang", F.lit("]"))).otherwise(F.concat(F.lit("Finish["), "source", F.lit("]")))
    ran = programs.acted(c("lang"), policy, lambda tool, argument: F.when(tool == "search", F.upper(argument)), 3)
    step = programs.agent_step(c("lang"), F.array("source"), F.upper, lambda state, memory: F.concat(state, F.element_at(memory, -1)), lambda state, plan: F.concat(F.lit("do "), plan))
    demo = render.demonstration(c("lang"), F.array("lang", "source"), c("source"))
    page = render.browsing_prompt(c("lang"), c("source"), F.array("lang"), F.when(c("n") == 1, "bad"))
    logic = render.logic_example(c("lang"), c("source"), F.array("lang"), F.array("source"))
    zipped = render.zipped_pool(F.array("lang", F.lit("x")), F.array("source", F.lit("y")), 1, c("doc_id"), 2)
    return {
        "history": solved["history"],
        "answer": solved["answer"],
        "react": ran["history"],
        "react_n": ran["n"],
        "react_answer": ran["answer"],
        "agent_plan": step["plan"],
        "agent_action": step["action"],
        "agent_memory": F.array_join(step["memory"], "|"),
        "demonstration": demo,
        "page": page,
        "logic": logic,
        "pairs": F.array_join(F.array_sort(F.transform(zipped, lambda z: F.concat(z["a"], z["b"]))), "|"),
        "prompts": F.array_join(render.prompts_along(F.array(F.struct(F.lit("p0").alias("prompt")), F.struct(c("lang").alias("prompt")))), ">"),
        "tree_answer": render.chosen_answer(F.when(c("n") == 0, c("lang")), c("source"), True),
        "label_reward": rewards.label_reward(F.concat(F.lit("The "), F.upper("lang")), F.lit("en")),
    }


def _programs_sql() -> dict[str, str]:
    h1 = "'Q: ' || lang || chr(10) || 'A: n' || (length(lang) + 6) || chr(10)"
    q2 = f"{h1} || 'Q: ' || source || chr(10) || 'A:'"
    search = lambda k: f"'Action {k}: Search[' || lang || ']' || chr(10) || 'Observation {k}: ' || upper(lang) || chr(10)"
    finish = lambda k: f"'Action {k}: Finish[' || source || ']' || chr(10) || 'Observation {k}: done' || chr(10)"
    runs = f"CASE n WHEN 0 THEN {finish(1)} WHEN 1 THEN {search(1)} || {finish(2)} WHEN 2 THEN {search(1)} || {search(2)} || {finish(3)} ELSE {search(1)} || {search(2)} || {search(3)} END"
    return {
        "history": f"{q2} || ' n' || length({q2}) || chr(10)",
        "answer": f"'n' || length({q2})",
        "react": f"'Question: ' || lang || chr(10) || {runs}",
        "react_n": "least(n + 1, 3)",
        "react_answer": "CASE WHEN n < 3 THEN source END",
        "agent_plan": "upper(lang) || source",
        "agent_action": "'do ' || upper(lang) || source",
        "agent_memory": "source || '|' || upper(lang) || ' -> ' || upper(lang) || source",
        "demonstration": "'Q: ' || lang || chr(10) || 'A: ' || lang || ' | ' || source || ' The answer is ' || source || '.'",
        "page": "'# Goal:' || chr(10) || lang || chr(10) || '# Page:' || chr(10) || source || chr(10) || '# Actions so far:' || chr(10) || lang || CASE WHEN n = 1 THEN chr(10) || '# Error of the last action:' || chr(10) || 'bad' ELSE '' END",
        "logic": "'Facts: ' || lang || chr(10) || 'Query: ' || source || chr(10) || 'Claim 1: ' || lang || chr(10) || 'Next 1: ' || source",
        "pairs": "array_to_string(list_sort([lang || source, 'xy']), '|')",
        "prompts": "'p0>' || lang",
        "tree_answer": "CASE WHEN n = 0 THEN lang ELSE source END",
        "label_reward": "CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE",
    }


family("program_rules", ["documents"], PROGRAMS, ["doc_id"], _programs, _programs_sql())

PROBLEMS = """SELECT doc_id, lang, '(define (problem p' || CAST(doc_id AS STRING) || ') (:domain blocks) (:objects a b c )' || chr(10) || '(:init (handempty) (ontable a) (on b a) (clear b)' || CASE WHEN doc_id % 2 = 0 THEN ' (ontable c) (clear c)' ELSE ' (holding c)' END || ')' || chr(10) || '(:goal (and (on a b))))' AS problem,
  'pick up the red block' || chr(10) || 'think' || chr(10) || 'stack the red block on top of the ' || CASE WHEN doc_id % 2 = 0 THEN 'blue' ELSE 'gold' END || ' block' AS plan FROM {documents}"""


def _problems() -> dict[str, Column]:
    p = planning.problem(F.col("problem"))
    return {
        "objects": F.array_join(p["objects"], " "),
        "init": F.array_join(p["init"], "|"),
        "goals": F.array_join(p["goals"], "|"),
        "question": planning.statement(F.concat("lang", F.lit(": <goals>. From: <init>.")), p),
        "actions": F.array_join(planning.grounded(F.col("plan")), ""),
    }


def _problems_sql() -> dict[str, str]:
    more = "CASE WHEN doc_id % 2 = 0 THEN {0} ELSE {1} END"
    held = ["the blue block is clear", "the blue block is on top of the red block", "the hand is currently holding the orange block", "the hand is empty", "the red block is on the table"]
    free = ["the blue block is clear", "the blue block is on top of the red block", "the hand is empty", "the orange block is clear", "the orange block is on the table", "the red block is on the table"]
    told = lambda f: _q(", ".join(f[:-1]) + " and " + f[-1])
    return {
        "objects": "'a b c'",
        "init": more.format(_q("|".join(free)), _q("|".join(held))),
        "goals": "'the red block is on top of the blue block'",
        "question": "lang || ': the red block is on top of the blue block. From: ' || " + more.format(told(free), told(held)) + " || '.'",
        "actions": "'(pick-up a)(stack a ' || CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'l' END || ')'",
    }


family("planning_problems", ["documents"], PROBLEMS, ["doc_id"], _problems, _problems_sql())
