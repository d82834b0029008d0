"""Evaluation: accuracy, agreement, significance, and what is still to be done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.model import HashModel, LanguageModel
from thicket.operators import votes


def accuracy(results: DataFrame, correct: Column, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """(by, n, n_correct, accuracy); null accuracy where there are no rows. rollup: sub-totals and the grand total too."""
    r = results.withColumn("_c", F.coalesce(correct, F.lit(False)).cast("long"))
    g = (r.rollup if rollup else r.groupBy)(*(by or []))
    return g.agg(F.count("*").alias("n"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n_correct"), F.round(F.avg("_c"), 6).alias("accuracy"))


def agreement(rows: DataFrame, judge: str, human: str, index: str) -> DataFrame:
    """Confusion of judge and human verdicts: count and sorted ids of each cell."""
    ids = F.array_join(F.sort_array(F.collect_list(index)), ",")
    return rows.groupBy(F.col(judge).alias("judge"), F.col(human).alias("human")).agg(F.count("*").alias("n"), ids.alias("ids"))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t) of the paired test; rows without both values don't count."""
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("_d"), 4).alias("mean_difference"), F.round(F.try_divide(F.avg("_d"), F.stddev_samp("_d") / F.sqrt(F.count("*"))), 4).alias("t"))


def unfinished(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that have no result yet."""
    return jobs.join(done, keys, "left_anti")


def prompt_accuracy(prompts: DataFrame, questions: DataFrame, prompt: str, correct: Column, at_once: int = 1_000) -> DataFrame:
    """(prompt, n, accuracy) over all questions. Prompts are a stated set; it goes in blocks of some at_once, each broadcast."""
    blocks = max(1, -(-prompts.count() // at_once))
    out = None
    for b in range(blocks):
        part = prompts.where(F.pmod(F.xxhash64(prompt), F.lit(blocks)) == b) if blocks > 1 else prompts
        each = questions.join(F.broadcast(part)).groupBy(F.col(prompt).alias("prompt")).agg(F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))
        out = each if out is None else out.unionByName(each)
    return out


def asked_for(trajectories: DataFrame, questions: DataFrame, goal: str, question: str) -> DataFrame:
    """trajectories with the columns of the question their goal is; those without one are left out."""
    return trajectories.join(questions, F.col(goal) == F.col(question)).drop(question)


def numbered_rows(results: DataFrame, index: str, dataset: DataFrame, order: list[str]) -> DataFrame:
    """results with the columns of the dataset row their 1-based number is, in order; rows are numbered without a window over all."""
    from thicket.sources.readers import ranged

    rows = ranged(dataset, order).withColumn("_n", F.col("row") + 1).drop("row")
    return results.join(rows, F.col(index) == F.col("_n")).drop("_n")


def self_consistency(examples: DataFrame, key: str, prompt: str, gold: str, extract: Callable[[Column], Column], judge: Callable[[Column, Column], Column], n: int = 5, model: LanguageModel | None = None) -> DataFrame:
    """examples with answer, confidence and correct: n samples of each prompt, the majority of the answers extracted from them, judged against gold."""
    drawn = (model or HashModel()).generate(examples.select(key, prompt), prompt, n)
    voted = votes.majority(drawn.withColumn("_a", extract(F.col("text"))), [key], "_a", "sample", drop_null=True)
    return examples.join(voted.select(key, "answer", "confidence"), key, "left").withColumn("correct", judge(F.col("answer"), F.col(gold)))


def flag_means(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """(by, n, flags): the share of each boolean column that is true; null counts as false."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), 6).alias(f) for f in flags])


def reevaluated(answers: DataFrame, golds: DataFrame, key: str, answer: str, gold: str, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """golds with what saved searches answered and whether it is right; examples without an answer are wrong."""
    return golds.join(answers.select(key, F.col(answer).alias("answer")), key, "left").withColumn("correct", F.coalesce(judge(F.col("answer"), F.col(gold)), F.lit(False)))
