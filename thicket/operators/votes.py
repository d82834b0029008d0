"""Votes over sampled answers. Every tie goes to the answer seen first; the position is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(samples: DataFrame, by: list[str], answer: str, pos: str, drop_null: bool = False, text: str | None = None) -> DataFrame:
    """(by, answer, votes, total, confidence[, text]): the most frequent answer of each group, confidence its share.

    Null is a voter unless dropped; a group whose answers are all dropped keeps a row with null answer and 0 votes. text: a column whose value at the winner's first position is carried. One aggregation by (group, answer) with partial sums, then one by group.
    """
    counted = samples.where(F.col(answer).isNotNull()) if drop_null else samples
    carried = [F.min_by(text, pos).alias(text)] if text else []
    per = counted.groupBy(*by, answer).agg(F.count("*").alias("votes"), F.min(pos).alias("_first"), *carried)
    top = per.groupBy(*by).agg(F.max(F.struct("votes", (-F.col("_first")).alias("_n"), F.col(answer).alias("answer"), *([text] if text else []))).alias("_t"), F.sum("votes").alias("total"))
    out = top.select(*by, F.col("_t.answer").alias("answer"), F.col("_t.votes").alias("votes"), "total", *([F.col(f"_t.{text}").alias(text)] if text else []))
    if drop_null:
        out = samples.select(*by).distinct().join(out, by, "left").fillna(0, ["votes", "total"])
    return out.withColumn("confidence", F.when(F.col("total") > 0, F.col("votes") / F.col("total")))


def early_stopped(samples: DataFrame, by: list[str], answer: str, pos: str, block: int, threshold: float) -> DataFrame:
    """majority() over the samples up to the first block end at which one answer has the share `threshold` and no other as many votes; over all if there is none. pos counts from 0. Adds used: the samples counted."""
    last = samples.groupBy(*by).agg(F.max(pos).alias("_last"))
    ends = last.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / block))).alias("_e"), "_last").withColumn("_end", F.least((F.col("_e") + 1) * block - 1, "_last"))
    w = Window.partitionBy(*by, answer).orderBy(pos)
    running = samples.select(*by, answer, pos, F.count("*").over(w).alias("_n"))
    # votes of each answer at each block end: its last running count up to there
    at = ends.join(running, [*by], "inner").where(F.col(pos) <= F.col("_end")).groupBy(*by, "_end", answer).agg(F.max("_n").alias("_n"))
    best = at.groupBy(*by, "_end").agg(F.sort_array(F.collect_list("_n"), asc=False).alias("_v"))
    ok = best.where((F.col("_v")[0] >= threshold * (F.col("_end") + 1)) & (F.coalesce(F.get("_v", 1), F.lit(0)) < F.col("_v")[0]))
    stop = last.join(ok.groupBy(*by).agg(F.min("_end").alias("_stop")), by, "left").select(*by, F.coalesce("_stop", "_last").alias("_stop"))
    used = samples.join(stop, by).where(F.col(pos) <= F.col("_stop"))
    return majority(used, by, answer, pos)


def composite(samples: DataFrame, by: list[str], answer: str, text: str, score: str) -> DataFrame:
    """(by, answer, text, confidence): mean score of each (answer, text) and share of the answer in its group, halved; the highest. Null answers are left out; ties go to the smaller answer, then text."""
    s = samples.where(F.col(answer).isNotNull())
    share = s.groupBy(*by, answer).agg(F.count("*").alias("_n"))
    share = share.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by)))
    mean = s.groupBy(*by, answer, text).agg(F.avg(score).alias("_mean"))
    both = mean.join(share, [*by, answer]).withColumn("confidence", F.round((F.col("_mean") + F.col("_share")) / 2, 6))
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), answer, text)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, F.col(answer).alias("answer"), F.col(text).alias("text"), "confidence")


def frequencies(samples: DataFrame, by: list[str], action: str, payload: str, pos: str) -> DataFrame:
    """(by, action, frequency, payload): how often each action was sampled, with the payload of its last sample."""
    return samples.groupBy(*by, action).agg(F.count("*").alias("frequency"), F.max_by(payload, pos).alias(payload))


def rolled_up(freq: DataFrame, members: DataFrame, by: list[str], action: str, cluster: str, pos: str) -> DataFrame:
    """(by, cluster, frequency): frequencies summed over the members of each cluster; members without a frequency are skipped. members: (by, cluster, action, pos)."""
    return members.join(freq, [*by, action]).groupBy(*by, cluster).agg(F.sum("frequency").alias("frequency"), F.max_by(action, pos).alias("last_member"))


def canonical_yes_no(answer: Column, yes: list[str], no: list[str]) -> Column:
    return F.when(F.lower(answer).isin(yes), "yes").when(F.lower(answer).isin(no), "no")


def numeric_majority(samples: DataFrame, by: list[str], answer: str, pos: str) -> DataFrame:
    """majority() of the answers that are numbers; groups without any keep a row of null and 0 votes."""
    return majority(samples.withColumn(answer, F.col(answer).try_cast("double")), by, answer, pos, drop_null=True)


def candidate_scores(samples: DataFrame, by: list[str], candidate: str, score: str, pos: str) -> DataFrame:
    """(by, candidate, score, first): the scores of each candidate summed over samples, and where it is seen first."""
    return samples.groupBy(*by, candidate).agg(F.sum(score).alias("score"), F.min(pos).alias("first"))


def first_of_each(samples: DataFrame, by: list[str], code: Column, pos: str) -> DataFrame:
    """Of samples with the same canonical code the first by pos, other columns with it."""
    w = Window.partitionBy(*by, code).orderBy(pos)
    return samples.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def all_sampled(visited: DataFrame, unvisited: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct answers of a state, sampled or only proposed, with whether it was visited."""
    both = visited.select(*keys, F.lit(1).alias("_v")).unionByName(unvisited.select(*keys, F.lit(0).alias("_v")))
    return both.groupBy(*keys).agg((F.max("_v") == 1).alias("visited"))
