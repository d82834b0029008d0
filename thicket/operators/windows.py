"""Window computations over ordered steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.scan import scan


def running_accuracy(results: DataFrame, by: list[str], order: list[str], correct: str) -> DataFrame:
    """results with n, n_correct and accuracy up to each row."""
    r = scan(results, by, order, {"n": F.lit(1).cast("long"), "n_correct": F.coalesce(F.col(correct).cast("long"), F.lit(0).cast("long"))})
    return r.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6))


def nucleus(candidates: DataFrame, by: list[str], p: str, order: list[str], top_p: float, top_k: int) -> DataFrame:
    """Candidates of the smallest head whose mass before each is at most top_p, at most top_k of them, with `prob` renormalised. order: after p descending."""
    w = Window.partitionBy(*by).orderBy(F.desc(p), *order)
    run = candidates.withColumn("_before", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)).withColumn("rank", F.row_number().over(w))
    kept = run.where((F.round("_before", 9) <= top_p) & (F.col("rank") <= top_k))
    return kept.withColumn("prob", F.col(p) / F.sum(p).over(Window.partitionBy(*by))).drop("_before")


def run_lengths(steps: DataFrame, by: list[str], order: list[str], same_as_before: Column) -> DataFrame:
    """steps with `run`: how many rows in a row, up to here, have gone on from the one before. same_as_before may use lag columns over (by, order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = steps.withColumn("_same", F.coalesce(same_as_before, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("run", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(*order)) - 1).drop("_same", "_island")


def repeat_guard(steps: DataFrame, by: list[str], order: list[str], action: str, free: list[str], limit: int = 5) -> DataFrame:
    """(by, longest, tripped): the longest run of repeated actions, those in `free` excepted, and whether it reaches the limit."""
    before = F.lag(action).over(Window.partitionBy(*by).orderBy(*order))
    r = run_lengths(steps, by, order, (F.col(action) == before) & ~F.col(action).isin(free))
    return r.groupBy(*by).agg(F.max("run").alias("longest")).withColumn("tripped", F.col("longest") >= limit)


def error_guard(steps: DataFrame, by: list[str], order: list[str], error: Column, limit: int = 3) -> DataFrame:
    """(by, longest, tripped): the longest streak of errors, and whether it is over the limit."""
    s = steps.withColumn("_e", error)
    w = Window.partitionBy(*by).orderBy(*order)
    s = s.withColumn("_island", F.sum(F.when(F.col("_e"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = s.where("_e").groupBy(*by, "_island").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias("_n"))
    return steps.select(*by).distinct().join(streak, by, "left").select(*by, F.coalesce("_n", F.lit(0)).cast("long").alias("longest")).withColumn("tripped", F.col("longest") > limit)


def cutoff(steps: DataFrame, by: list[str], order: list[str], max_steps: int) -> DataFrame:
    """The first max_steps of each group, numbered from 1 in `step`."""
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("step") <= max_steps)


def returns(visits: DataFrame, by: list[str], pos: str, reward: str, how: str = "sum") -> DataFrame:
    """visits with `ret`: the sum or mean of rewards from each place to the end of its path, as back-propagation gives them."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    return visits.withColumn("ret", (F.sum if how == "sum" else F.avg)(reward).over(w))


def best_so_far(steps: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """steps with best (score up to here) and improved (not below all before: later ties replace)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", before.isNull() | (F.col(score) >= before))


def rendered(steps: DataFrame, by: list[str], order: str, text: Column, heading: str = "## Step ", sep: str = "\n") -> DataFrame:
    """(by, history): the steps of a group as one text with numbered headings."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    s = steps.withColumn("_n", n).withColumn("_t", F.concat(F.lit(heading), F.col("_n"), F.lit(sep), text))
    return s.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), sep).alias("history"))


def interleaved(items: DataFrame, source: str, order: str, per_block: dict[str, int]) -> DataFrame:
    """items with block and place: each source gives its number of items to every block, sources by name inside a block."""
    size = F.create_map(*[x for k, v in per_block.items() for x in (F.lit(k), F.lit(v))])[F.col(source)]
    i = scan(items, [source], [order], {"_i": F.lit(1).cast("long")}).withColumn("_i", F.col("_i") - 1)
    return i.withColumn("block", F.floor(F.col("_i") / size).cast("long")).withColumn("place", (F.col("_i") % size).cast("long")).drop("_i")


def balanced(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """The first rows of each class, as many as the smaller class has. The counts are one row a class."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"), F.count("*").alias("_classes"))
    ranked = scan(rows, [label], order, {"rank": F.lit(1).cast("long")}).withColumn("rank", F.col("rank").cast("int"))
    return ranked.join(F.broadcast(n), F.col("rank") <= F.col("_least")).drop("_least", "_classes")
