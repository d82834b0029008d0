"""Running sums over groups of any size: no group is one task, as a window's is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.storage import written


def scan(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its running sum over the rows of the group up to this one, in order (nulls first; a null adds nothing, and before any value the sum is null). by may be empty: all rows are one group. Null keys are a group. Rows equal in order go in any one order.

    Rows are range-partitioned by group and order, so that a large group is in several partitions, sorted and written. Each partition sums its part of each group, one row a partition and group; the sums of the parts before are joined back, and inside a part a window runs over it.
    """
    keys = [*by, *order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    d = written(d.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(sums.values())], F.monotonically_increasing_id().alias("_at")))
    d = d.withColumn("_part", F.shiftright("_at", 33))
    parts = d.groupBy(*by, "_part").agg(*[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), *[F.sum(f"_t{i}").over(before).alias(f"_c{i}") for i in range(len(sums))])
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = d.select("*", *[F.sum(f"_s{i}").over(inside).alias(f"_r{i}") for i in range(len(sums))]).join(carry, on)
    total = lambda i: F.when(F.col(f"_c{i}").isNull(), F.col(f"_r{i}")).otherwise(F.col(f"_c{i}") + F.coalesce(f"_r{i}", F.lit(0)))
    return run.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[total(i).alias(name) for i, name in enumerate(sums)])
