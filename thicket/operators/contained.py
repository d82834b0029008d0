"""Which texts hold which of many items word for word, at a cost that doesn't follow the number of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.storage import written

#: Bytes of items that are broadcast; beyond that Spark plans a shuffle join.
SMALL = 32 << 20


def _pairs(words: Column) -> Column:
    """Hashes of each two words in a row."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def holders(items: DataFrame, texts: DataFrame, item: str = "item", text: str = "text") -> DataFrame:
    """Rows of items and of texts together wherever the text contains the item. Null items and null texts match nothing, an empty item every text; repeated rows match each.

    All words of an item but its first and last are whole words of any text that holds it. Of each item the pair of such words in a row that fewest texts have is its key; texts are joined on their pairs of words and then looked through for the item itself. Items of fewer than four words have no such pair: each of these few is looked for in every text.
    """
    i = items.withColumn("_i", F.monotonically_increasing_id()).withColumn("_w", _words(F.col(item)))
    i = written(i.where(F.col(item).isNotNull()))
    t = texts.where(F.col(text).isNotNull())
    inner = _pairs(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))))
    size = i.agg(F.coalesce(F.sum(F.octet_length(item) * 4 + 64), F.lit(0))).first()[0]
    small = F.broadcast if size <= SMALL else (lambda d: d)
    keys = i.select("_i", F.explode(inner).alias("_k"))
    seen = t.select(F.explode(_pairs(_words(F.col(text)))).alias("_k")).join(small(keys.select("_k").distinct()), "_k", "left_semi").groupBy("_k").agg(F.count("*").alias("_n"))
    rarest = Window.partitionBy("_i").orderBy("_n", "_k")
    chosen = keys.join(seen, "_k").withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select("_i", "_k")
    # an item of which a pair is in no text is in none: only items with all their pairs seen go on
    wanted = i.where(F.size(inner) > 0).select("_i", F.size(inner).alias("_all")).join(keys.join(seen, "_k").groupBy("_i").agg(F.count("*").alias("_seen")), "_i").where("_all = _seen").select("_i")
    asked = written(i.join(chosen, "_i").join(wanted, "_i", "left_semi").drop("_w", "_i"))
    one = t.withColumn("_k", F.explode(_pairs(_words(F.col(text))))).join(small(asked), "_k").where(F.contains(text, item)).drop("_k")
    short = i.where(F.size(inner) == 0).drop("_w", "_i")
    return one.unionByName(t.join(small(short), F.contains(text, item)))
