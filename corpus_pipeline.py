"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm import bpe, common, jaccard_join, mixing, substring_dedup
from thicket.llm.quality_rules import judged

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts fail the base rules. Repeated rows are judged alike; other columns stay as they are."""
    return judged(docs).where("_kept").drop("_m", "_base", "_kept")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows (five words, similarity 0.8) one stays: that of least doc_id (null last), then of least text hash; of rows equal in both, the first by all its columns. Rows without words link with nothing and stay, repeated ones too."""
    rows = common.cut(jaccard_join.classes(docs, n=5, percent=80, tell_text=True).where("class_hash is not null"))
    least = rows.groupBy("class_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    least = common.cut(least.select("class_hash", F.col("k.doc_id").alias("k_doc"), F.col("k.text_hash").alias("k_text")))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("text_hash") == F.col("k_text"))
    told = rows.join(least, "class_hash").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), (~same).alias("_gone")).count()
    told = common.cut(told.where("_gone or count > 1").select("_doc", "_text", "_gone"))
    on = F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("_row.text", F.lit(""))) == F.col("_text"))
    j = common.with_small(common.packed(docs), told, on)
    out = common.unpacked(j.where("_gone is null"))
    if told.where("not _gone").isEmpty():
        return out
    again = j.where("not _gone").groupBy("_doc", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return out.unionByName(common.unpacked(again))


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; documents left without a word go. Rows without repeats stay as they are, null and empty texts too."""
    return substring_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: 0, 1 or 2 times. Rows equal in doc_id, text and source are taken as often together as the mix takes them, in the order of all their columns. Null and empty texts have no words and are never taken."""
    key = lambda p: F.xxhash64(*[F.col(f"{p}{c}") for c in ("doc_id", "text", "source")])
    small = common.cut(docs.select("doc_id", "source", key("").alias("_key"), mixing.words(F.col("text")).alias("size")))
    _, targets = mixing.shares(small, F.col("size"))
    mixed = mixing.mix(small, F.array("source"), F.col("size"), {s: int(t) for s, t in targets.items()})
    times = mixed.groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k")).agg(F.sum("_times").alias("_times"), F.count("*").alias("_rows"))
    times = common.cut(times.where("_times > 0"))
    rows = common.packed(docs).withColumn("_key", key("_row."))
    j = common.with_small(rows, times, F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "inner")
    again = lambda d, n: common.unpacked(d.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), n))))
    out = again(j.where("_rows = 1"), F.col("_times"))
    if times.where("_rows > 1").isEmpty():
        return out
    # equal rows are counted first, so that a row that comes very often is one
    whole = F.to_json("_row")
    each = j.where("_rows > 1").groupBy("_doc", "_k", "_times", "_rows", whole.alias("_json")).agg(F.first("_row").alias("_row"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_doc", "_k").orderBy("_json")) - F.col("_c")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.expr("_times % _rows") - before, F.col("_c")))
    return out.unionByName(again(each.withColumn("_own", F.expr("_times div _rows") * F.col("_c") + more).where("_own > 0"), F.col("_own")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document in the place of its text, their number, and whether they decode to the text. Null texts count as empty."""
    import public_tokenizers

    return bpe.tokenised(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", dedup_substrings),
    ("mixing", mix_sources),
    ("byte_bpe", byte_bpe),
]
#: None: approximate candidate search, flows and token merges can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; a stage's input goes once its output is written."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before, docs = docs, common.written(out)
            common.discarded(before)
        else:
            docs = out
    return docs
