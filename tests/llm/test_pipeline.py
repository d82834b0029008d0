"""Each stage of the pipeline against what it must do to rows, and the whole run on the smallest table."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from thicket.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    long = prose(random.Random(1), 3000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (None, "a b c", "en", None, 5), (5, long, "en", "a", 1), (5, long, "en", "a", 1), (5, long, "en", "b", 1)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("size", "id", "key", "label", "n_words", "ids", "_gone", "_times", "_rows", "_m")})


def test_jaccard_stage_keeps_one_row_of_each_class(spark):
    p = prose(random.Random(2), 100)
    rows = [(3, p, "en", "a", 1), (None, p + " b", "en", "a", 2), (1, p + " c", "en", "a", 3), (7, "x", "en", "a", 4), (7, "x", "en", "a", 4), (7, "x", "en", "b", 4), (8, None, "en", "a", 5), (8, None, "en", "a", 5)]
    left = lambda rows: Counter(tuple(r) for r in corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, DOC), "").collect())
    want = Counter({(1, p + " c", "en", "a", 3): 1, (7, "x", "en", "a", 4): 1, (8, None, "en", "a", 5): 2})
    assert left(rows) == want
    other = (9, prose(random.Random(3), 60), "en", "a", 1)
    assert left([*rows, other]) == want + Counter([other])  # a row more changes nothing for the others
    alone = [(None, p, "en", "a", 1), (None, p + " b", "en", "a", 2), (None, prose(random.Random(4), 50), "en", "a", 3)]
    assert sum(left(alone).values()) == 2


def test_mixing_stage_meets_its_targets_with_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i // 3, prose(random.Random(i // 3), 10 + i // 3 % 7), "en", "abc"[i // 3 % 3], 1) for i in range(360)]
    rows += [(1000 + i, prose(rng, 12), "en", "abc"[i % 3], 1) for i in range(90)]
    d = spark.createDataFrame(rows, DOC)
    _, targets = mixing.shares(d, mixing.words(F.col("text")))
    taken = Counter()
    for r in corpus_pipeline.mix_sources(spark, d, "").collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - float(t)) < 10 for s, t in targets.items()), (taken, targets)


def test_stages_on_odd_rows(spark):
    d = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "")
        n = out.count()
        assert {"quality_rules": 3, "ngram_jaccard": 5, "substring_dedup": 7, "byte_bpe": 7}.get(name, n) == n, name
        if name != "byte_bpe":
            assert [c for c in out.columns if c != "_m"] == [c for c in d.columns if c != "_m"]
        assert stage(spark, d.limit(0), "").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r["round_trip"] and r["n_tokens"] > 0 for r in out)
    source = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"] for r in out} <= source
