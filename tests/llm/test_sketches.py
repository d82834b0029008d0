"""Sketches of the Jaccard join: what they rule out, whatever the sets' sizes, and which keys are compared at last."""

import random

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import common, jaccard_join


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_sketches_bound_the_difference_of_sets_of_all_sizes():
    rng = np.random.default_rng(1)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    sketch = lambda el: jaccard_join._sketches(np.zeros(len(el), int), el, np.array([len(el)]))[0]
    for n in (0, 3, 511, 512, 513, 1000, 1100, 9000, 40_000):
        el, other, more = some(n), some(n), some(n // 10)
        assert jaccard_join.SKETCH <= 8 * len(sketch(el)) <= jaccard_join.SKETCH_MOST
        near, far = jaccard_join.bits_apart([sketch(el)] * 2, [sketch(np.concatenate((el, more))), sketch(other)])
        assert near <= len(more)  # never more than the sets differ, though the longer sketch is folded
        assert not n or far * 180 > 2 * n * 20, n  # sets without a common element can't link at 80 percent


def test_jaccard_rules_out_long_texts_by_sketch(spark):
    """Of unrelated texts of 3,000 words no elements are asked for; near copies are found."""
    rng = random.Random(2)
    texts = [prose(rng, 3000) for _ in range(4)]
    texts.append(texts[0] + " end")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_hash", F.lit(0).cast("long"))
    info = common.written(d.mapInArrow(jaccard_join._measured(5), "doc_id long, text_hash long, id long, n_shingles long, sketch binary"))
    ids = [r["id"] for r in info.orderBy("doc_id").collect()]
    asked = []

    def elements(of):
        asked.extend(r[0] for r in of.collect())
        return d.join(info.select("doc_id", "id"), "doc_id").join(of, "id", "left_semi").select("id", "text").mapInArrow(jaccard_join._elements(5), "id long, el array<long>")

    sets = info.select("id", F.col("n_shingles").alias("n"), "sketch")
    pairs = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(3)], "a long, b long")
    assert jaccard_join.verified(pairs, sets, elements, 80).collect() == [] and not asked
    more = pairs.unionByName(spark.createDataFrame([(ids[0], ids[4])], "a long, b long"))
    assert [tuple(r) for r in jaccard_join.verified(more, sets, elements, 80).collect()] == [(ids[0], ids[4])]
    assert sorted(asked) == sorted([ids[0], ids[4]])


def test_keys_of_two_nodes_are_compared_once(spark, monkeypatch):
    """Their only pair is settled in the first turn; keys of three go on to all pairs, and no link of theirs is lost."""
    el = {i: [1000 * i + k for k in range(20)] for i in (1, 2, 3, 4)} | {5: [4000 + k for k in range(19)]}
    sets = spark.createDataFrame([(i, len(e), bytes(64), e) for i, e in el.items()], "id long, n long, sketch binary, el array<long>")
    members = common.written(spark.createDataFrame([(7, 1), (7, 2), (8, 3), (8, 4), (8, 5)], "key long, id long"))
    labels = spark.createDataFrame([], "node long, label long")
    last = []
    between = jaccard_join._between
    monkeypatch.setattr(jaccard_join, "_between", lambda members, *more: last.extend(r["key"] for r in members.collect()) or between(members, *more))
    out = jaccard_join.joined_by_key(members, labels, sets, lambda ids: sets.join(ids, "id", "left_semi").select("id", "el"), 80)
    assert {r["node"]: r["label"] for r in out.collect()} == {4: 4, 5: 4}
    assert last and set(last) == {8}
