"""Items held by texts against looking for each in each."""

import random

from thicket.operators import contained


def test_holders(spark):
    """Items cut at word ends and inside words, short and empty ones, nulls, repeated rows, items with words no text has."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)] + [(100, None), (101, ""), (7, "w1 w2  w3\nw4 w5"), (7, "w1 w2  w3\nw4 w5")]
    items = [(0, None), (1, ""), (2, "w1"), (3, "w1 w2"), (4, "nowhere w1 w2 w3"), (5, "w1 w2 nowhere w3 w4"), (6, "1 w2  w3\nw4 w"), (6, "1 w2  w3\nw4 w")]
    for k in range(60):
        t = rng.choice(texts[:80])[1]
        a = rng.randrange(len(t) + 1)
        items.append((10 + k, t[a : a + rng.randrange(40)]))
    got = contained.holders(spark.createDataFrame(items, "item_id int, item string"), spark.createDataFrame(texts, "doc_id int, text string")).select("item_id", "doc_id").collect()
    want = sorted((i, d) for i, item in items for d, t in texts if item is not None and t is not None and item in t)
    assert sorted((r["item_id"], r["doc_id"]) for r in got) == want
    plan = contained.holders(spark.createDataFrame(items, "item_id int, item string"), spark.createDataFrame(texts, "doc_id int, text string"))
    assert plan.where("false").collect() == []
