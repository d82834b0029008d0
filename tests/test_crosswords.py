"""Crossword fills against trying all words in all slots."""

import itertools
import random

from thicket.operators import crosswords

SLOTS = {"h1": [0, 1, 2], "v1": [0, 3, 6], "h2": [3, 4, 5], "v3": [2, 5, 8]}


def puzzles(seed):
    """Boards of few and of many words (more than a word of bits), one without words for the last slot, repeated words of different score, words of another length."""
    rng = random.Random(seed)
    rows = []
    for board, n in ((1, 8), (2, 90), (3, 20), (4, 1)):
        words = sorted({"".join(rng.choice("abc") if n < 50 else rng.choice("abcdef") for _ in range(3)) for _ in range(n)})
        for slot in SLOTS:
            if (board, slot) == (3, "v3"):
                continue
            rows += [(board, slot, w, float(rng.randrange(5))) for w in words if n < 50 or rng.random() < 0.9]
    rows += [(1, "h1", rows[0][2], 9.0), (1, "h1", "long", 99.0), (1, "v1", "é" * 3, 1.0), (5, "v1", "abc", 1.0)]
    return rows


def by_hand(rows, max_per_state=None, total_states=None):
    names = list(SLOTS)
    best = {}
    for b, s, w, x in rows:
        if len(w) == 3:
            best[b, s, w] = max(x, best.get((b, s, w), x))
    out = set()
    for board in {b for b, _, _ in best}:
        left = [total_states if total_states is not None else 10**9]

        def go(fill, score, board=board, left=left):
            t = len(fill)
            if t == len(names):
                out.add((board, tuple(fill), score, True))
                return
            cells = {c: w[k] for s, w in zip(names, fill, strict=False) for k, c in enumerate(SLOTS[s])}
            fit = sorted((-x, w) for (b, s, w), x in best.items() if b == board and s == names[t] and all(cells.get(c, w[k]) == w[k] for k, c in enumerate(SLOTS[s])))
            if not fit:
                out.add((board, tuple(fill), score, False))
            for x, w in fit[:max_per_state]:
                if left[0] > 0:
                    left[0] -= 1
                    go([*fill, w], score - x)

        go([], 0.0)
    return out


def test_fills(spark):
    for seed, caps in itertools.product((1, 2), ({}, {"max_per_state": 2}, {"max_per_state": 3, "total_states": 17})):
        rows = puzzles(seed)
        sets = crosswords.slot_sets(spark.createDataFrame(rows, "board int, slot string, word string, score double"), "board", {k: len(v) for k, v in SLOTS.items()})
        got = {(r["board"], tuple(r["fill"]), r["score"], r["complete"]) for r in crosswords.fills(sets, "board", SLOTS, **caps).collect()}
        assert got == by_hand(rows, **caps)


def test_no_boards(spark):
    sets = crosswords.slot_sets(spark.createDataFrame([], "board int, slot string, word string, score double"), "board", {"h1": 3})
    assert crosswords.fills(sets, "board", {"h1": [0, 1, 2]}).collect() == []


def test_counted_like_all_fills(spark):
    for seed in (1, 2):
        rows = puzzles(seed)
        want = {}
        for board, fill, score, whole in by_hand(rows):
            if whole:
                n, best = want.get(board, (0, (0.0, ())))
                want[board] = n + 1, min((-score, fill), best) if n else (-score, fill)
        got = crosswords.counted(spark.createDataFrame(rows, "board int, slot string, word string, score double"), "board", SLOTS).collect()
        assert {r["board"]: (r["n_fills"], (-r["score"], tuple(r["fill"]))) for r in got} == want and len(want) > 1


def test_ends_are_one_chain_of_joins(spark):
    """Levels aren't computed anew for each level's ends: one join a level."""
    sets = crosswords.slot_sets(spark.createDataFrame(puzzles(1), "board int, slot string, word string, score double"), "board", {k: len(v) for k, v in SLOTS.items()})
    plan = crosswords.fills(sets, "board", SLOTS, max_per_state=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == len(SLOTS)
