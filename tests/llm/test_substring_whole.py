"""Substring dedup against what it must not leave behind: recall of the bands, words beside units, keys of several groups, paragraphs, short texts."""

import random

import numpy as np

from thicket.llm import substring_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, of="w"):
    return [f"{of}{i}" for i in rng.sample(range(10**6), n)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOC)


def test_units_are_dense_and_bands_find_similar_ones():
    words = np.random.default_rng(1).integers(0, 1 << 62, 50_000, dtype=np.uint64)
    at = substring_dedup.starts_of(words, np.array([len(words)]))
    assert np.diff(at).max() <= substring_dedup.WINDOW  # every window has an anchor
    assert 1 - (1 - 0.8**substring_dedup.ROWS) ** substring_dedup.BANDS >= 0.97


def test_no_words_of_a_passage_stay(spark):
    rng = random.Random(2)
    texts, passages = [], []
    for n in (51, 80, 120, 300) * 5:
        p = prose(rng, n)
        passages.append(set(p))
        for _ in range(2):
            texts.append(" ".join(prose(rng, rng.randrange(30, 90), "x") + p + prose(rng, rng.randrange(30, 90), "x")))
    clean = {r["doc_id"]: r["text"].split() for r in substring_dedup.cleaned(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        left = sum(w in passages[i // 2] for w in clean[i])
        assert left == (0 if i % 2 else len(passages[i // 2]))
        lost = [w for w in text.split() if w not in passages[i // 2] and w not in clean[i]]
        assert len(lost) <= 2 * (i % 2)  # a unit over an end of the passage is similar if one word of it is outside


def test_every_two_units_of_a_key_are_compared(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(12):  # pairs that differ in the last word; of no likeness to other pairs
        p = prose(rng, 20)
        texts += [" ".join(p), " ".join(p[:-1] + ["other" + p[0]])]
    monkeypatch.setattr(substring_dedup, "ROWS", 0)  # one key for all in each band
    monkeypatch.setattr(substring_dedup, "WINDOW", 1)  # every 20 words are a unit
    found = {r["doc_id"]: r["kept"] for r in substring_dedup.repeats(docs_of(spark, texts)).collect()}
    assert found == {i: [i - 1] for i in range(1, 24, 2)}


def test_near_copies_of_paragraphs(spark):
    rng = random.Random(4)
    texts, similar = [], []
    for n in (51, 60, 80, 100) * 10:
        p = prose(rng, n)
        q = p[: n // 2] + ["changed"] + p[n // 2 + 1 :]
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (p, q))
        similar.append(len(a & b) / len(a | b))
        texts += ["\n".join([" ".join(prose(rng, 45, "x")), " ".join(x), " ".join(prose(rng, 45, "x"))]) for x in (p, q)]
    assert 0.8 <= min(similar) and max(similar) <= 0.91
    clean = {r["doc_id"]: r["text"].split() for r in substring_dedup.cleaned(docs_of(spark, texts)).collect()}
    gone = sum(all(w.startswith("x") for w in clean[i]) for i in range(1, len(texts), 2))
    assert gone >= 38 and all(len(clean[i]) == len(texts[i].split()) for i in range(0, len(texts), 2))


def test_short_texts(spark):
    rng = random.Random(5)
    texts = ["yes", "yes", "a b c d e f g h i j", "a b c d e f g h i j"]
    for n in (25, 33, 40):
        p = prose(rng, n)
        texts += [" ".join(p), " ".join(p[:-1] + ["changed"])]
    found = {r["doc_id"]: r["kept"] for r in substring_dedup.repeats(docs_of(spark, texts)).collect()}
    assert found == {i: [i - 1] for i in range(1, len(texts), 2)}


def test_words_are_removed_whatever_the_edits(spark):
    """Shares of the words of a copied passage that go, by its length and edits."""
    rng = random.Random(6)
    kinds = [(25, 0), (60, 0), (200, 0), (60, 20), (100, 20), (200, 20), (200, 50)]
    texts, passages = [], []
    for n, gap in kinds * 25:
        p = prose(rng, n)
        q = [f"edit{i}" if gap and i % gap == gap - 1 else w for i, w in enumerate(p)]
        passages.append(set(p))
        texts += [" ".join(prose(rng, rng.randrange(30, 90), "x") + x + prose(rng, rng.randrange(30, 90), "x")) for x in (p, q)]
    clean = {r["doc_id"]: r["text"].split() for r in substring_dedup.cleaned(docs_of(spark, texts)).collect()}
    left, size = dict.fromkeys(kinds, 0), dict.fromkeys(kinds, 0)
    for k, p in enumerate(passages):
        kind = (kinds * 25)[k]
        size[kind] += sum(w in p for w in texts[2 * k + 1].split())
        left[kind] += sum(w in p for w in clean[2 * k + 1])
        assert clean[2 * k] == texts[2 * k].split()  # the first document keeps it
    share = {k: 1 - left[k] / size[k] for k in kinds}
    assert all(share[k] >= (0.9 if k[1] == 20 else 0.95) for k in kinds), share


def test_like_brute_force(spark):
    """Random texts with shared stretches: a word goes only if it lies in a stretch of 20 words or so that an earlier document has, and every such stretch of 23 words or more goes."""
    rng = random.Random(7)
    pool = [prose(rng, 80, "p") for _ in range(15)]
    texts = []
    for _ in range(60):
        out = prose(rng, rng.randrange(5, 40), "x")
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(60)
            out += p[a : a + rng.randrange(5, 60)] + prose(rng, rng.randrange(3, 30), "x")
        texts.append(" ".join(out))
    seen, must = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        must[i] = {w[k + j] for k in range(len(w) - 22) if tuple(w[k : k + 23]) in seen for j in range(23)}
        for k in range(len(w) - 22):
            seen.setdefault(tuple(w[k : k + 23]), i)
    clean = {r["doc_id"]: set(r["text"].split()) for r in substring_dedup.cleaned(docs_of(spark, texts)).collect()}
    assert sum(map(len, must.values())) > 300
    assert sum(len(must[i] & clean.get(i, set())) for i in must) <= 0.02 * sum(map(len, must.values()))
    for i, t in enumerate(texts):
        assert all(w.startswith("p") for w in set(t.split()) - clean.get(i, set()) - must[i])


def test_earlier_pieces_of_a_passage(spark):
    """Earlier documents hold pieces of 18 words, too short to go, of a passage that two later ones share: it goes from the second whole."""
    rng = random.Random(11)
    texts, whole = [], []
    for n in (36, 54, 90, 200) * 8:
        p = prose(rng, n)
        order = list(range(0, n - 17, 9))
        rng.shuffle(order)
        texts += [" ".join(prose(rng, 20, "x") + p[k : k + 18] + prose(rng, 20, "x")) for k in order]
        texts += [" ".join(prose(rng, 30, "x") + p + prose(rng, 30, "x")) for _ in range(2)]
        whole.append((len(texts) - 1, set(p)))
    clean = {r["doc_id"]: set(r["text"].split()) for r in substring_dedup.cleaned(docs_of(spark, texts)).collect()}
    left = [len(p & clean[i]) / len(p) for i, p in whole]
    assert max(left) == 0
    gone = {i for i, _ in whole}
    assert all(clean[i] == set(t.split()) for i, t in enumerate(texts) if i not in gone)


def test_frequent_lines_and_repeats_inside(spark):
    line, rng = " ".join(prose(random.Random(8), 11)), random.Random(9)
    texts = ["\n".join([" ".join(prose(rng, 30, "x")), line, " ".join(prose(rng, 30, "x"))]) for _ in range(40)]  # too short to go
    p = " ".join(prose(rng, 40))
    texts.append("\n".join([p, " ".join(prose(rng, 30, "x")), p]))  # a repeat inside one document stays
    assert substring_dedup.repeats(docs_of(spark, texts)).count() == 0
