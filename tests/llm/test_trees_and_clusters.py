"""The Merkle manifest, context-tree scores and integer k-means against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import context_tree, kmeans, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("s", "i", "n", "block", "leaf", "row", "key", "size", "q", "norms", "score", "cluster")})


# 11


def by_hand(rows):
    """The whole manifest, each tree built level by level."""
    field = lambda v: b"-" if v is None else b"%d:%s" % (len(v), v)
    enc = lambda v: None if v is None else str(v).encode()
    leaf = lambda r, t: sha(b"".join(field(enc(v)) for v in (r[0], r[3], r[2], r[4])) + field(t))
    groups = defaultdict(list)
    for r in rows:
        t = enc(r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        own = leaf(r, t)
        groups[r[3]].append((r[0] is not None, r[0] or 0, own, leaf(r, t and t.translate(LOWER)) if hit else own))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 16]).encode()) for k in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        return [(i // 16**k % 16, level[i // 16 ** (k + 1) * 16 :][:16]) for k, level in enumerate(tree[:-1])]

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (has, doc, own, tampered) in enumerate(sorted(groups[s])):
            p = path(trees[s], i) + path(top, k)
            proof = sha("".join(d for at, run in p for j, d in enumerate(run) if j != at).encode())
            node = tampered
            for at, run in p:
                node = sha("".join([*run[:at], node, *run[at + 1 :]]).encode())
            out.append((doc if has else None, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def got_of(m):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in m.collect()), key=repr)


@pytest.mark.parametrize("deep", [1, 2, 3])
def test_manifest(spark, monkeypatch, deep):
    """Sources of one row, of one run, of several blocks with a last one of one leaf, more sources than a run; odd rows among them."""
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "BLOCK", 16**deep)
    rng = random.Random(deep)
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "É Ab", None, "b", 4), (3, "X " * 20_000, "en", "b", 40_000), (3, None, "en", "b", None), (None, "A", "", "", 1)]
    ids = iter(rng.sample(range(10, 10**6), 2000))
    for source, n in [("a", 257), ("hot", 600), ("one", 1), ("é", 16), ("z", 17), *[(f"s{k}", 2) for k in range(20)]]:
        rows += [(i, f"Text {i} OF {source}", rng.choice(["en", None]), source, rng.randrange(99)) for _, i in zip(range(n), ids, strict=False)]
    rng.shuffle(rows)
    m = merkle.manifest(clashing(spark.createDataFrame(rows, DOC)))
    got = got_of(m)
    assert got == by_hand(rows)
    assert {True, False} == {r[-1] for r in got}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []
    assert got_of(merkle.manifest(spark.createDataFrame([(5, "a", "en", "x", 1)], DOC))) == by_hand([(5, "a", "en", "x", 1)])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 700, 4096])
def test_traversal_needs_little(n):
    """The scheduled paths are the tree's, and no leaf is looked at more than once a level."""
    leaf = [sha(b"%d" % i) for i in range(n)]
    asked = Counter()

    def at(i):
        asked[i] += 1
        return leaf[i]

    levels = min(3, merkle.levels_of(n))
    tree = [leaf]
    for _ in range(levels):
        tree.append([sha("".join(tree[-1][k : k + 16]).encode()) for k in range(0, len(tree[-1]), 16)])
    for i, path in enumerate(merkle.traversed(at, n, levels)):
        assert path == [(i // 16**k % 16, tree[k][i // 16 ** (k + 1) * 16 :][:16]) for k in range(levels)]
        assert merkle.folded(leaf[i], path) == tree[-1][i // 16**levels]
    assert max(asked.values(), default=0) <= levels


# 12


def brute_force(docs, depth):
    """Counts of every context in a dictionary, weights by recursion, and unigrams."""
    low = lambda t: (t or "").encode().translate(LOWER)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(t):
        data = low(t) + b"\xff"
        for i, c in enumerate(data):
            ctx = (b"\xff" * depth + data[:i])[-depth:][::-1]
            for j in range(8):
                yield ctx, (1 << j) | (c >> (8 - j)), (c >> (7 - j)) & 1

    for i, t in docs:
        for ctx, p, b in bits(t) if not held(i) else ():
            for d in range(depth + 1):
                counts[ctx[:d], p][b] += 1
    for ctx, p in counts:
        if ctx:
            kids[ctx[:-1], p].add((ctx, p))

    def kt(k):
        a, b = counts[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(k):
        if k not in memo:
            own = kt(k)
            memo[k] = own if len(k[0]) == depth else float(np.logaddexp(own, sum(map(weighted, kids[k])))) - math.log(2)
        return memo[k]

    def one(ctx, p, d=0):
        a, b = counts[ctx[:d], p]
        est = (b + 0.5) / (a + b + 1)
        if d == depth or (ctx[: d + 1], p) not in counts:
            return est
        w = math.exp(kt((ctx[:d], p)) - math.log(2) - weighted((ctx[:d], p)))
        return w * est + (1 - w) * one(ctx, p, d + 1)

    tokens = lambda t: [w for w in re.split(rb"[\x20\x09-\x0D]+", low(t)) if w] + [None]
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n = sum(c.values())
    out = []
    for i, t in docs:
        s = 0.0
        for ctx, p, b in bits(t):
            q = one(ctx, p) if (b"", p) in counts else 0.5
            s += math.log10(q if b else 1 - q)
        w = tokens(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), s))
    return out


def sentences(rng, n):
    return [(i, " ".join(rng.choice(["the", "Cat", "sat", "on", "é", "mat", f"zzz{rng.randrange(9)}"]) for _ in range(rng.randrange(1, 30)))) for i in range(n)]


@pytest.mark.parametrize("depth,at_once,trained", [(2, 1 << 23, True), (5, 1 << 23, True), (5, 16, True), (3, 64, False)])
def test_scores(spark, monkeypatch, depth, at_once, trained):
    """Odd rows among plain ones; texts in pieces; no training rows."""
    monkeypatch.setattr(context_tree, "AT_ONCE", at_once)
    rng = random.Random(depth)
    docs = [*sentences(rng, 40), (50, None), (51, ""), (None, "a  b\n"), (60, "\t \n"), (61, "never seen Ω words"), (7, "twice"), (7, "twice")]
    if not trained:
        docs = [d for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in context_tree.scores(df, depth).collect()), key=lambda r: (repr(r[:5]), r[6]))
    want = sorted(brute_force(docs, depth), key=lambda r: (repr(r[:5]), r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=0, atol=1e-6)


def test_scores_of_nothing_and_of_much(spark, monkeypatch):
    assert context_tree.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    monkeypatch.setattr(context_tree, "LONG_BYTES", 1000)  # such texts are blocks of their own
    docs = [*sentences(random.Random(9), 30), (100, "long text " * 500), (101, "x" * 5000)]
    got = {r["doc_id"]: r["score"] for r in context_tree.scores(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    want = {r[0]: r[6] for r in brute_force(docs, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_chances_sum_to_one(spark):
    """Over all one-byte ends of a text the model's chances add up to 1: it is a distribution over bytes."""
    rng = random.Random(4)
    docs = sentences(rng, 30)
    keys = np.sort(np.concatenate([context_tree.grams(*context_tree.joined([t.lower().encode()]), 3) for _, t in docs]))
    keys, n = np.unique(keys, return_counts=True)
    seen = int(keys[len(keys) // 2]) >> 8
    for context in (seen, 0x7A7A7A, seen ^ 0x010000):
        asked = np.array([(context << 8) | b for b in range(256)])
        rest = ~np.isin(keys, asked)
        all_keys = np.concatenate((keys[rest], asked))
        all_n = np.concatenate((n[rest], [int(n[keys == a][0]) if (keys == a).any() else 0 for a in asked]))
        order = np.argsort(all_keys)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(all_keys[order]), pa.array(all_n[order])], names=["key", "n"])
        sums = defaultdict(lambda: [0, 0, 0.0])
        for b in context_tree._tops(3)([batch]):
            for r in b.to_pylist():
                for k, c in enumerate(("zeros", "ones", "below")):
                    sums[r["node"]][k] += r[c]
        top = context_tree.top_levels([{"node": k, "zeros": z, "ones": o, "below": w} for k, (z, o, w) in sums.items()])
        value = {k: v for b in context_tree._priced(3, top)([batch]) for k, v in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True)}
        assert abs(sum(10 ** value[int(a)] for a in asked) - 1) < 1e-9


def test_held_out_texts_code_better(spark):
    """Texts of the trained kind cost fewer bits a byte than shuffled ones."""
    rng = random.Random(5)
    docs = sentences(rng, 300)
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 7 == 2]
    like, unlike = held[: len(held) // 2], held[len(held) // 2 :]
    more = sentences(rng, len(held))
    docs += [(i, t) for i, (_, t) in zip(like, more, strict=False)]
    docs += [(i, "".join(rng.sample(t, len(t)))) for i, (_, t) in zip(unlike, more, strict=False)]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in context_tree.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert max(bits[i] for i in like) < min(bits[i] for i in unlike)


# 13


def plain_k_means(rows, k, rounds, seed):
    """Every distance measured."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((sha(f"{seed}:{'' if i is None else i}".encode()), q) for i, q in kept)[:k]
    c = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(c)):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=repr), c


def test_k_means(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [1.0] * 63 + [None]), (405, [math.nan] * 64), (406, [math.inf] * 64), (None, [0.5] * 64)]
    rows += [(500, [2.0] * 64)] * 100 + [(501, [0.0] * 64), (501, [-0.001] * 64)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    for k, rounds in ((8, 10), (3, 1), (1, 2), (500, 1)):
        got, centroids = kmeans.k_means(df, k, rounds, "3")
        want, c = plain_k_means(rows, k, rounds, "3")
        assert centroids.tolist() == c
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=repr) == want


def test_screening_saves_distances():
    """The bounds never cut the nearest centroid, and cut most of the others where clusters lie apart."""
    rng = np.random.default_rng(1)
    centroids = (rng.normal(size=(8, 64)) * 3000 * np.arange(1, 9)[:, None]).astype(np.int64)
    q = centroids[rng.integers(0, 8, 5000)] + rng.integers(-500, 500, (5000, 64))
    best, least, exact = kmeans.screened(q, kmeans.segment_norms(q), (q * q).sum(1), centroids)
    d = ((q[:, None, :] - centroids) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    assert exact.mean() < 3


def test_k_means_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert kmeans.k_means(spark.createDataFrame([], kind))[0].collect() == []
    assert kmeans.k_means(spark.createDataFrame([(1, None)], kind))[0].collect() == []
    rows, c = kmeans.k_means(spark.createDataFrame([(1, [0.5] * 64)], kind))
    assert len(c) == 1 and [(r["vec_id"], r["cluster"], r["distance"]) for r in rows.collect()] == [(1, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        kmeans.k_means(spark.createDataFrame([(1, [1e9] * 64)], kind))
