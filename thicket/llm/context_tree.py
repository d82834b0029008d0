"""Language-model scoring by context-tree weighting over bytes, and by unigram counts of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import discarded, short_batches, table, tidy, word_hashes, written

#: Bytes of context.
DEPTH = 5
#: Stands before and after every text; no UTF-8 text has it.
EDGE = 0xFF
#: Bytes of the texts of a block, about, and of a text that is a block of its own. A larger block tells fewer keys a byte, but is in one task's memory.
BLOCK_BYTES, LONG_BYTES = 32 << 20, 4 << 20
#: Bytes of texts that go through numpy at a time.
AT_ONCE = 2 << 20
#: Keys that a task holds before it merges them, and distinct ones before it passes them on.
HOLD = 3 << 19
#: Keys of words have this bit, so they are negative; those of grams don't.
IS_WORD = np.int64(-1 << 63)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null doc_id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- keys of texts


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts, each between edges, one after the other, and where each ends, its edge included."""
    data = bytes([EDGE]) + bytes([EDGE]).join(texts) + bytes([EDGE])
    return data, np.cumsum([len(t) + 1 for t in texts]) + 1


def grams(data: bytes, ends: np.ndarray, depth: int) -> np.ndarray:
    """The key of each byte after the first edge: its context, the nearest byte highest, and itself lowest. What is before a text is edges."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(a) - 1
    key = a[1:].copy()
    since = np.arange(n) - np.repeat(np.concatenate(([0], ends[:-1] - 1)), np.diff(np.concatenate(([1], ends))))  # bytes of the text before this one
    for k in range(1, depth + 1):
        before = np.full(n, EDGE, np.int64)
        before[k - 1 :] = a[: n - k + 1]
        before[since < k] = EDGE
        key |= before << (8 * (depth - k + 1))
    return key


def text_batches(b: pa.RecordBatch, depth: int) -> Iterator[tuple[int, int, bytes, np.ndarray, int, int]]:
    """(first row, one past the last, texts as joined(), their ends, first gram, one past the last) for some AT_ONCE bytes of texts at a time; A-Z are lower-cased, null is empty. A longer text comes in pieces, each from the start of a word on, behind the bytes before it: the grams of these and of an end that isn't the text's don't count."""
    texts = pc.fill_null(b.column("text").cast(pa.binary()), b"")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + AT_ONCE, side="right")))
        part = [t.as_py().lower() for t in texts[k:end]]
        if end > k + 1 or len(part[0]) <= AT_ONCE:
            data, ends = joined(part)
            yield k, end, data, ends, 0, len(data) - 1
        else:
            at = 0
            while at < len(part[0]):
                space = _SPACE.search(part[0], at + AT_ONCE)
                to = space.end() if space else len(part[0])
                lead = part[0][max(at - depth, 0) : at]
                data, ends = joined([lead + part[0][at:to]])
                yield k, end, data, ends, len(lead), len(data) - 1 - (to < len(part[0]))
                at = to
        k = end


def words(data: bytes, ends: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, a 63-bit hash, text it is in) of texts as joined(), without what is before the gram lo; the edges part words."""
    plain = b"\n" * (lo + 1) + data[lo + 1 :].replace(bytes([EDGE]), b"\n")
    h, first, _ = word_hashes(plain, np.array([0, len(plain)]))
    return h.view(np.int64) | IS_WORD, np.searchsorted(ends, first, side="right")


class _Counts:
    """Counts of the distinct keys of a block: (keys, counts) as they come, merged when they are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * train))
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.size = len(first)
        return self.parts[0]


def _keyed(depth: int):
    """(key, block, n): the distinct grams and words of each block's texts with how often training texts have them (0 too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Counts] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, c in held.items():
                keys, n = c.merge()
                for k in range(0, len(keys), 1 << 18):
                    part = keys[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block)), pa.array(n[k : k + (1 << 18)])], names=["key", "block", "n"])
            held.clear()

        for b in batches:
            blocks = b.column("block").to_numpy(zero_copy_only=False)
            train = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for block in np.unique(blocks):
                rows = np.flatnonzero(blocks == block)
                mine = held.setdefault(int(block), _Counts())
                for first, last, data, ends, lo, hi in text_batches(b.take(pa.array(rows)), depth):
                    learn = train[rows[first:last]]
                    of_grams = np.repeat(learn, np.diff(np.concatenate(([1], ends))))[lo:hi]
                    keys = grams(data, ends, depth)[lo:hi]
                    h, text = words(data, ends, lo)
                    for yes in (True, False):
                        mine.add(keys[of_grams == yes], yes)
                        mine.add(h[learn[text] == yes], yes)
                    if mine.size > HOLD:
                        mine.merge()
                if sum(c.size for c in held.values()) > HOLD or len(held) > 64:
                    yield from out()
        yield from out()

    return run


# ---- the tree


_SMALL = np.concatenate(([0.0, 0.0], np.cumsum(np.log(np.arange(1.0, 64.0)))))  # ln (n - 1)! of n
_HALF = 0.5 * np.log(np.pi) + np.concatenate(([0.0], np.cumsum(np.log(np.arange(64) + 0.5))))  # ln of gamma at n + 1/2


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; exact to rounding from 30 on."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of what Krichevsky and Trofimov's estimate gives a sequence of so many zeros and ones."""
    half = lambda n: np.where(n < 64, _HALF[np.minimum(n, 64)], _log_gamma(np.maximum(n, 30) + 0.5))
    whole = np.where(zeros + ones < 63, _SMALL[np.minimum(zeros + ones + 1, 64)], _log_gamma(np.maximum(zeros + ones, 30) + 1.0))
    return half(zeros) + half(ones) - np.log(np.pi) - whole


def bit_nodes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of sorted keys (context and byte) with counts: a node is a context with the bits of the byte so far, as 1 and these bits; counts are of its next bit."""
    out = []
    context, byte = keys >> 8 << 8, keys & 255
    for j in range(8):
        node = context | (1 << j) | (byte >> (8 - j))
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        bit = (byte >> (7 - j)) & 1
        out.append((node[first], np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)))
    node, zeros, ones = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(node, kind="stable")
    return node[order], zeros[order], ones[order]


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(logarithm of the weighted probability of nodes, weight of their own estimate): half the estimate and half the product of what is below, its logarithm; None at the deepest level."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(np.minimum(own - np.log(2) - both, 0.0))


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[tuple]:
    """(node, zeros, ones, logarithm of the weighted probability, weight) of the levels top..depth under one context of `top` bytes, from sorted keys of `depth` bytes of context with counts above 0."""
    levels: list[tuple] = []
    below = None
    for d in range(depth, top - 1, -1):
        shift = 8 * (depth - d)
        k = (keys >> (shift + 8) << 8) | (keys & 255)
        k, at = np.unique(k, return_inverse=True)
        node, zeros, ones = bit_nodes(k, np.bincount(at, weights=n, minlength=len(k)).astype(np.int64))
        s = None
        if below is not None:
            up = (below[0] >> 16 << 8) | (below[0] & 255)
            s = np.bincount(np.searchsorted(node, up), weights=below[3], minlength=len(node))
        below = (node, zeros, ones, *weighted(zeros, ones, s))
        levels.append(below)
    return levels[::-1]


def _runs(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each context of two bytes, from batches sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shift = 8 * (depth - 1)
    for b in batches:
        if not b.num_rows:
            continue
        key, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
        top = key >> shift
        cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
        for k, (a, m) in enumerate(zip(np.split(key, cuts), np.split(n, cuts), strict=True)):
            if held and (k or held[0][0][0] >> shift != a[0] >> shift):
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            held.append((a, m))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _tops(depth: int):
    """(node, zeros, ones, below): the nodes of one byte of context, as far as each context of two bytes tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _runs(depth, batches):
            key, n = key[n > 0], n[n > 0]
            if len(key):
                node, zeros, ones, weight, _ = subtree(key, n, depth, 2)[0]
                yield pa.RecordBatch.from_arrays([pa.array((node >> 16 << 8) | (node & 255)), pa.array(zeros), pa.array(ones), pa.array(weight)], names=["node", "zeros", "ones", "below"])

    return run


def top_levels(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of a one as far as one byte of context tells, the part of it that stays, the share left to longer contexts) by first byte and bits, as arrays of 256 * 256: from the (node, zeros, ones, below) of one byte of context."""
    zeros, ones, below = (np.zeros(65536, kind) for kind in (np.int64, np.int64, np.float64))
    for r in rows:
        zeros[r["node"]], ones[r["node"]], below[r["node"]] = r["zeros"], r["ones"], float(r["below"])
    weight_1, own_1 = weighted(zeros, ones, below)
    kt = lambda z, o: (o + 0.5) / (z + o + 1.0)
    z0, o0, s0 = (x.reshape(256, 256).sum(0) for x in (zeros, ones, weight_1))
    _, own_0 = weighted(z0, o0, s0)
    seen, p0, w0 = np.tile(z0 + o0 > 0, 256), np.tile(kt(z0, o0), 256), np.tile(own_0, 256)
    here = zeros + ones > 0
    final = np.where(here, w0 * p0 + (1 - w0) * kt(zeros, ones), np.where(seen, p0, 0.5))
    return final, w0 * p0 + (1 - w0) * own_1 * kt(zeros, ones), (1 - w0) * (1 - own_1)


def _priced(depth: int, top: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """(key, value): log10 of the chance of each key's byte after its context. Each bit's chance mixes the estimates of all its contexts by their weights; a context that training texts don't have hands on to the next shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _runs(depth, batches):
            levels = subtree(key[n > 0], n[n > 0], depth, 2) if (n > 0).any() else []
            value = np.zeros(len(key))
            byte = key & 255
            for j in range(8):
                bits = (1 << j) | (byte >> (8 - j))
                at = (key >> (8 * depth) << 8) | bits
                p, stays, left = (x[at] for x in top)
                for d, (node, zeros, ones, _, own) in enumerate(levels, 2):
                    mine = (key >> (8 * (depth - d) + 8) << 8) | bits
                    i = np.minimum(np.searchsorted(node, mine), len(node) - 1)
                    hit = node[i] == mine
                    kt = (ones[i] + 0.5) / (zeros[i] + ones[i] + 1.0)
                    p = np.where(hit, stays + left * kt, p)
                    stays, left = np.where(hit, stays + left * own[i] * kt, stays), np.where(hit, left * (1 - own[i]), left)
                value += np.log10(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value)], names=["key", "value"])

    return run


# ---- scores


def _scored(depth: int):
    """Scores of a block's texts (row, text) by the values of its keys (key, value): (row, score, words_score, n_words, n_known, n_bytes)."""

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        keys, value = (values.column(c).to_numpy() for c in ("key", "value"))
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        out: list[list[np.ndarray]] = []
        for b in texts.to_batches():
            row = b.column("row").to_numpy(zero_copy_only=False)
            for first, last, data, ends, lo, hi in text_batches(b, depth):
                each = np.zeros(len(data) - 1)
                each[lo:hi] = value[np.searchsorted(keys, grams(data, ends, depth)[lo:hi])]
                starts = np.concatenate(([1], ends[:-1])) - 1
                h, text = words(data, ends, lo)
                of_words = value[np.searchsorted(keys, h)] if len(h) else np.zeros(0)
                count = lambda w=None: np.bincount(text, weights=w, minlength=last - first)  # noqa: B023, E731
                n_bytes = ends - starts - 2 - lo if last - first == 1 else ends - starts - 2
                out.append([row[first:last], np.add.reduceat(each, starts), count(of_words), count(), count((of_words > 0).astype(float)), n_bytes])
        row, *sums = (np.concatenate(x) for x in zip(*out, strict=True))
        row, at = np.unique(row, return_inverse=True)  # pieces of a text together
        sums = [np.bincount(at, weights=x, minlength=len(row)) for x in sums]
        names = ["row", "score", "words_score", "n_words", "n_known", "n_bytes"]
        return pa.table([pa.array(row), *(pa.array(x if k < 2 else np.rint(x).astype(np.int64)) for k, x in enumerate(sums))], names=names)

    return run


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): every row of docs, scored by models of the rows that aren't held out.

    score: log10 of the probability of the text's UTF-8 bytes, A-Z lower-cased, and its end, by context-tree weighting: each byte is eight binary decisions, each with a tree of the contexts of 0 to `depth` bytes before (2 to 6) and the bits so far; a node mixes, half and half, Krichevsky and Trofimov's estimate of its own counts with the product of its children's, and training fixes what share each depth has in a prediction. A node without counts hands on to the shorter context. bits_per_byte: the code length of text and end over their bytes. base_score: tokens are words and an end; add-one unigram counts, words told apart by 63-bit hashes.

    Null texts count as empty: their end alone is scored. Null doc_ids are trained on. Repeated rows are trained on and scored each. Without training rows every bit has chance one half and base_score is 0. An empty table gives an empty result; other columns aren't looked at.

    Texts are written once, in blocks of some 32 MB. Each block tells its distinct keys (contexts with their byte, words); these are counted over all blocks, the tree is weighted by contexts of two bytes (one byte and none come to the driver, 65,280 rows at most), and each block's keys come back with their values to the block's texts. So what is shuffled is a part of the texts' size, the model is never in one place, and no key's rows are more than the blocks.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is from 2 to 6 bytes")
    spark = docs.sparkSession
    short_batches(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    measured = docs.agg(F.sum(size).alias("total"), F.avg(F.when(size < LONG_BYTES, size)).alias("mean")).first()
    total, mean = measured["total"] or 0, measured["mean"] or 1.0
    d = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), size.alias("size"))
    # a block is in one partition: small ones go together, as far as all cores have one
    d = d.coalesce(max(int(total / BLOCK_BYTES) + 1, spark.sparkContext.defaultParallelism))
    copy = written(d.select(F.monotonically_increasing_id().alias("row"), "*"))
    rows = max(1, int(BLOCK_BYTES / max(mean, 1.0)))
    part = F.shiftright("row", 33) * (1 << 33)
    block = F.when(F.col("size") >= LONG_BYTES, -1 - F.col("row")).otherwise(part + F.expr(f"(row & {(1 << 33) - 1}) div {rows}"))
    d = copy.withColumn("block", block)
    keyed = written(d.select("text", "held_out", "block").mapInArrow(_keyed(depth), "key long, block long, n long"))
    counts = written(keyed.groupBy("key").agg(F.sum("n").alias("n")))
    tidy(spark)
    vocabulary = counts.where("key < 0 and n > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    trained = d.where("not held_out").count()
    total, distinct = vocabulary["n"] + trained, vocabulary["v"] + (trained > 0)
    # the tree: by the two nearest bytes of context
    near = F.shiftright("key", 8 * (depth - 1))
    tree = counts.where("key >= 0").repartition(near).sortWithinPartitions("key")
    tops = tree.mapInArrow(_tops(depth), "node long, zeros long, ones long, below double")
    # decimals: a sum that doesn't depend on the order
    tops = tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(F.col("below").cast("decimal(38,9)")).alias("below"))
    top = top_levels(tops.collect())  # at most 256 * 255 rows
    priced = tree.mapInArrow(_priced(depth, top), "key long, value double")
    known = counts.where("key < 0").select("key", F.log10(F.col("n") + F.lit(1.0)).alias("value"))
    values = written(priced.unionByName(known))
    tidy(spark)
    back = written(keyed.select("key", "block").join(values, "key").select("block", "key", "value"))
    discarded(keyed, counts, values)
    tidy(spark)
    texts = d.select("block", "row", "text")
    told = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored(depth), "row long, score double, words_score double, n_words long, n_known long, n_bytes long")
    told = written(told)
    discarded(back)
    tidy(spark)
    j = d.select("row", "doc_id", "held_out").join(told, "row")
    n = (F.col("n_words") + 1).alias("n_tokens")
    end = float(np.log10(trained + 1))
    base = F.col("words_score") + F.lit(end) - (F.col("n_words") + 1) * F.lit(float(np.log10(total + distinct + 1)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    return j.select("doc_id", "held_out", n, (F.col("n_known") + F.lit(int(trained > 0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() of all documents, one row a row, nulls, empty texts and repeated rows included."""
    return scores(table(spark, sf_dir, "documents"))
