"""Alignments and longest common subsequences of many pairs of sequences at once, in numpy over Arrow batches.

Pairs of a batch are taken by like sizes, so that padding stays small, and in runs whose arrays have a bounded number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

PLACES = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
ALIGNED = StructType([StructField("cost", LongType()), StructField("pairs", ArrayType(PLACES))])
#: What a gap costs, and what a pair of steps without a common word costs; whole numbers, so that ties are ties.
GAP, WHOLE = 600_000, 1_000_000
#: Cells of the arrays of one run of pairs, and pairs of a batch that are taken at once.
CELLS, AT_ONCE = 500_000, 500


def _lists(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(lengths, values one after the other) of a list array; null lists are empty."""
    return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64), a.flatten()


def _runs(n: np.ndarray, m: np.ndarray, cells) -> Iterator[np.ndarray]:
    """Pairs in runs: sizes n and m up to the same powers of two together, as many as `cells` of the run's largest sizes allow."""
    up = lambda x: np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)
    order = np.lexsort((up(m), up(n)))
    kind = up(n)[order] * 64 + up(m)[order]
    for part in np.split(order, np.flatnonzero(kind[1:] != kind[:-1]) + 1):
        if len(part):
            at_once = max(1, CELLS // max(1, cells(int(n[part].max()), int(m[part].max()))))
            for k in range(0, len(part), at_once):
                yield part[k : k + at_once]


def _padded(values: np.ndarray, begin: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """The lists as rows of one array, filled up on the right."""
    place = np.arange(max(int(size.max()), 1))
    inside = place < size[:, None]
    out = np.full(inside.shape, fill, np.int64)
    out[inside] = values[(begin[:, None] + place)[inside]]
    return out


def lcs_of(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of a and of b, padded by -1 and -2; m: sizes of b's rows.

    Bit-parallel: a bit for each place of b, 64 a word. With V all ones, each symbol of a in turn takes U = V and its places, V = (V + U) or (V without U); V's zeros are the length. The carry of the sum goes from word to word.
    """
    words = -(-b.shape[1] // 64)
    v = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    wide = np.full((len(b), words * 64), -2, np.int64)
    wide[:, : b.shape[1]] = b
    for i in range(a.shape[1]):
        u = v & np.packbits(wide == a[:, i, None], axis=1, bitorder="little").view(np.uint64)
        s = v + u
        carry = s < v
        while carry[:, :-1].any():
            carry = np.concatenate((np.zeros((len(s), 1), bool), carry[:, :-1]), axis=1)
            more = s + carry
            carry, s = more < s, more
        v = s | (v & ~u)
    zeros = np.unpackbits((~v).view(np.uint8), axis=1, bitorder="little")
    return (zeros & (np.arange(words * 64) < m[:, None])).sum(1)


@F.arrow_udf(LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two arrays; null arrays are empty, null elements are equal."""
    (n, x), (m, y) = _lists(a), _lists(b)
    ids = pa.chunked_array([x, y]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = ids[: len(x)], ids[len(x) :]
    at_x, at_y = np.cumsum(n) - n, np.cumsum(m) - m
    out = np.zeros(len(n), np.int64)
    for part in _runs(n, m, lambda p, q: p + q + 128):
        out[part] = lcs_of(_padded(x, at_x[part], n[part], -1), _padded(y, at_y[part], m[part], -2), m[part])
    return pa.array(out)


def least_costs(cost: np.ndarray, n: np.ndarray, m: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(least cost, pairs of places, -1 for a gap) of the global alignment of each pair: cost (pairs, rows, columns), of which n rows and m columns are its own. On ties a match comes before a gap in the second, that before one in the first, from the end.

    The cells of an anti-diagonal depend on the two before it alone, so one is computed for all pairs and places at once; where each cell came from is kept in two bits.
    """
    k_pairs, rows, cols = cost.shape
    far = np.int64(1) << 60
    i = np.arange(rows + 1)
    before = last = np.full((k_pairs, rows + 1), far)
    total = np.zeros(k_pairs, np.int64)
    bits = []
    for k in range(rows + cols + 1):
        j = k - i
        inside = (j >= 0) & (j <= cols)
        if k == 0:
            best = np.where(i == 0, 0, far) + np.zeros((k_pairs, 1), np.int64)
            way = np.zeros((k_pairs, rows + 1), np.uint8)
        else:
            match = np.full((k_pairs, rows + 1), far)
            use = np.flatnonzero(inside & (i > 0) & (j > 0))
            match[:, use] = before[:, use - 1] + cost[:, use - 1, j[use] - 1]
            up = np.full((k_pairs, rows + 1), far)
            up[:, 1:] = last[:, :-1] + gap
            left = last + gap
            best = np.minimum(np.minimum(match, up), left)
            way = np.where(best == match, 0, np.where(best == up, 1, 2)).astype(np.uint8)
            best[:, ~inside] = far
        bits.append((np.packbits(way & 1, axis=1), np.packbits(way >> 1, axis=1)))
        ends = np.flatnonzero(n + m == k)
        total[ends] = best[ends, n[ends]]
        before, last = last, best
    pairs: list[list[tuple[int, int]]] = [[] for _ in range(k_pairs)]
    i, j = n.copy(), m.copy()
    live = np.flatnonzero(i + j > 0)
    low, high = (np.stack(x) for x in zip(*bits, strict=True))
    while len(live):
        p, q = i[live], j[live]
        at = (p + q, live, p >> 3)
        shift = 7 - (p & 7).astype(np.uint8)
        way = ((low[at] >> shift) & 1) + 2 * ((high[at] >> shift) & 1)
        way = np.where(q == 0, 1, np.where(p == 0, 2, way))
        i[live] -= way != 2
        j[live] -= way != 1
        for r, w, p_, q_ in zip(live.tolist(), way.tolist(), i[live].tolist(), j[live].tolist(), strict=True):
            pairs[r].append((p_ if w != 2 else -1, q_ if w != 1 else -1))
        live = live[i[live] + j[live] > 0]
    return total, [p[::-1] for p in pairs]


def jaccard_costs(x: np.ndarray, y: np.ndarray, x_step: np.ndarray, y_step: np.ndarray, x_pair: np.ndarray, y_pair: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """(pairs, rows, columns): WHOLE less the share of common words, in whole units, of each step of x and of y; words of a step are there once. Common words are found by one sorted join of (pair, word)."""
    n_words = int(max(x.max(initial=0), y.max(initial=0))) + 1
    key_x, key_y = x_pair * n_words + x, y_pair * n_words + y
    order = np.argsort(key_y, kind="stable")
    key_y, step_y = key_y[order], y_step[order]
    lo, hi = np.searchsorted(key_y, key_x, "left"), np.searchsorted(key_y, key_x, "right")
    many = hi - lo
    row = np.repeat(np.arange(len(x)), many)
    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    k, rows, cols = shape
    common = np.bincount((x_pair[row] * rows + x_step[row]) * cols + step_y[other], minlength=k * rows * cols).reshape(shape)
    in_x = np.bincount(x_pair * rows + x_step, minlength=k * rows).reshape(k, rows, 1)
    in_y = np.bincount(y_pair * cols + y_step, minlength=k * cols).reshape(k, 1, cols)
    either = in_x + in_y - common
    return np.where(either > 0, WHOLE - WHOLE * common // np.maximum(either, 1), 0)


def aligned_pairs(a: pa.Array, b: pa.Array) -> pa.Array:
    """The alignment of arrays of steps, each an array of its different words."""
    (n, steps_x), (m, steps_y) = _lists(a), _lists(b)
    (wx, x), (wy, y) = _lists(steps_x), _lists(steps_y)
    ids = pa.chunked_array([x, y]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = ids[: len(x)], ids[len(x) :]
    sides = []
    for size, words, value in ((n, wx, x), (m, wy, y)):
        pair_of_step = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        sides.append((np.repeat(pair_of_step, words), np.repeat(place, words), value))
    cost_out, pairs_out = np.zeros(len(n), np.int64), [[] for _ in range(len(n))]
    for part in _runs(n, m, lambda p, q: (p + 1) * (q + 1)):
        new = np.full(len(n), -1)
        new[part] = np.arange(len(part))
        mine = []
        for pair, step, value in sides:
            use = new[pair] >= 0
            mine.append((new[pair[use]], step[use], value[use]))
        (px, sx, vx), (py, sy, vy) = mine
        shape = (len(part), max(int(n[part].max()), 1), max(int(m[part].max()), 1))
        total, pairs = least_costs(jaccard_costs(vx, vy, sx, sy, px, py, shape), n[part], m[part])
        cost_out[part] = total
        for k, p in zip(part.tolist(), pairs, strict=True):
            pairs_out[k] = [{"a": i, "b": j} for i, j in p]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(cost_out), pa.array(pairs_out, kind)], names=["cost", "pairs"])


@F.arrow_udf(ALIGNED)
def _aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    """aligned_pairs() of a batch, AT_ONCE pairs at a time: what a worker holds doesn't follow the batch."""
    return pa.concat_arrays([aligned_pairs(a.slice(k, AT_ONCE), b.slice(k, AT_ONCE)) for k in range(0, max(len(a), 1), AT_ONCE)])


def step_words(steps: Column) -> Column:
    """The different words of each step: lower-cased, by white space; null steps have none."""
    return F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s: F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(s, F.lit(""))), r"\s+"), "")))


def aligned(a: Column, b: Column) -> Column:
    """struct(cost, pairs) of the best global alignment of two arrays of steps: a pair costs a million less the millionths of words it shares (of those in either), a gap 600,000. pairs: array of struct(a, b), places from 0 or -1 for a gap. Null arrays have no steps, and steps without words are alike."""
    return _aligned(step_words(a), step_words(b))
