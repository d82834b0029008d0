"""Substring dedup: MinHash banding of paragraphs with exact Jaccard and components, and anchors whose matches are grown to the whole shared passage."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import jaccard_join
from thicket.llm.common import (
    GOLDEN,
    WORD,
    combined,
    components,
    discarded,
    index_schema,
    links_by_key,
    mixed,
    packed,
    shingles,
    short_batches,
    table,
    tidy,
    unpacked,
    with_small,
    word_batches,
    written,
)

#: Words of the shortest passage and of the shortest paragraph (line) that are removed. Shorter texts take part as a whole.
UNIT = 20
#: Words of an anchor, and the window of places from which one is picked, by content: a run of SEED + WINDOW - 1 equal words has an anchor in common wherever it stands.
SEED, WINDOW = 8, 16
#: Bands and rows: paragraphs of similarity 0.8 share a band with probability 1 - (1 - 0.8^3)^8 = 0.997, of 0.9 with 0.99999, equal ones always.
BANDS, ROWS = 8, 3
SHINGLE = 5
#: Matches are grown inside blocks of the kept text: BLOCK words, and REACH more on either side. A run that goes on for longer has its next anchor in the next block.
BLOCK, REACH = 128, 48
WIDE = BLOCK + SEED + 2 * REACH
#: Growing goes on behind an edit of at most two words on either side if this many words after it are equal.
CONFIRM = 5
#: The edits that are tried, as words skipped in the one and the other text.
EDITS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)]
#: A grown match counts if this share of its words is equal, in percent; else the run of equal words alone.
ALIKE = 80
VALS = {"h": "long"}
SEEDS = {"id": "long", "pos": "int"}


def starts_of(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places (over all texts) of the anchors: of each WINDOW places in a row the one with the least hash of its SEED words; the one of the whole text where it has fewer places."""
    fp = shingles(words, SEED)
    begin = np.concatenate(([0], ends[:-1]))
    places = np.maximum(ends - begin - SEED + 1, 0)
    at = [np.zeros(0, np.int64)]
    if len(fp) >= WINDOW:
        w = np.arange(len(fp) - WINDOW + 1)
        at.append((w + np.lib.stride_tricks.sliding_window_view(fp, WINDOW).argmin(1))[w + WINDOW + SEED - 1 <= np.repeat(ends, ends - begin)[: len(w)]])
    few = np.flatnonzero((places > 0) & (places < WINDOW))
    if len(few):
        own = np.repeat(few, places[few])
        i = np.arange(len(own)) - np.repeat(np.cumsum(places[few]) - places[few], places[few]) + begin[own]
        order = np.lexsort((i, fp[i], own))
        at.append(i[order][np.concatenate(([True], own[order][1:] != own[order][:-1]))])
    return np.unique(np.concatenate(at))


def _once(ids: np.ndarray) -> np.ndarray:
    """Which texts are the first of their id."""
    once = np.zeros(len(ids), bool)
    once[np.unique(ids, return_index=True)[1]] = True
    return once


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of all anchors: where they are, under the hash of their words. Copies in the batch give theirs once."""
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for first, last, words, ends, _ in word_batches(b.column("text")):
            at = starts_of(words, ends)
            text = np.searchsorted(ends, at, side="right")
            pos = at - np.concatenate(([0], ends[:-1]))[text]
            key = shingles(words, SEED)[at]
            # of equal anchors in WINDOW places of a text, which is periodic there, one is enough
            near = np.zeros(len(at), bool)
            near[np.unique(mixed(key + mixed((text << 32 | pos // WINDOW).astype(np.uint64))), return_index=True)[1]] = True
            use = near & _once(ids[first:last])[text]
            if use.any():
                yield combined(list(SEEDS), key[use].view(np.int64), [ids[first + text[use]], pos[use].astype(np.int32)])


def paragraphs(words: np.ndarray, ends: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place over all texts, words) of the paragraphs of texts: lines of UNIT words or more, and the whole of each text that may have too few words for anchors to tell."""
    begin = np.concatenate(([0], ends[:-1]))
    lines = np.flatnonzero(line)
    size = np.diff(np.concatenate((lines, [len(words)])))
    short = (ends > begin) & (ends - begin < UNIT + SEED + WINDOW - 2)
    at = np.concatenate((lines[size >= UNIT], begin[short]))
    n = np.concatenate((size[size >= UNIT], (ends - begin)[short]))
    at, n = np.unique(np.stack((at, n)), axis=1)
    return at, n


def _texts(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each paragraph, in order."""
    starts = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(starts, n)
    each = mixed(words[np.repeat(at, n) + place] ^ mixed(place.astype(np.uint64) * GOLDEN))
    return mixed(np.add.reduceat(each, starts) + n.astype(np.uint64)).view(np.int64) if len(n) else np.zeros(0, np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, id, n_words, units): of each row its text's hash, words, and paragraphs as (h, pos, n): hash, first word, words."""
    for b in batches:
        for first, last, words, ends, line in word_batches(b.column("text")):
            at, n = paragraphs(words, ends, line)
            text = np.searchsorted(ends, at, side="right")
            begin = np.concatenate(([0], ends[:-1]))
            order = np.argsort(text, kind="stable")
            at, n, text = at[order], n[order], text[order]
            units = pa.StructArray.from_arrays([pa.array(_texts(words, at, n)), pa.array((at - begin[text]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "pos", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32)), units)
            rows = b.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("id"), pa.array(ends - begin), lists], names=["doc_id", "id", "n_words", "units"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of the paragraphs' texts under their band keys."""
    odd = np.random.default_rng(1).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for first, last, words, ends, line in word_batches(b.column("text")):
            at, n = paragraphs(words, ends, line)
            once = _once(ids[first:last])[np.searchsorted(ends, at, side="right")]
            at, n = at[once], n[once]
            if not len(at):
                continue
            h = _texts(words, at, n)
            fresh = np.unique(h, return_index=True)[1]
            h, at, n = h[fresh], at[fresh], n[fresh]
            # the shingles of all paragraphs one after the other; one of fewer than SHINGLE words is one, its text
            size = np.maximum(n - SHINGLE + 1, 1)
            starts = np.cumsum(size) - size
            place = np.repeat(at - starts, size) + np.arange(size.sum())
            h5 = shingles(words, SHINGLE)
            h5 = h5[np.minimum(place, len(h5) - 1)] if len(h5) else np.zeros(len(place), np.uint64)
            h5[starts[n < SHINGLE]] = h[n < SHINGLE].view(np.uint64)
            keys = []
            for k in range(BANDS):
                key = np.full(len(h), k + 1, np.uint64)
                for r in range(ROWS):
                    key = mixed(key + np.minimum.reduceat(h5 * odd[k * ROWS + r], starts))
                keys.append(key.view(np.int64))
            yield combined(list(VALS), np.concatenate(keys), [np.tile(h, BANDS)])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked of a text. For each of `units` (h, pos, n): id (that h), n, sketch, el: its distinct shingles, their number and parity sketch. For each of `blocks`, a first word s: id, start s, words: 32-bit hashes of the WIDE words from s - REACH on, 0 outside the text."""
    empty = {"start": pa.int32(), "words": pa.list_(pa.int32()), "n": pa.int64(), "sketch": pa.binary(), "el": pa.list_(pa.int64())}

    def out(ids: pa.Array, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[cols.get(k, pa.nulls(len(ids), t)) for k, t in empty.items()]], names=["id", *empty])

    for b in batches:
        ids, units, blocks = (b.column(k).to_pylist() for k in ("id", "units", "blocks"))
        for first, last, words, ends, _ in word_batches(b.column("text")):
            begin = np.concatenate(([0], ends[:-1]))
            h5 = shingles(words, SHINGLE).view(np.int64)
            want = [(begin[i] + u["pos"], u["n"], u["h"]) for i in range(last - first) for u in units[first + i] or ()]
            for k in range(0, len(want), 1024):
                part = want[k : k + 1024]
                sets = [np.unique(h5[at : at + n - SHINGLE + 1]) if n >= SHINGLE else np.array([h]) for at, n, h in part]
                size = np.array([len(x) for x in sets])
                bits = np.zeros((len(sets), jaccard_join.SKETCH), np.uint8)
                np.add.at(bits, (np.repeat(np.arange(len(sets)), size), (np.concatenate(sets) >> 8) & (jaccard_join.SKETCH - 1)), 1)
                sketch = [x.tobytes() for x in np.packbits(bits & 1, axis=1)]
                el = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield out(pa.array([h for _, _, h in part], pa.int64()), n=pa.array(size), sketch=pa.array(sketch, pa.binary()), el=el)
            low = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1).view(np.int32)
            want = [(i, s) for i in range(last - first) for s in blocks[first + i] or ()]
            for k in range(0, len(want), 1024):
                text, s = np.array(want[k : k + 1024]).T
                place = (begin[text] + s - REACH)[:, None] + np.arange(WIDE)
                inside = (place >= begin[text][:, None]) & (place < ends[text][:, None])
                got = np.where(inside, low[np.clip(place, 0, len(low) - 1)], 0).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * WIDE), pa.array(got.ravel()))
                yield out(pa.array([ids[first + i] for i in text], pa.int64()), start=pa.array(s.astype(np.int32)), words=lists)


def _along(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int, int]:
    """From a[i] and b[j] on: (where a's words no longer match, how many match, how many match before the first edit)."""
    end, same, run = i, 0, -1
    while True:
        m = min(len(a) - i, len(b) - j)
        eq = (a[i : i + m] == b[j : j + m]) & (a[i : i + m] != 0)
        k = m if eq.all() else int(eq.argmin())
        same += k
        run = k if run < 0 else run
        i, j = i + k, j + k
        end = i if k else end
        for x, y in EDITS if k < m else ():
            p, q = a[i + x : i + x + CONFIRM], b[j + y : j + y + CONFIRM]
            if len(p) == len(q) == CONFIRM and p.all() and (p == q).all():
                i, j = i + x, j + y
                break
        else:
            return end, same, run


def grown(a: np.ndarray, b: np.ndarray, seeds: list[int]) -> list[tuple[int, int]]:
    """The stretches (first word, words) of a that match b around the seeds, places of SEED words that may be equal in both."""
    out: list[tuple[int, int]] = []
    done = 0
    n = len(a)
    for s in seeds:
        if s + SEED <= done or not ((a[s : s + SEED] == b[s : s + SEED]) & (a[s : s + SEED] != 0)).all():
            continue
        to, right, run_right = _along(a, b, s + SEED, s + SEED)
        back, left, run_left = _along(a[::-1], b[::-1], n - s, n - s)
        first, same = n - back, left + SEED + right
        if 100 * same < ALIKE * (to - first):
            first, to, same = s - run_left, s + SEED + run_right, run_left + SEED + run_right
        if same >= UNIT:
            out.append((first, to - first))
            done = to
    return out


def _edits_fit(a: np.ndarray, b: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether any of EDITS at these places, the same in both texts, has CONFIRM equal words after it."""
    a, b = (np.pad(x, ((0, 0), (0, CONFIRM + 2))) for x in (a, b))
    ok, along = np.zeros(len(row), bool), np.arange(CONFIRM)
    for x, y in EDITS:
        p, q = a[row[:, None], (at + x)[:, None] + along], b[row[:, None], (at + y)[:, None] + along]
        ok |= ((p == q) & (p != 0)).all(1)
    return ok


def matches(a: np.ndarray, b: np.ndarray, seeds: list[list[int]]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((row, first word, words), (row, seed, side, offset, word)): grown() for each row of a and b, with runs of equal words that no edit continues found for all rows at once; and of each run that ends inside its text and isn't continued, where: after (side 1) the last seed in it or before (side 0) the first, by so many words, with what word of a."""
    eq, place = (a == b) & (a != 0), np.arange(a.shape[1])
    to = np.minimum.accumulate(np.where(eq, a.shape[1], place)[:, ::-1], axis=1)[:, ::-1]
    back = np.maximum.accumulate(np.where(eq, -1, place), axis=1)
    row = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
    s = np.array([x for r in seeds for x in r], np.int64)
    true = to[row, s] >= s + SEED
    row, s = row[true], s[true]
    runs, of = np.unique(np.stack((row, back[row, s] + 1, to[row, s])), axis=1, return_inverse=True)
    last, least = np.full(runs.shape[1], -1), np.full(runs.shape[1], a.shape[1])
    np.maximum.at(last, of.ravel(), s)
    np.minimum.at(least, of.ravel(), s)
    row, first, end = runs
    right, left = _edits_fit(a, b, row, end), _edits_fit(a[:, ::-1], b[:, ::-1], row, a.shape[1] - first)
    edited = np.unique(row[right | left])
    plain = ~np.isin(row, edited) & (end - first >= UNIT)
    slow = [(r, x, n) for r in edited.tolist() for x, n in grown(a[r], b[r], seeds[r])]
    found = np.array(slow, np.int64).reshape(-1, 3).T
    spans = tuple(np.concatenate(x) for x in zip((row[plain], first[plain], (end - first)[plain]), found, strict=True))
    after, before = a[row, np.minimum(end, a.shape[1] - 1)] * (end < a.shape[1]), a[row, np.maximum(first - 1, 0)] * (first > 0)
    r, f = np.flatnonzero(~right & (after != 0)), np.flatnonzero(~left & (before != 0))
    ends = (np.concatenate((row[r], row[f])), np.concatenate((last[r], least[f])), np.repeat([1, 0], [len(r), len(f)]), np.concatenate(((end - last)[r], (least - first)[f])), np.concatenate((after[r], before[f])))
    return spans, ends


def _told(ids, kids, start, found: tuple[tuple, tuple], before: np.ndarray, last: np.ndarray | None = None) -> tuple[list[pa.Array], np.ndarray]:
    """Columns (id, kid, first, n, key, start, seed, side) of what matches() finds of some rows: its stretches, then, with n 0, its ends, and the rows of these. key: of the key before, what is equal from the seed on and the next word, so that texts of one key agree further with each other than with kid. last: the side of each row's key; after an end on the left only ends on the left count, so that each subset is reached in one order."""
    (i, x, n), (j, seed, side, off, word) = found
    if last is not None:
        j, seed, side, off, word = (v[(side == 0) | (last[j] == 1)] for v in (j, seed, side, off, word))
    key = mixed(before[j] + mixed(seed.astype(np.uint64) * GOLDEN + mixed((side << 32 | off).astype(np.uint64)) + mixed(word.astype(np.uint64))))
    more = np.repeat([True, False], [len(i), len(j)])
    cols = [
        pa.array(np.concatenate((ids[i], ids[j]))),
        pa.array(np.concatenate((kids[i], kids[j]))),
        pa.array(np.concatenate((start[i] - REACH + x, np.zeros(len(j), np.int64))).astype(np.int32)),
        pa.array(np.concatenate((n, np.zeros(len(j), np.int64))).astype(np.int32)),
        pa.array(np.concatenate((np.zeros(len(i), np.int64), key.view(np.int64))), mask=more),
        pa.array(np.concatenate((start[i], start[j])).astype(np.int32), mask=more),
        pa.array(np.concatenate((np.zeros(len(i), np.int64), seed)).astype(np.int32), mask=more),
        pa.array(np.concatenate((np.zeros(len(i), np.int64), side)).astype(np.int32), mask=more),
    ]
    return cols, j


TOLD = ["id", "kid", "first", "n", "key", "start", "seed", "side"]
TOLD_TYPES = "id long, kid long, first int, n int, key long, start int, seed int, side int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is told of blocks (id, start, kid, kstart, seeds, words, kwords)."""
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            b = whole.slice(k, 2048)
            mine, theirs = (b.column(k).flatten().to_numpy().reshape(-1, WIDE) for k in ("words", "kwords"))
            ids, start, kids, kstart = (b.column(k).to_numpy(zero_copy_only=False) for k in ("id", "start", "kid", "kstart"))
            found = matches(mine, theirs, [[REACH + s for s in seeds] for seeds in b.column("seeds").to_pylist()])
            cols, _ = _told(ids, kids, start, found, kids.view(np.uint64) + mixed(kstart.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(cols, names=TOLD)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of texts (key, id, start, seed, words, first_doc) that agree with each other around the seed, against the first of their key (kid, kwords); the ends with what is needed to go on."""
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            b = whole.slice(k, 2048)
            mine, theirs = (b.column(k).flatten().to_numpy().reshape(-1, WIDE) for k in ("words", "kwords"))
            ids, start, kids, seed, key, side = (b.column(k).to_numpy(zero_copy_only=False) for k in ("id", "start", "kid", "seed", "key", "side"))
            cols, j = _told(ids, kids, start, matches(mine, theirs, [[s] for s in seed.tolist()]), key.view(np.uint64), side)
            at = pa.array(np.concatenate((np.zeros(len(cols[0]) - len(j), np.int64), j)), mask=np.arange(len(cols[0])) < len(cols[0]) - len(j))
            yield pa.RecordBatch.from_arrays([*cols, b.column("words").take(at), b.column("first_doc").take(at)], names=[*TOLD, "words", "first_doc"])


def _asked(d: DataFrame, first: DataFrame, asks: DataFrame) -> DataFrame:
    """What is asked (id, units, blocks) of the texts, one row of d for each."""
    asks = written(asks.join(first, "id").select(F.col("id").alias("w_id"), "units", "blocks", "first_doc"))
    on = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("id") == F.col("w_id"))
    found = with_small(d, asks, on, "inner").select("id", "text", "units", "blocks")
    return found.mapInArrow(_fetched, "id long, start int, words array<int>, n long, sketch binary, el array<long>")


def _paired(held: DataFrame) -> DataFrame:
    """(id, kid, kstart, start, seeds): holders (key, id, pos, first_doc) of each key against the one of least doc_id, by blocks of that one's text; start: where such a block would begin in id's text."""
    keep = written(held.groupBy("key").agg(F.min(F.struct("first_doc", "id", "pos")).alias("k")).select("key", F.col("k.id").alias("kid"), F.col("k.pos").alias("kpos")))
    inside = F.col("kpos") % BLOCK
    pairs = held.join(keep, "key").where("id <> kid").groupBy("id", "kid", (F.col("kpos") - inside).alias("kstart"), (F.col("pos") - inside).alias("start"))
    pairs = written(pairs.agg(F.sort_array(F.collect_set(inside)).alias("seeds")))
    discarded(keep)
    return pairs


def _blocks(pairs: DataFrame) -> DataFrame:
    both = pairs.select("id", "start").unionByName(pairs.select(F.col("kid").alias("id"), F.col("kstart").alias("start")))
    return both.groupBy("id").agg(F.collect_set("start").alias("blocks"))


def _several(ends: DataFrame) -> DataFrame:
    """The ends of keys that several texts have."""
    several = ends.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    return ends.join(several, "key", "left_semi")


def _stretches(pairs: DataFrame, of: DataFrame, first: DataFrame) -> list[DataFrame]:
    """(id, kid, first, n) of the matches of pairs by their blocks (id, start, words), and of texts that go on alike where the one they were compared with goes on otherwise: these are compared with the first of them, and so on until none do. All of a key have the anchor at one place of their blocks, so nothing is fetched again."""
    mine, theirs = of.select("id", "start", "words"), of.select(F.col("id").alias("kid"), F.col("start").alias("kstart"), F.col("words").alias("kwords"))
    j = pairs.join(mine, ["id", "start"]).join(theirs, ["kid", "kstart"]).select("id", "start", "kid", "kstart", "seeds", "words", "kwords")
    found = written(j.mapInArrow(_compared, TOLD_TYPES))
    out = [found]
    ends = written(_several(found.where("n = 0").select("key", "id", "start", "seed", "side").dropDuplicates(["key", "id", "start"])))
    ends = written(ends.join(mine, ["id", "start"]).join(first, "id"))
    kind = dict(first.dtypes)["first_doc"]
    while not ends.isEmpty():
        keep = ends.groupBy("key").agg(F.min_by(F.struct("id", "words"), F.struct("first_doc", "id", "start")).alias("k"))
        j = ends.join(keep.select("key", F.col("k.id").alias("kid"), F.col("k.words").alias("kwords")), "key").where("id <> kid")
        found = written(j.mapInArrow(_followed, f"{TOLD_TYPES}, words array<int>, first_doc {kind}"))
        out.append(found)
        old, ends = ends, written(_several(found.where("n = 0").select("key", "id", "start", "seed", "side", "words", "first_doc")))
        discarded(old)
        tidy(first.sparkSession)
    return [f.where("n > 0").select("id", "kid", "first", F.col("n").alias("words")) for f in out]


def _labelled(meets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of different paragraphs that share a band and are similar. No link between paragraphs that share a band is left out."""
    members = written(meets.select("key", F.col("h").alias("id")).unionByName(meets.select("key", F.col("lh").alias("id"))).distinct())
    pairs = meets.select(F.least("h", "lh").alias("a"), F.greatest("h", "lh").alias("b")).distinct()
    elements = lambda ids: with_small(sets.select("id", "el"), ids.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_semi")
    found = jaccard_join.verified(pairs, sets, elements, percent)
    labels = written(components(found))
    discarded(found)
    return jaccard_join.joined_by_key(members, labels, sets.select("id", "n", "sketch"), elements, percent)


def _merged(spans: DataFrame) -> DataFrame:
    """(id, spans) of (id, first, words): stretches that overlap or touch as one, in order."""

    @F.pandas_udf("array<struct<first:int,words:int>>")
    def joined(parts):
        import pandas as pd

        def one(p) -> list[dict]:
            out: list[list[int]] = []
            for x, n in p:
                if out and x <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], x + n)
                else:
                    out.append([x, x + n])
            return [{"first": int(a), "words": int(b - a)} for a, b in out]

        return pd.Series([one(p) for p in parts])

    return spans.groupBy("id").agg(F.sort_array(F.collect_set(F.array("first", "words"))).alias("parts")).select("id", joined("parts").alias("spans"))


def repeats(docs: DataFrame, similarity_percent: int = 80) -> DataFrame:
    """(doc_id, id, spans, kept, copy): one row for each document that repeats what another holds. spans: array of (first word, words) to remove, in order, apart from each other; kept: doc_ids of the documents that keep it, sorted; copy: the whole text is a copy of the document kept.

    Paragraphs: lines of UNIT words or more, and whole texts of fewer than UNIT + SEED + WINDOW - 2 words. Those that share a MinHash band are compared by exact Jaccard similarity of their 5-word shingles (equal ones by hash), linked, and each component of links is kept in the document of least doc_id alone.

    Passages that don't fill a line: anchors are places of SEED words that the content picks. Each anchor that several texts share is compared, in the other texts, with the text of least doc_id that holds it; where texts go on alike beyond what they share with that one, they are compared with the first of them, and so on until none do. The match is grown on both sides, through edits of up to two words, to the whole stretch that both texts share, and goes if it has UNIT equal words, ALIKE percent or more of it.

    Equal texts are one; all but the least doc_id are copies if they have a word. Repeats inside one document stay. Texts that are null or without words have neither; null doc_ids come first, as least. id: hash of the text. Other columns aren't looked at; an empty table gives an empty result. Words and texts are told apart by 64-bit hashes, the words beside an anchor by 32 bits.

    Each key of an index links its rows to a first one, so a passage in k documents costs k rows. Band keys that still hold several components compare all their members.
    """
    short_batches(docs.sparkSession)
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    info = written(d.mapInArrow(_measured, f"doc_id {kind}, id long, n_words long, units array<struct<h:long,pos:int,n:int>>"))
    first = written(info.where("n_words > 0").groupBy("id").agg(F.min(F.struct("doc_id")).alias("f")).select("id", F.col("f.doc_id").alias("first_doc")))
    places = info.select("id", F.explode("units").alias("u")).select("u.h", "id", "u.pos", "u.n")
    narrow = d.select("id", "text")
    shared = written(links_by_key(narrow.mapInArrow(_anchors, index_schema(SEEDS)), SEEDS).select("key", "id", "pos", "lid", "lpos"))
    tidy(docs.sparkSession)
    meets = written(links_by_key(narrow.mapInArrow(_banded, index_schema(VALS)), VALS).select("key", "h", "lh"))
    tidy(docs.sparkSession)
    # anchors: each against the text of least doc_id that holds it, by blocks of that text
    held = shared.select("key", "id", "pos").unionByName(shared.select("key", F.col("lid").alias("id"), F.col("lpos").alias("pos"))).distinct().join(first, "id")
    held = written(held)
    pairs = _paired(held)
    discarded(held)
    tidy(docs.sparkSession)
    blocks = _blocks(pairs)
    wanted = meets.select("h").unionByName(meets.select(F.col("lh").alias("h"))).distinct()
    units = places.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("id", "pos", "n")).alias("p")).groupBy("p.id").agg(F.collect_list(F.struct("h", "p.pos", "p.n")).alias("units"))
    got = _asked(d, first, units.join(blocks, "id", "full"))
    if info.groupBy("doc_id", "id").count().where("count > 1").limit(1).count():  # repeated rows are asked each
        got = got.dropDuplicates(["id", "start"])
    got = written(got)
    tidy(docs.sparkSession)
    sets = got.where("start is null").select("id", "n", "sketch", "el")
    spans = written(functools.reduce(DataFrame.unionByName, _stretches(pairs, got.where("start is not null"), first)))
    discarded(pairs, shared)
    tidy(docs.sparkSession)
    # paragraphs: by their components, equal ones among them
    labels = _labelled(meets, sets, similarity_percent)
    several = places.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("h")
    nodes = written(several.join(labels, F.col("h") == F.col("node"), "full").select(F.coalesce("h", "node").alias("h"), F.coalesce("label", "h").alias("label")))
    rows = written(places.join(nodes, "h").select("id", "pos", "n", "label").distinct().join(first, "id"))
    keeper = written(rows.groupBy("label").agg(F.min(F.struct("first_doc", "id", "pos")).alias("k")).select("label", F.col("k.id").alias("kid")))
    gone = rows.join(keeper, "label").where("id <> kid").select("id", "kid", F.col("pos").alias("first"), F.col("n").alias("words"))
    spans = written(spans.unionByName(gone))
    discarded(got, meets, nodes, rows)
    tidy(docs.sparkSession)
    whose = first.select(F.col("id").alias("kid"), F.col("first_doc").alias("kept_doc"))
    kept = spans.select("id", "kid").distinct().join(whose, "kid").groupBy(F.col("id").alias("k_id")).agg(F.sort_array(F.collect_set("kept_doc")).alias("g_kept"))
    found = _merged(spans).join(kept, F.col("id") == F.col("k_id")).select(F.col("id").alias("g_id"), "spans", "g_kept")
    rows = info.where("n_words > 0").select("doc_id", "id", "n_words").join(first.select(F.col("id").alias("f_id"), "first_doc"), F.col("id") == F.col("f_id")).withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    rows = rows.join(found, F.col("id") == F.col("g_id"), "left").where("copy or g_id is not null")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("words")))
    return rows.select("doc_id", "id", F.when(F.col("copy"), whole).otherwise(F.col("spans")).alias("spans"), F.when(F.col("copy"), F.array("first_doc")).otherwise(F.col("g_kept")).alias("kept"), "copy")


def removed(text: str, spans: list[tuple[int, int]], word: re.Pattern = re.compile(WORD)) -> str:
    """text without the words of the spans (first word, words) and the white space after each span."""
    at = [m.span() for m in word.finditer(text)]
    out, k = [], 0
    for first, n in spans:
        out.append(text[k : at[first][0]])
        k = at[first + n][0] if first + n < len(at) else len(text)
    return "".join(out) + text[k:]


def cleaned(docs: DataFrame, similarity_percent: int = 80) -> DataFrame:
    """docs without what repeats() finds: spans cut out of the texts, n_chars (if there is such a column) counted anew, and rows left without a word dropped. Other columns and rows without repeats stay as they are."""
    found = written(repeats(docs, similarity_percent).select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), F.transform("spans", lambda s: F.array(s["first"], s["words"])).alias("_spans")).distinct())

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        return pd.Series([removed(t, [tuple(s) for s in sp]) for t, sp in zip(text, spans, strict=True)], dtype=object)

    text = F.col("_row.text")
    on = F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_id"))
    j = with_small(packed(docs), found, on)
    hit = F.col("_spans").isNotNull()
    new = j.where(hit).withColumn("_new", without(text, "_spans")).where(F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    counted = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    new = new.select(*[counted.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
    return new.unionByName(unpacked(j.where(~hit)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats() finds in all documents: a row for each document that loses words."""
    r = repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.aggregate("spans", F.lit(0), lambda a, s: a + s["words"]).cast("long").alias("removed_words"), "spans", F.col("kept").alias("kept_doc_ids"), F.col("copy").alias("whole_copy"))
