"""Language identification: script ranges narrow the candidates, then a Viterbi pass over per-word scores labels the spans of a text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import mixed, short_batches, slices, table

#: Script ranges by first and last code point; fixed values. What is in none of them is of the script "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
#: Words: letters and what joins to them; digits and underscores part words.
WORDS = re.compile(r"[^\W\d_]+").findall
#: Words a worker remembers before it starts anew; bounds its memory, never the result.
REMEMBERED = 200_000
#: The score of a word for a language that doesn't use its script: no path goes there.
NEVER = -1e6


def scripts_of(first: np.ndarray) -> np.ndarray:
    """The place in NAMES of the script of each code point."""
    lows = np.array([a for _, a, _ in SCRIPTS])
    k = np.searchsorted(lows, first, side="right") - 1
    own = np.array([NAMES.index(s) for s, _, _ in SCRIPTS])
    return np.where((k >= 0) & (first <= np.array([b for _, _, b in SCRIPTS])[k]), own[k], len(NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its word's number, first code points): the character 2-, 3- and 4-grams of each word between bounds, and each word as a whole; sorted by word."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(points)) - begin[owner]
    odd = mixed(np.arange(1, max(int(n.max(initial=0)), 4) + 1, dtype=np.uint64)) | np.uint64(1)
    hashes, owners = [np.add.reduceat(points * odd[place], begin) + n.astype(np.uint64)], [np.arange(len(words))]
    h = points * odd[0]
    for k in (2, 3, 4):
        h = h[:-1] + points[k - 1 :] * odd[k - 1] if len(h) else h
        ok = place[: len(h)] + k <= n[owner[: len(h)]]
        hashes.append(h[ok] + np.uint64(k))
        owners.append(owner[: len(h)][ok])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return mixed(np.concatenate(hashes)[order]), own[order], points[begin + 1].astype(np.int64)


class Model:
    """Log-likelihoods of n-grams by language, and the scripts of each language.

    A word's score for a language is the mean over its n-grams of log P(n-gram | language), add-half smoothed, times the square root of its length; a language whose training texts hardly use the word's script is no candidate, and no score is computed for it. keys: sorted hashes of n-grams; weights: a row for each, the last one for unseen ones; scripts: which languages use each of NAMES.
    """

    def __init__(self, langs: list[str], keys: np.ndarray, weights: np.ndarray, scripts: np.ndarray, switch: float):
        self.langs, self.keys, self.weights, self.scripts, self.switch = langs, keys, weights, scripts, switch
        self.bits = max(1, len(keys).bit_length())
        self.first = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))  # of the keys by their top bits
        self.steps = int(np.diff(self.first).max(initial=0))

    def args(self) -> tuple:
        return self.langs, self.keys, self.weights, self.scripts, self.switch

    def rows(self, h: np.ndarray) -> np.ndarray:
        """The row of weights of each n-gram hash."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), len(self.keys))
        left = np.flatnonzero(at < end)
        for _ in range(self.steps):
            k = at[left]
            hit = self.keys[k] == h[left]
            out[left[hit]] = k[hit]
            at[left] += 1
            left = left[~hit & (k + 1 < end[left])]
            if not len(left):
                break
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): NEVER for a language that is no candidate, 0 for all if the word has no letter."""
        out = np.zeros((len(words), len(self.langs)))
        for k in range(0, len(words) if self.langs else 0, 20_000):
            part = words[k : k + 20_000]
            h, own, first = grams(part)
            rows, starts = self.rows(h), np.searchsorted(own, np.arange(len(part)))
            count = np.diff(np.concatenate((starts, [len(own)])))
            root = np.sqrt(np.fromiter(map(len, part), np.float64, len(part)))
            script = scripts_of(first)
            got = np.full((len(part), len(self.langs)), NEVER)
            for x in np.unique(script):
                of = np.flatnonzero(script == x)
                able = np.flatnonzero(self.scripts[x]) if self.scripts[x].any() else np.arange(len(self.langs))
                mine = (script == x)[own]
                each = np.add.reduceat(self.weights[rows[mine][:, None], able[None]], np.cumsum(count[of]) - count[of], axis=0)
                got[of[:, None], able[None]] = each / count[of, None] * root[of, None]
            got[[i for i, w in enumerate(part) if not w.isalpha() and not any(map(str.isalpha, w))]] = 0
            out[k : k + len(part)] = got
        return out


def fitted(texts: Iterator[tuple[str, str]], switch: float = 4.0, least: int = 2) -> Model:
    """A model of (language, text) pairs. N-grams seen fewer than `least` times in all are left out."""
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in texts:
        words[lang].update(WORDS(text.lower()))
    langs = sorted(words)
    used = np.zeros((len(NAMES), len(langs)))
    found, mass = [], []
    for i, lang in enumerate(langs):
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        own, n = list(words[lang]), np.array(list(words[lang].values()), np.int64)
        for k in range(0, len(own), 50_000):
            h, of, first = grams(own[k : k + 50_000])
            keys.append(h)
            counts.append(n[k : k + 50_000][of])
            used[:, i] += np.bincount(scripts_of(first), n[k : k + 50_000], len(NAMES))
        key, to = np.unique(np.concatenate(keys), return_inverse=True)
        found.append((key, np.bincount(to, np.concatenate(counts), len(key))))
        mass.append(found[-1][1].sum())
    every = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)
    table_ = np.zeros((len(every), len(langs)))
    for i, (key, n) in enumerate(found):
        table_[np.searchsorted(every, key), i] = n
    kept = table_.sum(1) >= least
    seen = np.concatenate((table_[kept], np.zeros((1, len(langs)))))
    weights = np.log((seen + 0.5) / (np.array(mass, float) + 0.5 * (kept.sum() + 1)))
    total = np.array([sum(words[x].values()) for x in langs], float)
    return Model(langs, every[kept], weights, used >= 0.01 * np.maximum(total, 1), switch)


def settled(flat: np.ndarray, sizes: np.ndarray, scores: np.ndarray, ahead: np.ndarray, switch: float) -> np.ndarray:
    """The language of each text for which one label throughout is the only best path, else -1: the language of the highest sum, if no stretch of the text is ahead in others by as much as a switch costs. flat: the words of the texts, rows of scores (words, languages) and of ahead, how far the best other language is ahead of each."""
    out = np.full(len(sizes), -1)
    of = np.flatnonzero(sizes)
    if not len(of):
        return out
    n = sizes[of]
    starts = np.cumsum(n) - n
    best = np.add.reduceat(scores[flat], starts, axis=0).argmax(1)
    text = np.repeat(np.arange(len(of)), n)
    gain = ahead[flat, best[text]]
    able = np.maximum.reduceat(gain, starts) < -NEVER / 2
    gain = np.clip(gain, NEVER / 2, None)
    gain[~able[text]] = 0
    upto = np.cumsum(gain)
    upto -= (upto[starts] - gain[starts])[text]  # of each text by itself
    # the least sum before each word; texts are set so far apart that each one's sums lie below those before it
    down = text * (2 * np.abs(upto).max(initial=0) + 1)
    least = np.minimum.accumulate(upto - gain - down) + down
    most = np.maximum.reduceat(upto - least, starts)
    sure = able & (most < switch * (1 - 1e-3))
    out[of[sure]] = best[sure]
    return out


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label sequence of each text, given its (words, languages) scores: a change of label costs `switch`. All texts go in step, longest first; ties go to staying, then to the first language."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest, k = int(sizes[0]) if len(sizes) else 0, scores[0].shape[1] if scores else 0
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    flat = np.concatenate([scores[i] for i in order]) if longest else np.zeros((0, k))
    moved = np.zeros(flat.shape, bool)  # the label before was another: the best one
    best = np.zeros(len(flat), np.int16)  # the best label of the word before
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    v = np.zeros((len(order), k))
    for t in range(longest):
        n = live[t]
        at = starts[:n] + t
        if t:
            top = v[:n].argmax(1)
            leap = v[np.arange(n), top] - switch
            go = leap[:, None] > v[:n]
            best[at], moved[at] = top, go
            v[:n] = np.where(go, leap[:, None], v[:n]) + flat[at]
        else:
            v[:n] = flat[at]
        v[:n] -= v[:n].max(1)[:, None]
    label = np.zeros(len(flat), np.int16)
    now = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        label[at] = now[:n]
        now[:n] = np.where(moved[at, now[:n]], best[at], now[:n])
    out: list[np.ndarray] = [None] * len(order)  # type: ignore[list-item]
    for i, a, n in zip(order, starts, sizes, strict=True):
        out[i] = label[a : a + n]
    return out


def labelled(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs without text, with lang_pred, score and, if asked for, spans (array of first word, words, language).

    lang_pred: the language that labels most letters of the whole text (ties to the first by name), score its share of the letters; `und` and 0 if text is null or has no letter, or nothing was learned. Other columns stay unless they have these names. Texts that one language surely labels throughout don't go through the Viterbi pass, which would label them so.
    """
    short_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "spans")]
    sent = docs.sparkSession.sparkContext.broadcast(model.args())  # its size is bounded by the training sample's
    kept = docs.select(*[f"`{c}`" for c in rest], "text")
    fields = [f"`{n}` {t}" for n, t in kept.drop("text").dtypes] + ["lang_pred string", "score double"] + ["spans array<struct<first:int,words:int,lang:string>>"] * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        k = len(m.langs)
        known: dict[str, int] = {}
        room = 1 << 12
        scores, ahead, letters = np.zeros((room, k)), np.zeros((room, k)), np.zeros(room, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                words = [WORDS((t or "").lower()) for t in b.column("text").to_pylist()]
                new = list(set().union(*words).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(set().union(*words))
                first, end = len(known), len(known) + len(new)
                while room < end:
                    scores, ahead, letters = (np.concatenate((x, np.zeros_like(x))) for x in (scores, ahead, letters))
                    room *= 2
                known.update(zip(new, range(first, end), strict=True))
                scores[first:end] = m.scores(new)
                for i in range(k):
                    others = np.delete(scores[first:end], i, axis=1)
                    ahead[first:end, i] = (others.max(1) if k > 1 else 2 * NEVER) - scores[first:end, i]
                letters[first:end] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                flat = np.fromiter((i for x in words for i in map(known.__getitem__, x)), np.int64, int(sizes.sum()))
                text = np.repeat(np.arange(len(sizes)), sizes)
                one = settled(flat, sizes, scores, ahead, m.switch) if k else np.full(len(sizes), -1)
                label = one[text]
                if k:
                    hard = np.flatnonzero((one < 0) & (sizes > 0))
                    at = np.cumsum(sizes) - sizes
                    for i, found in zip(hard, viterbi([scores[flat[at[i] : at[i] + sizes[i]]] for i in hard], m.switch), strict=True):
                        label[at[i] : at[i] + sizes[i]] = found
                    mass = np.bincount(text * k + label, letters[flat], len(sizes) * k).reshape(-1, k)
                else:
                    mass = np.zeros((len(sizes), 1))
                total, top = mass.sum(1), mass.argmax(1)
                preds = [m.langs[i] if t else "und" for i, t in zip(top.tolist(), total.tolist(), strict=True)]
                made = [pa.array(preds, pa.string()), pa.array(mass.max(1) / np.maximum(total, 1))]
                if spans:
                    made.append(pa.array(_spans(label if k else label[:0], sizes * bool(k), m.langs), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *made], names=[*rest, "lang_pred", "score", "spans"][: len(rest) + 2 + spans])

    return kept.mapInArrow(run, ", ".join(fields))


def _spans(label: np.ndarray, sizes: np.ndarray, langs: list[str]) -> list[list[dict]]:
    out = []
    for x in np.split(label, np.cumsum(sizes)[:-1]):
        ends = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
        out.append([{"first": p, "words": q - p, "lang": langs[x[p]]} for p, q in zip(ends, ends[1:])])
    return out


def sample(labelled_docs: DataFrame, bound: int = 4000, seed: int = 0) -> list[tuple[str, str]]:
    """(lang, text) of at most `bound` labelled rows, those of least seeded hash: the documented bound of the training sample, the only texts the driver sees. Rows without text or lang don't count."""
    d = labelled_docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.lit(seed), "text", "lang").alias("_h"))
    n = d.count()
    part = min(1.0, 1.5 * bound / n) if n else 0.0  # a cut on the hash first, so that few rows meet in the last task
    near = d.where(F.col("_h") <= F.lit(int(-(1 << 63) + part * ((1 << 64) - 1)))) if part < 1 else d
    return [(r["lang"], r["text"]) for r in near.orderBy("_h", "text", "lang").limit(bound).collect()]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's predictions, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted(sample(docs.where(~held_out(F.col("doc_id")))))
    return labelled(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
