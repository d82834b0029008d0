"""Exact n-gram Jaccard join by universe partition: segments by size band, one-deletion neighbourhoods by cost, exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import combined, components, discarded, index_schema, links_by_key, merged, mixed, shingles, short_batches, table, tidy, with_small, word_batches, written

VALS = {"id": "long"}
#: Least and most bits of a set's parity sketch, a power of two from its size up: each element flips one bit, so two sets differ in no fewer elements than their sketches in bits. With fewer bits than half the difference that links allow, a sketch would rule nothing out.
SKETCH, SKETCH_MOST = 512, 1 << 15
#: Sets of one key in one block: beyond that, the all-pairs step deals the pairs of blocks to tasks.
IN_BLOCK = 1000
#: Turns at most in which keys with several components try another node of each key, before all pairs are compared. More or fewer change the work, not the result.
LEADERS = 2


@dataclass(frozen=True)
class Scheme:
    """Of one size band: sets whose smaller has lo to hi elements. Elements are hashed to `equal` + `near` segments; a segment that is compared as a whole stands for one unit, one of the `near` (whole, or all but one element) for two. `slack` units more than the largest difference are there, so that up to `slack` units may be left out because their segments hold fewer than `least` elements."""

    lo: int
    hi: int
    equal: int
    near: int
    slack: int
    least: int


def most_apart(smaller: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of which the smaller has so many elements."""
    return (smaller + smaller * 100 // percent) * (100 - percent) // (100 + percent)


def schemes(sizes: dict[int, int], percent: int, shared: float = 0.01) -> list[Scheme]:
    """Schemes for all bands up to the largest size. sizes: how many sets there are of each size.

    Allocation by cost: of some numbers of one-deletion segments the one that makes rows + expected chance meetings least; shared: an upper estimate of the chance that an element of one set is in an unrelated one (of word shingles of running text, 99 in 100 are in less than 0.3 % of all texts). It moves cost alone, never the result.
    """
    out, lo, top = [], 1, max(sizes, default=0)
    while lo <= top:
        hi = lo * 100 // percent
        apart, rows = most_apart(hi, percent), sum(n for s, n in sizes.items() if lo <= s <= hi * 100 // percent)
        best = None
        for near in sorted({0, (apart + 1) // 8, (apart + 1) // 4, (apart + 1) // 2}):
            slack, least = 0, 1
            for _ in range(8):
                equal = max(apart + 1 + slack - 2 * near, 0 if near else 1)
                mean = lo / (equal + near)
                least = 2 if mean >= 3.5 else 1
                few = math.exp(-mean) * (1 + (mean if least == 2 else 0))
                edge = math.exp(-mean) * mean**least / math.factorial(least)
                lost = equal * few + near * (2 * few + edge)
                slack = math.ceil(lost + 3 * math.sqrt(lost)) if apart else 0
            equal = max(apart + 1 + slack - 2 * near, 0 if near else 1)
            mean = lo / (equal + near)
            made = equal + near * (1 + mean)
            cost = made + rows * (equal * shared ** max(mean, 1) + near * (1 + mean) * shared ** max(mean - 1, 1))
            if best is None or cost < best[0]:
                best = cost, Scheme(lo, hi, equal, near, slack, least)
        out.append(best[1])
        lo = hi + 1
    return out


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, owner of each element counted from the first, element): the distinct n-word shingles of each text; fewer words are one shingle."""
    for first, last, words, ends, _ in word_batches(texts):
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts
        h = shingles(words, n)
        owner = np.repeat(np.arange(last - first), sizes)
        whole = np.arange(len(h)) + n <= ends[owner[: len(h)]] if len(h) else np.zeros(0, bool)
        own, el = owner[: len(h)][whole], h[whole]
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            own = np.concatenate((own, short))
            el = np.concatenate((el, np.array([mixed(shingles(words[starts[i] : ends[i]], int(sizes[i])) + np.uint64(sizes[i]))[0] for i in short], np.uint64)))
        order = np.lexsort((el, own))
        own, el = own[order], el[order]
        keep = np.ones(len(el), bool)
        keep[1:] = (el[1:] != el[:-1]) | (own[1:] != own[:-1])
        yield first, last, own[keep], el[keep]


def _ids(own: np.ndarray, el: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id (0 for an empty set) of each set."""
    sizes = np.bincount(own, minlength=n)
    total = np.zeros(n, np.uint64)
    if len(el):
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        total[own[starts]] = np.add.reduceat(mixed(el), starts)
    ids = (mixed(total + sizes.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return sizes, np.where(sizes > 0, np.maximum(ids, 1), 0)


def _sketches(own: np.ndarray, el: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: SKETCH bits, doubled until it has as many as elements, SKETCH_MOST at most."""
    bits = SKETCH << np.ceil(np.log2(np.clip(sizes, SKETCH, SKETCH_MOST) / SKETCH)).astype(np.int64)
    ends = np.cumsum(bits)
    bit = (ends - bits)[own] + ((el >> np.uint64(8)).astype(np.int64) & (bits[own] - 1))
    packed = np.packbits((np.bincount(bit, minlength=bits.sum()) & 1).astype(np.uint8)).tobytes()
    return [packed[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]


def _folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, with their halves laid over each other until they have so many bits: the sketches that sets of fewer elements get."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] * 64 > bits:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def bits_apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of each pair differ, the longer folded to the shorter."""
    lengths = np.array([[len(x) for x in one], [len(x) for x in two]]) * 8
    out = np.zeros(len(one), np.int32)
    for a, b in np.unique(lengths, axis=1).T:
        at = np.flatnonzero((lengths[0] == a) & (lengths[1] == b))
        x, y = (_folded([v[i] for i in at], min(a, b)) for v in (one, two))
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def _measured(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, sketches = [], []
            for first, last, own, el in sets_of(b.column("text"), n):
                parts.append(_ids(own, el, last - first))
                sketches += _sketches(own, el, parts[-1][0])
            if parts:
                sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids), pa.array(sizes.astype(np.int64)), pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "id", "n_shingles", "sketch"])

    return run


def signatures(own: np.ndarray, el: np.ndarray, ids: np.ndarray, sizes: np.ndarray, plan: list[Scheme], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) rows of some sets: each in the scheme of its band, and in that of the band below if partners can be there."""
    keys, owners = [], []
    lows = np.array([s.lo for s in plan])
    band = np.searchsorted(lows, np.maximum(sizes, 1), side="right") - 1
    highs = np.array([s.hi for s in plan])
    for down in (0, 1):
        at = band - down
        use = (sizes > 0) & (at >= 0)
        if down:
            use &= -(-percent * sizes // 100) <= highs[np.maximum(at, 0)]
        if not use.any():
            continue
        equal, near, slack, least = (np.array([getattr(s, f) for s in plan])[np.maximum(at, 0)] for f in ("equal", "near", "slack", "least"))
        pick = use[own]
        o, e = own[pick], el[pick]
        m = (equal + near)[o]
        seg = ((e >> np.uint64(20)) % m.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((seg, o))
        o, e, seg = o[order], e[order], seg[order]
        starts = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (seg[1:] != seg[:-1]))))
        count = np.diff(np.concatenate((starts, [len(o)])))
        so, ss = o[starts], seg[starts]
        sums = np.add.reduceat(mixed(e + np.uint64(7)), starts)
        is_near = ss >= equal[so]
        few = count < least[so]
        # units that short and empty segments leave out; beyond the slack, a set is rare and gives its short segments too
        n_equal, n_near = (np.bincount(so, x, len(sizes)) for x in (~is_near & ~few, is_near & ~few))
        edge = np.bincount(so, is_near & (count == least[so]), len(sizes))
        rare = (equal - n_equal) + 2 * (near - n_near) + edge > slack
        place = mixed((at[so].astype(np.uint64) << np.uint64(32)) + ss.astype(np.uint64) + np.uint64(1))
        normal = ~few
        keys.append(mixed(sums[normal] ^ place[normal]))
        owners.append(so[normal])
        group = np.repeat(np.arange(len(starts)), count)
        less = is_near[group]  # all but one element
        gl = group[less]
        gone = sums[gl] - mixed(e[less] + np.uint64(7))
        enough = count[gl] - 1 >= least[so[gl]]
        keys.append(mixed(gone[enough] ^ place[gl[enough]]))
        owners.append(so[gl[enough]])
        if rare.any():  # in a space of their own, with every segment, empty ones included
            own_space = np.uint64(0xA5A5A5A5A5A5A5A5)
            all_o = np.repeat(np.flatnonzero(rare & use), (equal + near)[rare & use])
            if len(all_o):
                first = np.concatenate(([0], np.cumsum((equal + near)[rare & use])[:-1]))
                all_s = np.arange(len(all_o)) - np.repeat(first, (equal + near)[rare & use])
                there = np.isin(all_o * (1 << 32) + all_s, so * (1 << 32) + ss)
                eo, es = all_o[~there], all_s[~there]
                keys.append(mixed(mixed((at[eo].astype(np.uint64) << np.uint64(32)) + es.astype(np.uint64) + np.uint64(1)) ^ own_space))
                owners.append(eo)
            short = few & rare[so]
            keys.append(mixed(sums[short] ^ place[short] ^ own_space))
            owners.append(so[short])
            rest = ~enough & rare[so[gl]]
            keys.append(mixed(gone[rest] ^ place[gl[rest]] ^ own_space))
            owners.append(so[gl[rest]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), ids[np.concatenate(owners)]


def _indexed(n: int, plan: list[Scheme], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, own, el in sets_of(b.column("text"), n):
                sizes, ids = _ids(own, el, last - first)
                # copies in the batch give their rows once
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                pick = once[own]
                key, id_ = signatures(own[pick], el[pick], ids, np.where(once, sizes, 0), plan, percent)
                if len(key):
                    yield combined(["id"], key, [id_])

    return run


def _elements(n: int):
    """(id, elements) of rows whose set has the id asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("id").to_numpy(zero_copy_only=False)
            for first, last, own, el in sets_of(b.column("text"), n):
                sizes, ids = _ids(own, el, last - first)
                ok = np.flatnonzero((ids == want[first:last]) & (sizes > 0))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array([el[ends[i] - sizes[i] : ends[i]].view(np.int64) for i in ok], pa.list_(pa.int64()))], names=["id", "el"])

    return run


def _cross(percent: int):
    """Pairs of rows (key, one, two, id, label, n, sketch, block), sorted by the first three, of one key and pair of blocks (one, two) but different components that size and sketch don't rule out. Each row is compared with the d-th after it, for every d and all keys at once; nothing is left out. Keeps the rows of one key and pair of blocks between batches."""

    def pairs(group, one, two, id_, label, n, sketch, block) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(group))
        d = 0
        while True:
            d += 1
            at = at[at + d < len(group)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                return
            for k in range(0, len(at), 1 << 18):
                i = at[k : k + (1 << 18)]
                j = i + d
                ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                ok &= (one[i] == two[i]) | (block[i] != block[j])  # pairs inside a block are that block's own
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
                x, y = id_[i[ok]], id_[j[ok]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            key, one, two, id_, label, n, block = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 5, 7))
            sketch = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            cols = [key, one, two, id_, label, n, sketch, block]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = np.concatenate(([False], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])))
            group = np.cumsum(new)
            cut_at = int(np.searchsorted(group, group[-1]))
            yield from pairs(*(c[:cut_at] for c in (group, *cols[1:])))
            kept = [c[cut_at:] for c in cols]
        if kept is not None:
            yield from pairs(np.zeros(len(kept[0]), np.int64), *kept[1:])

    return run


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with their sizes (na, nb), that size and sketch don't rule out."""
    small = sets.select("id", "n", "sketch")
    left, right = (small.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")

    @functools.partial(F.pandas_udf, returnType="int")
    def apart(x, y):
        import pandas as pd

        return pd.Series(bits_apart(x.tolist(), y.tolist()))

    p = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return p.where(apart("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Which of the pairs (a, b) link, by their elements, as a written table. sets: (id, n, sketch) of all. elements: what gives (id, el) of a table of ids, asked for the likely pairs' alone, so that no other set's elements are written or shuffled."""
    p = written(_likely(pairs, sets, percent))
    if p.isEmpty():
        out = p.select("a", "b")
        out._written_at = p._written_at
        return out
    ids = written(p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct())
    el = written(elements(ids))
    tidy(p.sparkSession)
    both = p.join(el.select(F.col("id").alias("a"), F.col("el").alias("ea")), "a").join(el.select(F.col("id").alias("b"), F.col("el").alias("eb")), "b")
    i = F.size(F.array_intersect("ea", "eb"))
    out = written(both.withColumn("i", i).where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"))
    discarded(p, ids, el)
    tidy(p.sparkSession)
    return out


def classes(docs: DataFrame, n: int = 4, percent: int = 85, tell_text: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: the size of its set of distinct n-word shingles, and the least doc_id that links reach from it, its own included. Two sets link when 100 * intersection >= percent * union. With tell_text also text_hash, the xxhash64 of the text (null: empty), which tells rows of a doc_id apart, and class_hash, which tells classes apart (null without words).

    Words are runs of other than the six ASCII spaces, A-Z lower-cased. A text of fewer than n words is one shingle; without words, or null, it has none and links with nothing. Repeated rows and equal sets are one class. A row without doc_id links like any other, but is no class's least doc_id; a class of such rows alone has null. Other columns aren't looked at; an empty table gives an empty result. Elements are 64-bit hashes of shingles.

    1. Equal sets become one node. 2. Nodes go by their segment keys into stars, a first node of each key, so that a group of k costs k links; copies and frequent keys are combined before the shuffle. 3. Each node's link to its likeliest first node is verified. 4. Where a key holds several components, its nodes are tried against another node of the key, and at last all pairs between its components are compared by size and sketch, block by block, and the rest verified. No link between components is left out.
    """
    short_batches(docs.sparkSession)
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    info = written(d.mapInArrow(_measured(n), "doc_id " + dict(d.dtypes)["doc_id"] + ", text_hash long, id long, n_shingles long, sketch binary"))
    sizes = {r["n_shingles"]: r["c"] for r in info.where("n_shingles > 0").groupBy("n_shingles").agg(F.count("*").alias("c")).collect()}  # one row a size
    plan = schemes(sizes, percent)
    index = d.select("text").mapInArrow(_indexed(n, plan, percent), index_schema(VALS))
    meets = written(links_by_key(index, VALS))
    tidy(docs.sparkSession)
    # of each node that meets another: size, sketch and one row of documents
    wanted = meets.select("id").unionByName(meets.select(F.col("lid").alias("id"))).distinct()
    sets = written(info.join(wanted, "id").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "sketch")).alias("w")).select("id", F.col("w.n_shingles").alias("n"), F.col("w.sketch").alias("sketch"), F.col("w.doc_id").alias("w_doc"), F.col("w.text_hash").alias("w_text")))
    repeated = not info.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()

    def elements(ids: DataFrame) -> DataFrame:
        asked = written(sets.join(ids, "id").select("id", "w_doc", "w_text"))
        row = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_hash") == F.col("w_text"))
        found = with_small(d, asked, row, "inner").select("id", "text").mapInArrow(_elements(n), "id long, el array<long>")
        return found.dropDuplicates(["id"]) if repeated else found

    pairs = meets.groupBy(F.least("id", "lid").alias("a"), F.greatest("id", "lid").alias("b")).agg(F.count("*").alias("c"))
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    pairs = written(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "c"))
    tidy(docs.sparkSession)
    # the likeliest partner first
    best = pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    found = verified(best, sets, elements, percent)
    labels = written(components(found))
    # then other nodes of each key that holds several components, while that joins any, last all pairs between components
    members = written(meets.select("key", "id").unionByName(meets.select("key", F.col("lid").alias("id"))).distinct())
    discarded(meets, pairs, found)
    tidy(docs.sparkSession)
    labels = joined_by_key(members, labels, sets, elements, percent)
    nodes = info.groupBy("id").agg(F.min("doc_id").alias("first")).join(labels, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("label", "id").alias("label"))
    nodes = written(nodes)
    discarded(sets, labels)
    tidy(docs.sparkSession)
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = nodes.join(least, "label").select(F.col("id").alias("n_id"), "component_id", F.col("label").alias("class_hash"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return info.join(by_node, F.col("id") == F.col("n_id"), "left").select("doc_id", "n_shingles", component, *["text_hash", F.when(F.col("n_shingles") > 0, F.col("class_hash")).alias("class_hash")][: 2 * tell_text])


def joined_by_key(members: DataFrame, labels: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """labels (node, label) after the links between nodes (key, id) of one key in different components: LEADERS turns against another node of each key, while that joins any, then all pairs of keys with three nodes or more. members is discarded; sets and elements as for verified()."""
    turn, n_links = 0, 1
    while True:
        turn += 1
        last = turn > LEADERS or not n_links
        old, members = members, written(_several(members, labels, 2 if turn == 1 else 3))  # components only merge, so keys only leave; one of two nodes has had its only pair compared
        discarded(old)
        tidy(members.sparkSession)
        if members.isEmpty():
            return labels
        found = verified(_between(members, sets, percent) if last else _to_leaders(members, turn), sets, elements, percent)
        n_links = found.count()
        if n_links:
            old, labels = labels, merged(labels, found)
            discarded(old)
        discarded(found)
        tidy(members.sparkSession)
        if last:
            discarded(members)
            return labels


def _several(members: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(key, id, label) of the keys that hold several components, and `least` nodes or more."""
    members = members.select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    several = written(members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where(f"x <> y and c >= {least}").select("key"))
    return members.join(several, "key", "left_semi")


def _to_leaders(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of a key with another node of the key, the same for all, picked by a hash that differs from turn to turn. As many pairs as members."""
    lead = written(members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("h"), "id", "label")).alias("l")))
    j = members.join(lead, "key").where(F.col("label") != F.col("l.label"))
    return j.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def _between(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of one key in different components. A key's sets go by hash into blocks of some IN_BLOCK, and each pair of blocks is compared for itself, wherever there is room: no task gets all of a frequent key."""

    @functools.partial(F.pandas_udf, returnType="binary")
    def folded(x):  # to one length; verified() looks at the whole sketches of the pairs that are left
        import pandas as pd

        return pd.Series([_folded([v], SKETCH).tobytes() for v in x])

    rows = members.join(sets.select("id", "n", folded("sketch").alias("sketch")), "id")
    blocks = written(members.groupBy("key").agg(F.ceil(F.count("*") / IN_BLOCK).cast("int").alias("blocks")))
    rows = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("key", "id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "label", "n", "sketch", "block")
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.mapInArrow(_cross(percent), "a long, b long").distinct()


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's classes of all documents: four words, 85 percent."""
    return classes(table(spark, sf_dir, "documents"))
