"""What several operators share: words, scratch storage, leader links, connected components.

Executor-side code must not depend on how the package was installed there, so the package is pickled by value.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import thicket

cloudpickle.register_pickle_by_value(thicket)

#: A word is a maximal run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Of a block of 8 bytes, the first k.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(text: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, where it starts, whether it is the first of its line or text) of texts that follow each other in `text`, A-Z lower-cased; cuts: where texts begin and end. Words go by blocks of 8 bytes, all at once."""
    low = np.frombuffer(text.lower() + b" " * 8, np.uint8)
    space = _IS_SPACE[low]
    inside = ~space
    begins, ends = inside.copy(), space.copy()
    begins[1:] &= space[:-1]
    ends[1:] &= inside[:-1]
    ends[0] = False
    cut = cuts[(cuts > 0) & (cuts < len(text))]
    begins[cut] = inside[cut]
    ends[cut] = inside[cut - 1]
    first = np.flatnonzero(begins)
    left = np.flatnonzero(ends) - first
    h = left.astype(np.uint64)
    at, of = first, np.arange(len(first))
    blocks = np.lib.stride_tricks.as_strided(low, shape=(max(len(low) - 7, 0), 8), strides=(1, 1))
    while len(of):
        block = np.frombuffer(blocks[at].tobytes(), np.uint64) & _FIRST[np.minimum(left, 8)]
        h[of] = mixed(h[of] * GOLDEN + block + np.uint64(1))
        more = left > 8
        of, at, left = of[more], at[more] + 8, left[more] - 8
    breaks = np.concatenate((np.flatnonzero(low == 10), cuts))
    line = np.zeros(len(first), bool)
    after = np.searchsorted(first, breaks)
    line[after[after < len(first)]] = True
    return h, first, line


def word_batches(texts: pa.Array, at_once: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, one past the last, hashes of their words, ends of the texts among these, which words begin a line) for some `at_once` bytes of texts at a time, read from the column's buffer; null texts have no words."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, int(offsets[k]) + at_once, side="right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[end])
        cuts = offsets[k : end + 1].astype(np.int64) - lo
        words, first, line = word_hashes(data[lo:hi].to_pybytes() if hi > lo else b"", cuts)
        yield k, end, words, np.searchsorted(first, cuts[1:]), line
        k = end


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in Arrow batches of at most so many rows, for this session: a batch is held whole on both sides, twice over while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def slices(b: pa.RecordBatch, column: str, at_once: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have some `at_once` bytes together, so that a worker's memory doesn't follow the batch; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < b.num_rows:
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + at_once, side="right")))
        yield b.slice(k, end - k)
        k = end


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places are left out."""
    m = max(len(words) - n + 1, 0)
    odd = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.zeros(m, np.uint64)
    for i in range(n if m else 0):
        h += words[i : i + m] * odd[i]
    return mixed(h)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def packed(docs: DataFrame, *out: str) -> DataFrame:
    """docs as the one column _row, so that no column of theirs clashes with an operator's own; columns that the operator gives out are left behind."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in out]).alias("_row"))


def unpacked(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("_row.*", *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: the session's spark.checkpoint.dir. Where it is unset a new temporary folder serves a local session (tests); on a cluster, whose machines don't share one, that is an error."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="thicket-"))
        there = sc.getCheckpointDir()
    return there


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; for narrow tables."""
    scratch(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints that nothing refers to any more; it looks for them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared folder; for wide tables, and for what is read column by column. The table goes when the session ends: what is lazily read from it may be read at any time before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/thicket-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more; other tables stay."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            there = sc._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes a broadcast of df takes, by what its rows hold."""
    each: Column = F.lit(64)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            each += F.coalesce(F.octet_length(c), F.lit(0))
        else:
            each += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if kind in ("array", "map", "struct") else F.lit(8)
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def with_small(left: DataFrame, small: DataFrame, on: Column, how: str = "left", limit: int = 32 << 20) -> DataFrame:
    """Joins a cut table; it is broadcast only if its rows hold at most `limit` bytes, else Spark plans a shuffle join."""
    return left.join(F.broadcast(small) if bytes_of(small) <= limit else small, on, how)


def index_schema(vals: dict[str, str]) -> str:
    """Rows of an inverted index: a thing, told by the columns vals, under one of its keys. With the l-columns set, the row is a link to an earlier thing of the same key, found before the shuffle."""
    return ", ".join(["key long", *(f"{n} {t}" for n, t in vals.items()), *(f"l{n} {t}" for n, t in vals.items())])


def _firsts(*cols) -> np.ndarray:
    """For rows sorted by cols: the place of the first row equal in them to each row."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def combined(names: list[str], key, vals: list, runs: bool = False) -> pa.RecordBatch:
    """Index rows of one batch, pre-aggregated: the first row of each key (with runs: of each key and first value) stays an index row, the others become links to it, so a frequent key costs few shuffled index rows a batch; repetitions go."""
    order = np.lexsort((*vals[::-1], key))
    key, vals = key[order], [v[order] for v in vals]
    first = _firsts(key, vals[0]) if runs else _firsts(key)
    own = first == np.arange(len(key))
    keep = own | np.any([v != v[first] for v in vals], axis=0)
    cols = [pa.array(x[keep]) for x in (key, *vals)] + [pa.array(x[first][keep], mask=own[keep]) for x in vals]
    return pa.RecordBatch.from_arrays(cols, names=["key", *names, *(f"l{n}" for n in names)])


def links_by_key(index: DataFrame, vals: dict[str, str], runs: bool = False) -> DataFrame:
    """One shuffle: every index row linked to the first row of its key, so no more links than rows. With runs, rows of a key that are equal in the first value are linked to the first of these (but under keys whose two low bits aren't 0: what these would tell is told already), and that one to the first of the key."""
    names = list(vals)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the first rows of the key and of the run at hand, all that is kept between batches
        for b in batches:
            found = b.column(f"l{names[0]}").is_valid()
            done = b.filter(found)
            if done.num_rows:
                yield done
            b = b.filter(pc.invert(found))
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1 + len(names))]
            before = [h for h in held if h[0] == rows[0][0]]
            if before:
                rows = [np.concatenate(([h[i] for h in before], x)).astype(x.dtype) for i, x in enumerate(rows)]
            of_key = _firsts(rows[0])
            of_run = _firsts(rows[0], rows[1]) if runs else of_key
            at = np.arange(len(rows[0]))
            to = np.where(of_run != at, of_run, of_key)
            held = [[x[i] for x in rows] for i in dict.fromkeys((int(of_key[-1]), int(of_run[-1])))]
            old = (at >= len(before)) & (to != at) & np.any([x != x[to] for x in rows[1:]], axis=0)
            if runs:
                old &= (of_run == at) | (rows[0] & 3 == 0)
            if old.any():
                cols = [x[old] for x in rows] + [x[to][old] for x in rows[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", *names, *(f"l{n}" for n in names)])

    # links found before the shuffle need not meet the other rows of their key: they go anywhere, so that a frequent key's don't meet in one task
    place = F.when(F.col(f"l{names[0]}").isNull(), F.col("key")).otherwise(F.xxhash64(*names))
    return index.repartition(place).sortWithinPartitions("key", *names).mapInArrow(lead, index_schema(vals))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each connected component, for every node that has a link.

    Large-star and small-star steps in turn until nothing changes; each is an aggregation and a join, both split by Spark where a node is hot. Edges are cut after each turn.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, written(small)
        discarded(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        del both, least, large, low, small
        tidy(links.sparkSession)
        if now == before or not now["n"]:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels after more links: the components of the components that these join."""
    one, two = (labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in "ab")
    new = found.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    ends = new.select(F.col("a").alias("node"), F.col("x").alias("label")).unionByName(new.select(F.col("b").alias("node"), F.col("y").alias("label")))
    joined = components(new, "x", "y").select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(labels.unionByName(ends).distinct().join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
