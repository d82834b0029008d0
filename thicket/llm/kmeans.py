"""Exact integer k-means over quantised vectors, with block-norm screening of the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import table, with_small, written

DIM = 64
#: Components of a segment. The norm of each is what a vector is compressed to.
SEGMENT = 8
#: Distances fit 64 bits while no component is beyond this.
BOUND = 1 << 27
#: Vectors that go through numpy at a time.
AT_ONCE = 4096


def segment_norms(q: np.ndarray) -> np.ndarray:
    """Upper bounds, whole numbers, of the norm of each segment of each row: rounding up keeps products of them bounds of inner products."""
    squares = np.add.reduceat(q * q, np.arange(0, q.shape[1], SEGMENT), axis=1)
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + 2.0**-40)).astype(np.int64)


def screened(q: np.ndarray, norms: np.ndarray, length: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, centroids that got an exact distance) of each row of q; ties go to the smaller number. norms, length: segment norms and squared length of the rows.

    By Cauchy and Schwarz x.c is at most the product of the segment norms, so |x|^2 + |c|^2 less twice that is a lower bound of the distance. The centroid of least bound is measured first; of the others only those whose bound isn't above the least distance so far.
    """
    c_norms, c_length = segment_norms(centroids), (centroids * centroids).sum(1)
    low = length[:, None] + c_length - 2 * (norms @ c_norms.T)
    rows = np.arange(len(q))
    order = np.argsort(low, axis=1, kind="stable")
    best = order[:, 0]
    least = ((q - centroids[best]) ** 2).sum(1)
    exact = np.ones(len(q), np.int64)
    for turn in range(1, len(centroids)):
        c = order[:, turn]
        open_ = rows[low[rows, c] <= least]
        if not len(open_):
            break  # bounds ascend, so no later turn opens a row again
        c = c[open_]
        d = ((q[open_] - centroids[c]) ** 2).sum(1)
        better = (d < least[open_]) | ((d == least[open_]) & (c < best[open_]))
        best[open_[better]], least[open_[better]] = c[better], d[better]
        exact[open_] += 1
    return best, least, exact


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for k in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(k, AT_ONCE)
            q, norms = (b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for n in ("q", "norms"))
            yield b, q, norms, b.column("length").to_numpy(zero_copy_only=False)


def compressed(vectors: DataFrame, dim: int = DIM, scale: int = 1024) -> DataFrame:
    """(vec_id, q array<long>, norms array<long>, length): floor(scale * x) of the components with their segment norms and squared length. Vectors that are null, have another number of components, or hold a null or non-finite one are left out; a component beyond 2^27 stops the job, since its distances wouldn't fit 64 bits."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where((F.size("embedding") == dim) & ~F.coalesce(bad, F.lit(True)))
    far = F.lit(f"a component is beyond {BOUND}: distances would not fit 64 bits")
    whole = lambda v: F.when(F.abs(v * scale) <= BOUND, F.floor(v * scale).cast("long")).otherwise(F.raise_error(far).cast("long"))
    q = kept.select("vec_id", F.transform(x, whole).alias("q"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            norms = segment_norms(v)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * norms.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array((v * v).sum(1))], names=["vec_id", "q", "norms", "length"])

    kind = dict(q.dtypes)["vec_id"]
    return q.mapInArrow(measured, f"vec_id {kind}, q array<long>, norms array<long>, length long")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:vec_id`, in that order; rows of equal vec_id go by their components. A null vec_id is hashed as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows, a parameter
    return np.array([r["q"] for r in rows], np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, exact): the nearest centroid of each compressed vector."""
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, q, norms, length in _parts(batches):
            best, least, exact = screened(q, norms, length, centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least), pa.array(exact.astype(np.int32))], names=["vec_id", "cluster", "distance", "exact"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, exact int")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each task sums its vectors by centroid, one row a centroid and task is shuffled, and k rows of exact sums come back."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * dim for _ in range(k)], [0] * k
        for _, q, norms, length in _parts(batches):
            best, _, _ = screened(q, norms, length, centroids)
            for c in np.unique(best):
                mine = q[best == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(0), strict=True)]
        used = [c for c in range(k) if count[c]]
        if used:
            lists = pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([count[c] for c in used], pa.int64()), lists], names=["cluster", "n", "s"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, s array<string>")
    whole = lambda i: F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).cast("string")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[whole(i) for i in range(dim)]).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(rows of assigned(), centroids): Lloyd's rounds in whole numbers from first_centroids(); a centroid becomes the floor of its vectors' mean, one without vectors stays. Every row of vectors that compressed() keeps is clustered, repeated ones too; with fewer than k of them there are as many centroids as rows, with none the result is empty. Other columns aren't looked at.

    The compressed vectors are written once and read in every round; a round's driver part is k sums.
    """
    v = written(compressed(vectors, dim))
    centroids = first_centroids(v, k, seed)
    if not len(centroids):
        return assigned(v, np.zeros((1, dim), np.int64)), centroids
    for _ in range(rounds):
        now = moved(v, centroids)
        if np.array_equal(now, centroids):
            break  # nothing moves any more: later rounds would give the same
        centroids = now
    return written(assigned(v, centroids)), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding of 64 finite components with its cluster; null, short, long and non-finite ones have no row, repeated ones one each. An empty table gives no rows."""
    rows, centroids = k_means(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = [(c, s, sum(inertia.values()), hashes[c]) for c, s in inertia.items()]
    told = spark.createDataFrame(told, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return with_small(rows, told, F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = DIM) -> str:
    """The query in SQL, the rounds written out one after the other."""
    near = """a{i} AS MATERIALIZED (
  SELECT v.r, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{i} c ON v.i = c.i GROUP BY v.r, c.k
  QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.k) = 1)"""
    move = """c{j} AS MATERIALIZED (
  SELECT c.k, c.i, CAST(CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS BIGINT) AS x
  FROM c{i} c LEFT JOIN (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v ON a.r = v.r GROUP BY a.k, v.i) s ON c.k = s.k AND c.i = s.i)"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, {dim + 1})) AS i FROM e)),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k FROM e QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT s.k, v.i, v.x FROM s JOIN v ON s.r = v.r),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k),
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY k)
SELECT e.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, t.s AS cluster_inertia,
       (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN e ON a.r = e.r JOIN h ON a.k = h.k JOIN t ON a.k = t.k"""


ORACLE = oracle()
