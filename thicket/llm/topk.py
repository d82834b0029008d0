"""Exact top-k search by inner product: term-at-a-time accumulation of sparse queries over postings of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import cut, table, written

#: Bytes of query components that one pass over the candidates broadcasts; more queries take more passes.
PASS_BYTES = 64 << 20


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of each component; vectors that are null or hold a null or non-finite component are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    ok = x.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.where(ok).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"))


def _scored(k: int, sent) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, starts, terms, weights = sent.value
        n = len(ids)
        best_s = [np.zeros(0, np.int64)] * n
        best_v = [np.zeros(0, np.int64)] * n
        for b in batches:
            if not b.num_rows or not n:
                continue
            vec = b.column("vec_id").to_numpy(zero_copy_only=False)
            lists = b.column("q")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            cand = np.repeat(np.arange(len(vec)), sizes)
            term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            use = flat != 0
            order = np.argsort(term[use], kind="stable")
            cand, term, flat = cand[use][order], term[use][order], flat[use][order]
            cuts = np.searchsorted(term, np.arange((int(term[-1]) if len(term) else -1) + 2))
            for i in range(n):
                dense = np.zeros(len(vec), np.int64)
                for t, w in zip(terms[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]], strict=True):
                    if t + 1 < len(cuts):
                        a, z = cuts[t], cuts[t + 1]
                        if z - a == len(vec):  # a full posting list is in order
                            dense += w * flat[a:z]
                        else:
                            dense[cand[a:z]] += w * flat[a:z]
                other = vec != ids[i]
                if len(best_s[i]) == k:
                    other &= dense >= best_s[i][-1]
                at = np.flatnonzero(other)
                if not len(at):
                    continue
                s, v = dense[at], vec[at]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    s, v = s[s >= least], v[s >= least]  # ties at the edge are settled below
                s, v = np.concatenate((best_s[i], s)), np.concatenate((best_v[i], v))
                top = np.lexsort((v, -s))[:k]
                best_s[i], best_v[i] = s[top], v[top]
        sizes = np.array([len(x) for x in best_s], np.int64)
        if sizes.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(best_v)), pa.array(np.concatenate(best_s))], names=["row", "query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of candidates with the highest integer inner product with each row of queries, all if there are fewer; ties go to the smaller vec_id. Both are (vec_id, q array<long>).

    A row is never its own query's answer: rows with the query's vec_id are left out. Components beyond the shorter vector count as 0. Repeated query rows are answered each; repeated candidate rows are answers each. An empty table on either side gives an empty result.

    Scores are exact while the sums of products fit 64 bits: quantised components up to 2^28 in vectors of 64, say. Queries of one pass are all that the driver holds.

    Exhaustive: the queries are split by hash into passes of bounded size, each broadcast to all tasks, run and written before the next; a task scatters the weighted postings of its candidates into one dense score array a query and batch, keeps the k best, and at most k rows a query and task are merged.
    """
    spark = queries.sparkSession
    q = cut(queries.select(F.xxhash64("vec_id", "q", F.monotonically_increasing_id()).alias("row"), "vec_id", "q"))
    total = q.agg(F.sum(F.size("q") * 16 + 24)).first()[0] or 0
    passes = max(1, -(-int(total) // pass_bytes))
    found = None
    for p in range(passes):
        part = q.where(F.pmod(F.col("row"), F.lit(passes)) == p).collect()  # bounded by pass_bytes
        arrays = [np.array(r["q"], np.int64) for r in part]
        terms = [np.flatnonzero(a) for a in arrays]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in terms]))).astype(np.int64)
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part], np.int64), np.array([r["row"] for r in part], np.int64), starts, np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*(a[t] for a, t in zip(arrays, terms, strict=True)), np.zeros(0, np.int64)]).astype(np.int64)))
        own = candidates.select("vec_id", "q").mapInArrow(_scored(k, sent), "row long, query_id long, vec_id long, score long")
        if passes > 1:
            own = written(own)
            sent.destroy()
        found = own if found is None else found.unionByName(own)
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's ten best of every query row, by top_k(); rows without vec_id take no part."""
    v = quantised(table(spark, sf_dir, "embeddings").where("vec_id is not null"))
    return top_k(v.where(is_query(F.col("vec_id"))), v)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
