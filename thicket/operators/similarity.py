"""Overlap, similarity and alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of one matrix of similarities, and places in the order of a similarity that is NaN (first), null (last), or none at all.
CELLS, NAN, NULL = 4_000_000, 2.0, -2.0


def _vectors(a: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whether each counts) of a list array; null vectors and those with null components or of another length don't."""
    out = np.zeros((len(a), dims))
    size = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    ok = size == dims
    values = a.filter(pa.array(ok)).flatten()
    rows = pc.cast(values, pa.float64())
    whole = rows.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(1)
    out[np.flatnonzero(ok)] = pc.fill_null(rows, 0.0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    ok[np.flatnonzero(ok)[~whole]] = False
    return out, ok


def _nearest(block, k: int):
    """(query, item_id, similarity): of the items of a task the k nearest of each query of the block (ids, vectors, whether these count), by their place in it; ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_ok = block.value
        q_norm = np.sqrt((q * q).sum(1))
        best, who = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)
        at_once = max(1, CELLS // max(1, len(q_ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                b = whole.slice(at, at_once)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                x, x_ok = _vectors(b.column(1), q.shape[1])
                ids, x, x_ok = ids[order], x[order], x_ok[order]
                with np.errstate(all="ignore"):
                    s = (q @ x.T) / (q_norm[:, None] * np.sqrt((x * x).sum(1)))
                    s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0
                s[np.isnan(s)] = NAN
                s[~q_ok] = NULL
                s[:, ~x_ok] = NULL
                own = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
                for r in np.flatnonzero(own[0] < own[1]):
                    s[r, own[0][r] : own[1][r]] = -np.inf
                better = (s > best[:, -1:]) | ((s == best[:, -1:]) & (ids < who[:, -1:]))
                rows = np.flatnonzero(better.any(1))
                top = np.argsort(-s[rows], axis=1, kind="stable")[:, :k]
                value, name = np.concatenate((best[rows], np.take_along_axis(s[rows], top, 1)), 1), np.concatenate((who[rows], ids[top]), 1)
                first = np.lexsort((name, -value), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(value, first, 1), np.take_along_axis(name, first, 1)
        row, place = np.nonzero(best > -np.inf)
        value = best[row, place]
        for at in range(0, len(row), 100_000):
            part = slice(at, at + 100_000)
            v = np.where(value[part] == NAN, np.nan, value[part])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[part]]), pa.array(who[row, place][part]), pa.array(v, mask=value[part] == NULL)], names=["query_id", "item_id", "similarity"])

    return run


def top_k_cosine(queries: DataFrame, items: DataFrame, id_: str, vector: str, k: int, limit: int = 4_000) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k items nearest each query, ties by id (whole numbers). Similarities are rounded to six digits; null vectors, and those with null components or of another length than the first query's, have none and come last, NaN (of zero or infinite vectors) first, as they sort in SQL.

    queries are a stated set. It goes by blocks of at most `limit`, each a matrix that is multiplied with the items' batches in every task; a task hands on k rows a query.
    """
    spark = items.sparkSession
    q = queries.select(F.col(id_).cast("long").alias("query_id"), F.col(vector).alias("_q"))
    blocks = max(1, -(-q.count() // limit))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        vectors = part.column("_q").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))
        dims = next((len(v) for v in vectors if v.is_valid), 0)
        block = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), *_vectors(vectors, dims)))
        near = items.select(F.col(id_).cast("long").alias("item_id"), vector).mapInArrow(_nearest(block, k), "query_id long, item_id long, similarity double")
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_overlap(pairs: DataFrame, id_: list[str], a: str, b: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(id, common, n_a, n_b, precision, recall, f1) of the token multisets of two texts; no common token gives 0."""
    one = lambda c, n: pairs.select(*id_, F.explode(tokens(F.col(c))).alias("token")).groupBy(*id_, "token").agg(F.count("*").alias(n))
    both = one(a, "_ca").join(one(b, "_cb"), [*id_, "token"]).groupBy(*id_).agg(F.sum(F.least("_ca", "_cb")).alias("common"))
    sized = pairs.select(*id_, F.size(tokens(F.col(a))).alias("n_a"), F.size(tokens(F.col(b))).alias("n_b")).join(both, id_, "left").fillna(0, ["common"])
    part = lambda x: F.when(F.col("common") > 0, F.col("common") / F.col(x)).otherwise(0.0)
    s = sized.withColumn("precision", part("n_a")).withColumn("recall", part("n_b"))
    return s.withColumn("f1", F.when(F.col("common") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def step_labels(pairs: Column, gold: Column, sampled: Column) -> Column:
    """Of an alignment (a: place in gold, b: in sampled, -1 a gap) the array of struct(prefix, positive, negative): the sampled steps so far, the gold step and the sampled one in its place, wherever both are there and differ."""
    both = F.filter(pairs, lambda p: (p["a"] >= 0) & (p["b"] >= 0) & (F.get(gold, p["a"]) != F.get(sampled, p["b"])))
    return F.transform(both, lambda p: F.struct(F.slice(sampled, F.lit(1), p["b"]).alias("prefix"), F.get(gold, p["a"]).alias("positive"), F.get(sampled, p["b"]).alias("negative")))
