"""Sharding along a Hilbert curve over quantised metadata, so that each shard covers a small box of every dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import cut, table


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with coordinates in [0, 2^bits), as a long.

    The usual transform from axes to the transposed index (exchange or invert the low bits of each axis from the top bit down, Gray-code, undo), folded over (bit, axis) steps so that the expression's size doesn't depend on bits.
    """
    n = len(dims)
    start = F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        xi = F.element_at(x, s["i"] + 1)
        swap = (F.element_at(x, 1).bitwiseXOR(xi)).bitwiseAND(low)
        is_set = xi.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(is_set & (k == 0), v.bitwiseXOR(low)).when(~is_set & ((k == 0) != (k == s["i"])), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, start, step) if bits > 1 else start
    gray = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(turned, 1, k), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))
    qs = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")

    def index(g: Column) -> Column:
        undo = F.aggregate(qs, F.lit(0).cast("long"), lambda t, q: F.when(F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda s, t: F.when(F.element_at(g, s["i"] + 1).bitwiseXOR(t).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.transform(F.array(undo), lambda t: F.aggregate(places, F.lit(0).cast("long"), lambda h, s: h * 2 + bit(s, t)))[0]

    return F.transform(F.array(gray), index)[0]


def coordinates(size: Column, bits: int) -> list[Column]:
    """Coordinates of a document: language, source (both hashed to a slab each; null has one of its own kind) and size (its binary logarithm to a quarter)."""
    slab = lambda c: F.pmod(F.crc32(F.concat(F.lit("v"), F.col(c)).cast("binary")), F.lit(1 << bits))
    exponent = F.length(F.bin(size)) - 1
    quarter = F.when(exponent >= 2, F.floor(size * 4 / F.pow(F.lit(2.0), exponent)) - 4).otherwise(0)
    log4 = F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), (exponent * 4 + quarter).cast("int") - 8))
    return [F.coalesce(slab("lang"), F.lit(0)), F.coalesce(slab("source"), F.lit(0)), log4]


def hilbert_shards(docs: DataFrame, n_shards: int = 16, bits: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its shard and slot: rows in curve order, cut into n_shards runs whose row counts are at most one apart.

    Returns doc_id, the columns named in carry, size (bytes of the text, null none, plus 1), text_crc32, curve (index), shard (int), slot (long, gapless from 0 in each shard). Ties on the curve go by doc_id, checksum and size, so rows that share a cell, however many, are spread over tasks; rows equal in all of these are interchangeable. Null doc_id sorts first. An empty table gives an empty result; other columns aren't looked at.

    Rows are range-partitioned and sorted once, and numbered inside their partition; only the row count of each partition is gathered, one row a partition.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    d = docs.select("doc_id", *carry, "lang", "source", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    d = d.select("doc_id", *carry, "size", "text_crc32", hilbert_index(coordinates(F.col("size"), bits), bits).alias("curve"))
    keys = ["curve", "doc_id", "text_crc32", "size"]
    d = cut(d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = d.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    start, starts = 0, []
    for r in sorted(counts):
        starts.append((r["_part"], start))
        start += r["n"]
    total = start
    offsets = d.sparkSession.createDataFrame(starts, "_part long, _start long")
    d = d.join(F.broadcast(offsets), part == F.col("_part")).withColumn("_row", F.col("_start") + place)
    base, more = divmod(total, n_shards)
    long_rows = more * (base + 1)
    shard = F.when(F.col("_row") < long_rows, F.expr(f"_row div {base + 1}")).otherwise(F.lit(more) + F.expr(f"(_row - {long_rows}) div {max(base, 1)}")).cast("int")
    d = d.withColumn("shard", shard)
    first = F.when(F.col("shard") <= more, F.col("shard") * F.lit(base + 1).cast("long")).otherwise(long_rows + (F.col("shard") - more) * F.lit(base).cast("long"))
    return d.withColumn("slot", (F.col("_row") - first).cast("long")).drop("_at", "_part", "_start", "_row")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, bits: int = 6) -> None:
    """Writes whole documents as n_shards folders of Parquet, in curve order inside each, so that file statistics prune on language, source and size."""
    placed = hilbert_shards(docs, n_shards, bits, tuple(c for c in ("text", "lang", "source") if c in docs.columns))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along the curve; the law is `rows`."""
    d = hilbert_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
