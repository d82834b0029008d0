"""Alignments of the sentences of turns with those of their replies and with edited copies of their own. The SQL fills the table of costs row by row and walks back through it by recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.operators import alignment, similarity
from thicket.plans.tables import read

QUERIES, ORACLES = {}, {}

_WORDS = "list_distinct(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> ''))"
ALIGN = f"""WITH RECURSIVE w AS (
  SELECT conv_id, turn, string_split(text, '. ') AS x, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '. ') AS r FROM conversations),
t AS MATERIALIZED (
  SELECT conv_id, turn, 'reply' AS kind, x, r AS y FROM w WHERE r IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, 'edited', x, list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (i + turn) % 4 = 0 THEN r[i] WHEN (i + turn) % 4 = 1 THEN NULL ELSE x[i] END), lambda s: s IS NOT NULL)
  FROM w WHERE r IS NOT NULL),
c AS MATERIALIZED (
  SELECT *, list_transform(xs, lambda p: list_transform(ys, lambda q: CASE WHEN len(p) + len(q) = 0 THEN 0 ELSE 1000000 - 1000000 * len(list_intersect(p, q)) // (len(p) + len(q) - len(list_intersect(p, q))) END)) AS cost
  FROM (SELECT *, list_transform(x, lambda s: {_WORDS}) AS xs, list_transform(y, lambda s: {_WORDS}) AS ys FROM t)),
d AS (
  SELECT conv_id, turn, kind, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: j * 600000) AS cells FROM c
  UNION ALL
  SELECT conv_id, turn, kind, i + 1, list_transform(range(0, m + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: down[k + 1] + (j - k) * 600000)))
  FROM (SELECT d.*, len(c.y) AS m, list_transform(range(0, len(c.y) + 1), lambda j: CASE WHEN j = 0 THEN (i + 1) * 600000 ELSE least(cells[j] + c.cost[i + 1][j], cells[j + 1] + 600000) END) AS down
        FROM d JOIN c ON d.conv_id = c.conv_id AND d.turn = c.turn AND d.kind = c.kind WHERE i < len(c.x))),
g AS MATERIALIZED (SELECT conv_id, turn, kind, list(cells ORDER BY i) AS cells FROM d GROUP BY ALL),
b AS (
  SELECT conv_id, turn, kind, len(x) AS i, len(y) AS j, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS pairs FROM c
  UNION ALL
  SELECT conv_id, turn, kind, CASE WHEN way < 2 THEN i - 1 ELSE i END, CASE WHEN way <> 1 THEN j - 1 ELSE j END,
         list_prepend({{'a': CASE WHEN way < 2 THEN i - 1 ELSE -1 END, 'b': CASE WHEN way <> 1 THEN j - 1 ELSE -1 END}}, pairs)
  FROM (SELECT b.*, CASE WHEN i > 0 AND j > 0 AND g.cells[i + 1][j + 1] = g.cells[i][j] + c.cost[i][j] THEN 0 WHEN i > 0 AND g.cells[i + 1][j + 1] = g.cells[i][j + 1] + 600000 THEN 1 ELSE 2 END AS way
        FROM b JOIN g ON b.conv_id = g.conv_id AND b.turn = g.turn AND b.kind = g.kind JOIN c ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.kind = c.kind WHERE i + j > 0)),
al AS (
  SELECT b.conv_id, b.turn, b.kind, b.pairs, c.x, c.y, CAST(g.cells[len(c.x) + 1][len(c.y) + 1] AS BIGINT) AS cost
  FROM b JOIN g ON b.conv_id = g.conv_id AND b.turn = g.turn AND b.kind = g.kind JOIN c ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.kind = c.kind WHERE b.i + b.j = 0)"""


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = ALIGN + sql
        return f

    return put


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, kind, x, y, al): each turn's sentences with its reply's, and with its own of which every fourth is replaced and every fourth left out."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    sentences = lambda c: F.split(c, r"\. ")
    c = read(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(over)).where("reply is not null")
    c = c.select("conv_id", "turn", sentences("text").alias("x"), sentences("reply").alias("r"))

    def edit(i: Column) -> Column:
        kind = (i + F.col("turn")) % 4
        return F.when(kind == 0, F.get("r", i - 1)).when(kind != 1, F.get("x", i - 1))

    edited = F.filter(F.transform(F.sequence(F.lit(1), F.size("x")), edit), lambda s: s.isNotNull())
    both = F.array(F.struct(F.lit("reply").alias("kind"), F.col("r").alias("y")), F.struct(F.lit("edited").alias("kind"), edited.alias("y")))
    d = c.select("conv_id", "turn", "x", F.explode(both).alias("e")).select("conv_id", "turn", "x", "e.*")
    return d.withColumn("al", alignment.aligned(F.col("x"), F.col("y")))


@query(" SELECT conv_id, turn, kind, cost, array_to_string(list_transform(pairs, lambda p: p.a || ':' || p.b), ' ') AS pairs FROM al")
def step_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the sentences of each pair of texts and what it costs."""
    pairs = F.array_join(F.transform("al.pairs", lambda p: F.concat_ws(":", p["a"], p["b"])), " ")
    return _pairs(spark, sf_dir).select("conv_id", "turn", "kind", "al.cost", pairs.alias("pairs"))


@query(" SELECT conv_id, turn, kind, cost FROM al WHERE cost <= 500000 * len(x)")
def alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose alignment costs half a step a step of the first at most."""
    d = _pairs(spark, sf_dir).where(F.col("al.cost") <= 500_000 * F.size("x"))
    return d.select("conv_id", "turn", "kind", "al.cost")


@query(""" SELECT conv_id, turn, kind, CAST(p.b AS BIGINT) AS n_prefix, array_to_string(y[1:p.b], '|') AS prefix, x[p.a + 1] AS positive, y[p.b + 1] AS negative
FROM (SELECT *, unnest(pairs) AS p FROM al) WHERE p.a >= 0 AND p.b >= 0 AND x[p.a + 1] <> y[p.b + 1]""")
def step_label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training triples: the sampled steps so far, the gold step, and the other one in its place."""
    t = _pairs(spark, sf_dir).select("conv_id", "turn", "kind", F.explode(similarity.step_labels(F.col("al.pairs"), F.col("x"), F.col("y"))).alias("t"))
    return t.select("conv_id", "turn", "kind", F.size("t.prefix").cast("long").alias("n_prefix"), F.array_join("t.prefix", "|").alias("prefix"), "t.positive", "t.negative")
