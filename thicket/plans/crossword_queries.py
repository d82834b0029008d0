"""Crosswords made of each document's words of five letters: three across, two down. The SQL joins words on their letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.operators import crosswords
from thicket.plans.tables import read
from thicket.storage import written

QUERIES, ORACLES = {}, {}

#: Cells of a board of five by five.
SLOTS = {"h1": [0, 1, 2, 3, 4], "v1": [0, 5, 10, 15, 20], "v5": [4, 9, 14, 19, 24], "h3": [10, 11, 12, 13, 14], "h5": [20, 21, 22, 23, 24]}
WORDS = "w AS MATERIALIZED (SELECT doc_id, t AS word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM documents) WHERE length(t) = 5 GROUP BY ALL)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words of five letters for each slot; the texts are split once for all slots."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) = 5")
    c = written(d.groupBy("doc_id", "word").agg(F.count("*").cast("double").alias("score")))
    return c.select("*", F.explode(F.array(*map(F.lit, SLOTS))).alias("slot"))


def crossword_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document's words fill the board, and the fill of highest score (of the words' counts), the first in the alphabet on ties."""
    g = crosswords.counted(_candidates(spark, sf_dir), "doc_id", SLOTS)
    return g.select("doc_id", "n_fills", F.col("score").cast("long").alias("score"), F.array_join("fill", " ").alias("fill"))


FILLS_SQL = f"""WITH {WORDS}
SELECT a.doc_id, count(*) AS n_fills, CAST(max(a.n + b.n + c.n + d.n + e.n) AS BIGINT) AS score,
       arg_min([a.word, b.word, c.word, d.word, e.word], {{'s': -(a.n + b.n + c.n + d.n + e.n), 'f': [a.word, b.word, c.word, d.word, e.word]}}).array_to_string(' ') AS fill
FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word[1] = b.word[1] JOIN w c ON a.doc_id = c.doc_id AND a.word[5] = c.word[1]
JOIN w d ON a.doc_id = d.doc_id AND b.word[3] = d.word[1] AND c.word[3] = d.word[5] JOIN w e ON a.doc_id = e.doc_id AND b.word[5] = e.word[1] AND c.word[5] = e.word[5]
GROUP BY a.doc_id"""


def crossword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search that tries the three best candidates of each state ends at: whole boards and dead ends, and of each document's by the words filled, the best."""
    sets = crosswords.slot_sets(_candidates(spark, sf_dir), "doc_id", {k: len(v) for k, v in SLOTS.items()})
    f = crosswords.fills(sets, "doc_id", SLOTS, max_per_state=3)
    w = Window.partitionBy("doc_id", "depth").orderBy(F.desc("score"), "fill")
    g = f.withColumn("_r", F.row_number().over(w)).withColumn("n_ends", F.count("*").over(Window.partitionBy("doc_id", "depth"))).where("_r = 1")
    return g.select("doc_id", "depth", "complete", "n_ends", F.col("score").cast("long").alias("score"), F.array_join("fill", " ").alias("fill"))


def _search_sql() -> str:
    on = [
        "true", "w.word[1] = s.fill[1][1]", "w.word[1] = s.fill[1][5]", "w.word[1] = s.fill[2][3] AND w.word[5] = s.fill[3][3]", "w.word[1] = s.fill[2][5] AND w.word[5] = s.fill[3][5]",
    ]
    steps = [WORDS, "s0 AS (SELECT DISTINCT doc_id, CAST([] AS VARCHAR[]) AS fill, 0 AS score FROM w)"]
    for t, cond in enumerate(on):
        steps.append(f"""s{t + 1} AS MATERIALIZED (SELECT s.doc_id, list_append(s.fill, w.word) AS fill, s.score + w.n AS score FROM s{t} s JOIN w ON s.doc_id = w.doc_id AND {cond}
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.fill ORDER BY w.n DESC, w.word) <= 3)""")
        steps.append(f"e{t} AS (SELECT * FROM s{t} s WHERE NOT EXISTS (SELECT 1 FROM s{t + 1} n WHERE n.doc_id = s.doc_id AND n.fill[1:{t}] = s.fill))")
    ends = " UNION ALL ".join(f"SELECT doc_id, fill, score, {t} AS depth, false AS complete FROM e{t}" for t in range(5))
    return f"""WITH {", ".join(steps)}, x AS ({ends} UNION ALL SELECT doc_id, fill, score, 5, true FROM s5)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, complete, count(*) OVER (PARTITION BY doc_id, depth) AS n_ends, CAST(score AS BIGINT) AS score, array_to_string(fill, ' ') AS fill
FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, depth ORDER BY score DESC, fill) = 1"""


QUERIES |= {"crossword_fills": crossword_fills, "crossword_search": crossword_search}
ORACLES |= {"crossword_fills": FILLS_SQL, "crossword_search": _search_sql()}
