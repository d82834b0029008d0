"""Extraction, judging, similarity and rendering over documents, pages, benchmark, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import extract, judge
from thicket.operators import contained, similarity, windows
from thicket.plans.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_NUMBER = r"(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?'))[-1]"


@query(f"SELECT doc_id, {_NUMBER} AS answer FROM documents WHERE regexp_matches(text, '[0-9]')")
def extract_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", extract.last_number(F.col("text")).alias("answer"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS n_items, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages")
def extract_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.size(extract.tagged(F.col("html"), "li")).cast("long").alias("n_items"), F.nullif(F.get(extract.tagged(F.col("html"), "title"), 0), F.lit("")).alias("title"))


@query(r"""WITH t AS (SELECT doc_id, 'Step ' || n_chars || '. The answer is $' || (n_chars % 1000) || ',' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.' || chr(10) || '#### ' || n_chars AS t FROM documents)
SELECT doc_id, regexp_extract(t, '#### (\-?[0-9\.\,]+)', 1) AS gold, replace(replace(regexp_extract(t, '^[^\n]*The answer is [^\n]*?([ $.0-9,\-=]+)[^\n]*\.', 1), ',', ''), '$', '') AS answer FROM t""")
def extract_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written by rule from the documents' numbers, and read back."""
    t = F.concat(F.lit("Step "), F.col("n_chars"), F.lit(". The answer is $"), F.col("n_chars") % 1000, F.lit(","), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(".\n#### "), F.col("n_chars"))
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", extract.marked_number(F.col("t")).alias("gold"), extract.final_number(F.col("t")).alias("answer"))


@query(f"""WITH t AS (SELECT doc_id, {_NUMBER} AS a, CAST(doc_id % 10 AS VARCHAR) AS g FROM documents WHERE regexp_matches(text, '[0-9]'))
SELECT doc_id, a AS answer, g AS gold, CASE WHEN regexp_matches(a, '^-?[0-9]+$') THEN coalesce(TRY_CAST(a AS BIGINT) = TRY_CAST(g AS BIGINT), TRY_CAST(a AS DOUBLE) = TRY_CAST(g AS DOUBLE), a = g) ELSE coalesce(TRY_CAST(a AS DOUBLE) = TRY_CAST(g AS DOUBLE), a = g) END AS correct FROM t""")
def judge_numeric_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike("[0-9]"))
    a, g = extract.last_number(F.col("text")), (F.col("doc_id") % 10).cast("string")
    return d.select("doc_id", a.alias("answer"), g.alias("gold"), judge.numeric_ladder(a, g).alias("correct"))


@query("SELECT item_id, count(doc_id) AS n_docs, coalesce(min(doc_id), -1) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def judge_answer_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item word for word: joined on each item's rarest pair of words, then looked through."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    found = contained.holders(b, read(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return b.select("item_id").join(hits, "item_id", "left").fillna(0, ["n_docs"]).fillna(-1, ["first_doc"])


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_texts FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def anti_join_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("text").join(read(spark, sf_dir, "benchmark").select("text"), "text", "left_anti")
    return d.agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similarity.top_k_cosine(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


_TOKENS = "list_filter(string_split_regex(lower(regexp_replace({0}, '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g')), ' +'), lambda x: x <> '')"
_OVERLAP = f"""WITH q AS (SELECT conv_id * 1000 + turn AS item_id, text AS x, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations),
p AS (SELECT item_id, {_TOKENS.format('x')} AS a, {_TOKENS.format('y')} AS b FROM q WHERE y IS NOT NULL),
x AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(a) AS t FROM p) GROUP BY ALL), y AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(b) AS t FROM p) GROUP BY ALL),
c AS (SELECT x.item_id, CAST(sum(least(x.n, y.n)) AS BIGINT) AS common FROM x JOIN y ON x.item_id = y.item_id AND x.t = y.t GROUP BY x.item_id),
r AS (SELECT p.item_id, coalesce(common, 0) AS common, coalesce(common / len(a), 0.0) AS precision, coalesce(common / len(b), 0.0) AS recall FROM p LEFT JOIN c ON p.item_id = c.item_id)"""


def _tokens(c):
    return F.array_remove(F.split(F.lower(F.regexp_replace(c, "[^A-Za-zÀ-ÿ0-9]+", " ")), " +"), "")


@query(_OVERLAP + " SELECT item_id, common, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN common > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM r")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = similarity.token_overlap(_turn_pairs(spark, sf_dir).withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn")), ["item_id"], "a", "b", _tokens)
    return o.select("item_id", "common", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_OVERLAP + " SELECT count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM r")
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = similarity.token_overlap(_turn_pairs(spark, sf_dir).withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn")), ["item_id"], "a", "b", _tokens)
    return o.agg(F.count("*").alias("n"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(w)).where("reply is not null")
    return c.select("conv_id", "turn", F.col("text").alias("a"), F.col("reply").alias("b"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) > 10 GROUP BY ALL)
SELECT doc_id, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_uses, CAST(sum((n - 1) * length(line)) AS BIGINT) AS saved FROM c WHERE n > 1 GROUP BY doc_id""")
def compress_chunks_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of over ten characters that repeat inside their document, found inside the row: no line leaves it unless it repeats."""
    line = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 10)
    d = read(spark, sf_dir, "documents").select("doc_id", line.alias("ls")).where(F.size("ls") > F.size(F.array_distinct("ls")))
    c = d.select("doc_id", F.explode("ls").alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_uses"), F.sum((F.col("n") - 1) * F.length("line")).alias("saved"))


@query("""WITH i AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 ELSE 1 END AS f FROM documents)
SELECT doc_id, lang, CAST(i // f AS BIGINT) AS block, CAST(i % f AS BIGINT) AS place FROM i""")
def interleave_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return windows.interleaved(d, "lang", "doc_id", {"en": 6, "fr": 2, "de": 1, "es": 1}).select("doc_id", "lang", "block", "place")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg('## Step ' || n || chr(10) || role || ': ' || text, chr(10) ORDER BY n) AS history FROM n GROUP BY conv_id""")
def memory_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rendered(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.concat("role", F.lit(": "), "text"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: contains(lower(x), 'tion and')) AS s FROM documents WHERE contains(lower(text), 'tion and'))
SELECT doc_id, len(s) AS n_found, array_to_string(s[1:5], ' | ') AS found FROM s WHERE len(s) > 0""")
def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five sentences that hold a keyword."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\. "), lambda x: F.lower(x).contains("tion and")).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("long").alias("n_found"), F.array_join(F.slice("s", 1, 5), " | ").alias("found"))


@query("""WITH t AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ') AS n FROM benchmark)
SELECT item_id, n AS normal, length(n) AS n_chars FROM t""")
def normalise_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", extract.normalised(F.col("text")).alias("normal"))
    return b.withColumn("n_chars", F.length("normal").cast("long"))

