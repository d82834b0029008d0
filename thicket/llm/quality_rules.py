"""Quality rules with thresholds from the data: mergeable quantile sketches for each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import SPACE, cut, let, table, with_small, words_of, written

#: The rates, in thousandths (word length: tenths of a character), that the adaptive thresholds bound from above. A sketch is the count of each whole rate, so its size is bounded and sketches merge by addition.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_len")
#: The least room above the upper quartile: groups whose rates hardly vary don't reject what is barely above them. Repeats are rare and uneven in good documents too (three in a hundred have any repeated line, and one such line may be a third of a short text), so quartiles say little of them and their room is wide.
ROOM = {"symbol_rate": 20, "dup_line_rate": 500, "repeat_rate": 400, "word_len": 15}


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more among the words w; windows are sorted by hash with their places, and neighbours compared."""

    def marked(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.when(j > 0, same(j - 1, j)).otherwise(False) | F.when(j < n - 1, same(j, F.least(j + 1, n - 1))).otherwise(False))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda j: F.array(s[j]["i"], s[j]["i"] + 1, s[j]["i"] + 2)))))

    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), marked)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs (text at least) with the struct column `_m` of counts; a null text counts as one without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    m = F.struct(
        counts.alias("c"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    flat = lambda v: F.struct(v["c"]["n_words"].alias("n_words"), v["word_chars"].alias("word_chars"), v["n_symbols"].alias("n_symbols"), v["l"]["n_dup_lines"].alias("n_dup_lines"), v["c"]["n_repeat_words"].alias("n_repeat_words"), v["l"]["n_lines"].alias("n_lines"))
    return docs.withColumn("_m", let(m, flat))


def _rates(m: str = "_m") -> Column:
    """The rates as an array of (rule, rate)."""
    c = lambda k: F.col(f"{m}.{k}")
    rate = lambda a, b: F.floor(a / F.greatest(b, F.lit(1))).cast("long")
    made = {
        "symbol_rate": rate(1000 * c("n_symbols"), c("word_chars")),
        "dup_line_rate": rate(1000 * c("n_dup_lines"), c("n_lines")),
        "repeat_rate": rate(1000 * c("n_repeat_words"), c("n_words")),
        "word_len": rate(10 * c("word_chars"), c("n_words")),
    }
    return F.array(*[F.struct(F.lit(k).alias("rule"), F.least(v, F.lit(1000)).alias("rate")) for k, v in made.items()])


def base_failed(m: str = "_m", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col(f"{m}.n_words") < min_words) | (100 * F.col(f"{m}.n_repeat_words") > max_repeat_percent * F.col(f"{m}.n_words"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Lower and upper quartile of each group's sketch: the least rate at which a quarter, three quarters of its rows lie at or below."""
    w = Window.partitionBy(*by, "rule")
    run = sketch.select(*by, "rule", "rate", "n", F.sum("n").over(w.orderBy("rate")).alias("below"), F.sum("n").over(w).alias("all"))
    return run.groupBy(*by, "rule").agg(F.min(F.when(4 * F.col("below") >= F.col("all"), F.col("rate"))).alias("q1"), F.min(F.when(4 * F.col("below") >= 3 * F.col("all"), F.col("rate"))).alias("q3"), F.max("all").alias("n"))


def thresholds(measures: DataFrame, reach: int = 6, min_group: int = 100) -> DataFrame:
    """(lang, source, limits): for each group the map of upper limits q3 + max(reach * (q3 - q1), room).

    A group of fewer than min_group documents takes the limits of the merged sketch of its language, and a language of fewer those of the merged sketch of all. Documents that fail the base rules aren't counted.
    """
    counted = measures.where(~base_failed()).select("lang", "source", F.explode(_rates()).alias("r"))
    cells = counted.groupBy("lang", "source", "r.rule", "r.rate").agg(F.count("*").alias("n"))
    cells = cut(cells)
    limit = F.col("q3") + F.greatest(reach * (F.col("q3") - F.col("q1")), F.create_map(*[x for k, v in ROOM.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")])
    own = _quartiles(cells, ["lang", "source"]).select("lang", "source", "rule", "n", limit.alias("lim"))
    by_lang = _quartiles(cells.groupBy("lang", "rule", "rate").agg(F.sum("n").alias("n")), ["lang"]).select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.col("n").alias("l_n"), limit.alias("l_lim"))
    of_all = _quartiles(cells.groupBy("rule", "rate").agg(F.sum("n").alias("n")), []).select(F.col("rule").alias("a_rule"), limit.alias("a_lim"))
    best = F.when(F.col("n") >= min_group, F.col("lim")).when(F.col("l_n") >= min_group, F.col("l_lim")).otherwise(F.col("a_lim"))
    picked = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(of_all, F.col("rule") == F.col("a_rule"))
    return picked.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", best))).alias("limits"))


def judged(docs: DataFrame, reach: int = 6, min_group: int = 100, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in keep; all if not given) with the struct `_m` of counts, `_base` (failed the base rules) and `_kept`.

    docs needs text, lang and source; null languages and sources are groups of their own. A document is kept if it passes the base rules and no rate is over its group's limit. Null and empty texts have no words and fail. Repeated rows are judged alike; columns named _m, _base or _kept give way; an empty table gives an empty result. Texts are measured once: rows and counts are written, and read for the sketches and again for the verdicts.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("_m", "_base", "_kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "text", "lang", "source")
    m = written(measured(rows).select("_row", "lang", "source", "_m"))
    lim = cut(thresholds(m.select("lang", "source", "_m"), reach, min_group)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    m = m.withColumn("_base", base_failed()).withColumn("_rates", _rates())
    j = with_small(m, lim, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    over = F.exists("_rates", lambda r: r["rate"] > F.coalesce(F.try_element_at("limits", r["rule"]), F.lit(1000)))
    return j.select("_row.*", "_m", "_base", (~F.col("_base") & ~over).alias("_kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and verdict of every document, by judged()."""
    d = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("doc_id", *counts, F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wins) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (
  SELECT doc_id, lang, source, base_failed, 'symbol_rate' AS rule, least(1000 * n_symbols // greatest(word_chars, 1), 1000) AS rate FROM f
  UNION ALL SELECT doc_id, lang, source, base_failed, 'dup_line_rate', least(1000 * n_dup_lines // greatest(n_lines, 1), 1000) FROM f
  UNION ALL SELECT doc_id, lang, source, base_failed, 'repeat_rate', least(1000 * n_repeat_words // greatest(n_words, 1), 1000) FROM f
  UNION ALL SELECT doc_id, lang, source, base_failed, 'word_len', least(10 * word_chars // greatest(n_words, 1), 1000) FROM f),
good AS (SELECT * FROM r WHERE NOT base_failed),
own AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(rate, 0.25) AS q1, quantile_disc(rate, 0.75) AS q3 FROM good GROUP BY lang, source, rule),
byl AS (SELECT lang, rule, count(*) AS n, quantile_disc(rate, 0.25) AS q1, quantile_disc(rate, 0.75) AS q3 FROM good GROUP BY lang, rule),
alls AS (SELECT rule, quantile_disc(rate, 0.25) AS q1, quantile_disc(rate, 0.75) AS q3 FROM good GROUP BY rule),
pick AS (
  SELECT o.lang, o.source, o.rule,
         CASE WHEN o.n >= 100 THEN o.q1 WHEN b.n >= 100 THEN b.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.n >= 100 THEN o.q3 WHEN b.n >= 100 THEN b.q3 ELSE a.q3 END AS q3
  FROM own o JOIN byl b ON o.lang IS NOT DISTINCT FROM b.lang AND o.rule = b.rule JOIN alls a ON o.rule = a.rule),
lim AS (
  SELECT *, q3 + greatest(6 * (q3 - q1), CASE rule WHEN 'symbol_rate' THEN 20 WHEN 'dup_line_rate' THEN 500 WHEN 'repeat_rate' THEN 400 ELSE 15 END) AS lim FROM pick),
v AS (
  SELECT r.doc_id, bool_or(r.rate > coalesce(l.lim, 1000)) AS over_it
  FROM r LEFT JOIN lim l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source AND r.rule = l.rule
  GROUP BY r.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over_it AS kept
FROM f JOIN v ON f.doc_id = v.doc_id
"""
