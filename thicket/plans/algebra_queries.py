"""Mathematics answers that need algebra: pairs made from the rows' numbers, which SQL decides by comparing coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import judge
from thicket.plans.tables import read

QUERIES, ORACLES = {}, {}

#: Small numbers of a row.
NUMBERS = """SELECT doc_id, CAST(n_chars % 4 + 1 AS INT) AS a, CAST(doc_id % 3 + 1 AS INT) AS b, CAST(floor(n_chars / 7) % 4 + 1 AS INT) AS c,
  CAST(floor(n_chars / 11) % 3 + 1 AS INT) AS d, CAST(floor(n_chars / 17) % 18 AS INT) AS e, chr(92) AS s FROM {documents}"""
#: (form, answer, gold, when they are equal) in SQL that both engines read.
FORMS = [
    ("product", "'(' || a || 'x+' || b || ')(' || c || 'x+' || d || ')'", "(a * c) || 'x^2+' || e || 'x+' || (b * d)", "e = a * d + b * c"),
    ("surd", "s || 'frac{' || a || '}{' || s || 'sqrt{' || b || '}}'", "s || 'frac{' || c || s || 'sqrt{' || b || '}}{' || d || '}'", "a * d = b * c"),
    ("roots", "s || 'sqrt{' || (2 * a) || '}' || s || 'sqrt{' || (2 * b) || '}'", "c || s || 'sqrt{' || d || '}'", "4 * a * b = c * c * d"),
    ("power", "'2^{x+' || d || '}'", "e || ' ' || s || 'cdot 2^x'", "e = CASE d WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END"),
    ("quotient", "s || 'frac{x^2-' || (a * a) || '}{x-' || b || '}'", "'x+' || c", "a = b AND a = c"),
    ("nested", "s || 'sqrt{' || (a + b) || '+2' || s || 'sqrt{' || (a * b) || '}}'", "s || 'sqrt{' || a || '}+' || s || 'sqrt{' || c || '}'", "b = c"),
    ("equation", "'y=' || a || 'x+' || b", "c || 'x-y+' || d || '=0'", "a = c AND b = d"),
    ("sum", "s || 'frac{' || a || '}{n}+' || s || 'frac{' || b || '}{m}'", "s || 'frac{' || c || 'm+' || d || 'n}{mn}'", "a = c AND b = d"),
    ("matrix", "s || 'begin{pmatrix}' || a || '&' || b || s || s || '1&0' || s || 'end{pmatrix}'", "s || 'begin{bmatrix}' || c || ' & ' || d || s || s || '1 & 0' || s || 'end{bmatrix}'", "a = c AND b = d"),
    ("quantity", "a || CASE b WHEN 1 THEN ' km/h' WHEN 2 THEN ' square feet' ELSE ' red apples' END", "'' || c", "a = c"),
    ("tuple", "'(' || a || ', ' || s || 'frac{' || b || '}{2})'", "'(' || c || ',' || (0.5 * d) || ')'", "a = c AND b = d"),
]
PAIRS = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS form, {answer} AS answer, {gold} AS gold, {sure} AS sure FROM n" for name, answer, gold, sure in FORMS)


def maths_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's answer and gold in each form, and whether they are equal."""
    n = spark.sql(NUMBERS, documents=read(spark, sf_dir, "documents"))
    d = spark.sql(PAIRS.replace("{", "{{").replace("}", "}}").replace("FROM n", "FROM {n}"), n=n).drop("sure")
    return d.withColumn("equal", judge.maths_equal(F.col("answer"), F.col("gold"), percent=False, symbolic=True))


QUERIES["maths_identities"] = maths_identities
ORACLES["maths_identities"] = f"WITH n AS ({NUMBERS.format(documents='documents')}) SELECT doc_id, form, answer, gold, sure AS equal FROM ({PAIRS})"
