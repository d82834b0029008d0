"""The language-model boundary: one small interface, and a deterministic stand-in that needs no model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    """What a model offers to the engine, on columns: all rows of a job go through it at once."""

    def generate(self, prompts: DataFrame, prompt: str, n: int) -> DataFrame: ...

    def next_token_logits(self, prompt: Column, candidates: list[str]) -> Column: ...

    def log_likelihood(self, prefix: Column, content: Column) -> Column: ...


class HashModel:
    """Answers from seeded hashes of the prompt: repeatable, and of no meaning."""

    def __init__(self, seed: int = 0, vocabulary: tuple[str, ...] = ("yes", "no", "maybe", "The answer is 7.", "The answer is 12.")):
        self.seed, self.vocabulary = seed, vocabulary

    def generate(self, prompts: DataFrame, prompt: str, n: int = 1) -> DataFrame:
        """prompts with sample (from 0) and text, n rows each. Equal prompts are answered once and joined back."""
        asked = prompts.select(prompt).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        pick = F.pmod(F.xxhash64(F.lit(self.seed), prompt, "sample"), F.lit(len(self.vocabulary))).cast("int")
        return prompts.join(asked.withColumn("text", F.get(F.array(*map(F.lit, self.vocabulary)), pick)), prompt)

    def next_token_logits(self, prompt: Column, candidates: list[str]) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(self.seed), prompt, F.lit(c)), F.lit(1000)) / 100.0 for c in candidates])

    def log_likelihood(self, prefix: Column, content: Column) -> Column:
        return -(F.pmod(F.xxhash64(F.lit(self.seed), prefix, content), F.lit(1000)) + 1) / 100.0


def few_shot(pool: list[str], question: Column, n: int, prefix: str = "") -> Column:
    """The first n examples of the pool, then the question."""
    return F.concat(F.lit(prefix + "".join(pool[:n])), question)


def filled(template: str, **values: Column) -> Column:
    """The template with each <name> replaced."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), v)
    return out


def first_valid(samples: DataFrame, by: list[str], order: list[str], valid: Column, n: int) -> DataFrame:
    """The first n valid samples of each group: collecting until n are valid, as one pass over samples drawn in excess."""
    w = Window.partitionBy(*by).orderBy(*order)
    return samples.where(valid).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
