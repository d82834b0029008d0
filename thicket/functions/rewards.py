"""Rewards of search steps, as Column functions over named parts."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from thicket.functions.extract import normalised
from thicket.functions.score import blended, geometric, planning, softmax

DEFAULT_CONFIDENCE = 0.8
#: What a verdict about the numbers left is worth; fixed values.
VERDICT_WORTH = {"sure": 1.0, "likely": 0.1, "impossible": 0.0001}


def nothing() -> Column:
    """The fast reward where none is defined."""
    return F.lit(0.0)


def usefulness(useful: Column, confidence: Column | None = None, alpha: float = 0.5) -> Column:
    """Usefulness and confidence, blended geometrically; before the step is taken a default confidence stands in."""
    return geometric(useful, F.lit(DEFAULT_CONFIDENCE) if confidence is None else confidence, alpha)


def decomposed(confidence: Column, alpha: float = 0.0) -> Column:
    """Decompose-then-solve: confidence alone counts, by 1 - alpha."""
    return F.pow(confidence, F.lit(1 - alpha))


def planned(intuition: Column, self_eval: Column, share_of_goals: Column, alpha: float = 0.5) -> Column:
    return planning(intuition, self_eval, share_of_goals, alpha)


def intuitive(intuition: Column, verdict: Column, share: float | None = None) -> Column:
    """Sum of the two, or their blend."""
    return intuition + verdict if share is None else blended(intuition, verdict, share)


def verdicts(outputs: Column, depth: Column, max_depth: int) -> Column:
    """Worth of sampled verdicts: the last word of each, summed by its worth; nothing beyond the depth."""
    worth = lambda x: F.coalesce(*[F.when(F.lower(F.element_at(F.split(F.trim(x), r"\s+"), -1)) == k, v) for k, v in VERDICT_WORTH.items()], F.lit(0.0))
    return F.when(depth > max_depth, 0.0).otherwise(F.aggregate(F.transform(outputs, worth), F.lit(0.0), lambda a, v: a + v))


def step_probability(log_probs: Column, lengths: Column, confidences: Column, alpha: float = 0.5) -> Column:
    """Length-normalised probability of a chain and product of its confidences, blended geometrically."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    p = F.exp(total(log_probs) / F.greatest(total(F.transform(lengths, lambda x: x.cast("double"))), F.lit(1.0)))
    c = F.aggregate(confidences, F.lit(1.0), lambda a, v: a * v)
    return geometric(p, c, alpha)


def discriminated(lm: Column, discriminator: Column, over: WindowSpec, beta: float = 0.1) -> Column:
    """Both scores as shares of their candidates, the discriminator by beta."""
    return blended(softmax(discriminator, over), softmax(lm, over), beta)


def process(log_likelihood: Column) -> Column:
    """Probability of the mark of a good step."""
    return F.exp(log_likelihood)


def rubric(scores: Column, total: bool = False) -> Column:
    """Mean (or sum) of a map of scores; 0 for none."""
    v = F.map_values(scores)
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(v) > 0, s if total else s / F.size(v)).otherwise(0.0)


def perfect(scores: Column, top: int = 5) -> Column:
    return F.forall(F.map_values(scores), lambda x: x == top)


def environment(self_eval: Column, env_reward: Column) -> Column:
    return self_eval + 100 * env_reward


def at_leaf(score: Column, depth: Column, leaf_depth: int) -> Column:
    """The critic's score at the leaves alone."""
    return F.when(depth == leaf_depth, score).otherwise(0.0)


def temperature(start: float, decay: float, depth: Column) -> Column:
    return start * F.pow(F.lit(decay), depth)


def logical(intuition: Column, yes: Column, no: Column) -> Column:
    """Half the intuition and half the share of yes in its log-odds against no."""
    return 0.5 * intuition + 0.5 * F.exp(yes) / (F.exp(yes) + F.exp(no))


def outcome(score: Column) -> Column:
    """An outcome model's score as it is; null counts as 0."""
    return F.coalesce(score, F.lit(0.0))


def chosen_step(steps: Column, score: str = "score") -> Column:
    """Of an array of structs the first of highest score; null for none."""
    best = F.array_max(F.transform(steps, lambda s: s[score]))
    return F.get(F.filter(steps, lambda s: s[score] == best), 0)


def label_reward(answer: Column, gold: Column) -> Column:
    """1 if the labels are equal in normal form, else 0."""
    return F.when(normalised(answer) == normalised(gold), 1.0).otherwise(0.0)
