"""Scores and rewards as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def softmax(x: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """Share of exp(x / temperature) in its group; the largest is subtracted first, so that nothing overflows."""
    e = F.exp((x - F.max(x).over(over)) / temperature)
    return e / F.sum(e).over(over)


def unbiased_softmax(x: Column, p: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """Softmax in which the drawing probabilities p are divided out, normalised to 1."""
    e = F.exp((x - F.max(x).over(over)) / temperature)
    raw = e / F.sum(e * p).over(over)
    return raw / F.sum(raw).over(over)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def uct(q: Column, parent_visits: Column, visits: Column, weight: float = 1.0) -> Column:
    """Upper confidence of a child: its value, and the more the less it has been visited."""
    return q + weight * F.sqrt(F.ln(parent_visits) / F.greatest(visits, F.lit(1)))


def geometric(useful: Column, confidence: Column, alpha: float = 0.5) -> Column:
    return F.pow(useful, F.lit(alpha)) * F.pow(confidence, F.lit(1 - alpha))


def planning(intuition: Column, self_eval: Column, goals_met: Column, alpha: float = 0.5) -> Column:
    """Blend of what the model says and the share of goals met; all met counts 100."""
    return (intuition + self_eval) * alpha + F.when(goals_met == 1, 100.0).otherwise(goals_met) * (1 - alpha)


def blended(first: Column, second: Column, share: float) -> Column:
    return share * first + (1 - share) * second


def shrunk_mean(rewards: Column) -> Column:
    """Sum over one more than the number."""
    return F.aggregate(rewards, F.lit(0.0), lambda a, v: a + v) / (F.size(rewards) + 1)


def aggregated(rewards: Column, how: str) -> Column:
    """A path's rewards in one: sum (cumulative, accumulative), mean (average), last, max."""
    total = F.aggregate(rewards, F.lit(0.0), lambda a, v: a + v)
    if how in ("sum", "cumulative", "accumulative"):
        return total
    if how in ("mean", "average"):
        return total / F.size(rewards)
    if how == "max":
        return F.array_max(rewards)
    if how.startswith("last"):
        return F.element_at(rewards, -1)
    raise ValueError(f"unknown aggregator {how}")


def goals_met(state: Column, goals: Column) -> Column:
    """struct(all, share) of the goals that the state's text names; null without goals."""
    hit = F.aggregate(F.transform(goals, lambda g: F.contains(state, g).cast("int")), F.lit(0), lambda a, v: a + v)
    return F.when(F.size(goals) > 0, F.struct((hit == F.size(goals)).alias("all"), (hit / F.size(goals)).alias("share")))


def critic(verdict: Column) -> Column:
    """success 1, on track a half, else 0."""
    return F.when(verdict == "success", 1.0).when(verdict == "on-track", 0.5).otherwise(0.0)


def sequence_probability(log_probs: Column) -> Column:
    return F.exp(F.aggregate(log_probs, F.lit(0.0), lambda a, v: a + v))
