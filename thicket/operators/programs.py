"""Reasoning programs that run step by step inside a row: each is a fold over its steps, with the model and the tools given as Column functions, so that all examples of a job run at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.extract import finished
from thicket.operators.worlds import tool_call

Say = Callable[[Column], Column]


def decomposed_then_solved(sub_questions: Column, answer: Say, head: Column | None = None) -> Column:
    """struct(history, answer): sub-questions asked in order, each with all questions and answers before it; the last answer is the answer, null without sub-questions."""
    start = F.struct((F.lit("") if head is None else head).alias("history"), F.lit(None).cast("string").alias("answer"))

    def ask(state: Column, question: Column) -> Column:
        asked = F.concat(state["history"], F.lit("Q: "), question, F.lit("\nA:"))
        said = F.transform(F.array(answer(asked)), lambda a: F.struct(F.concat(asked, F.lit(" "), a, F.lit("\n")).alias("history"), a.alias("answer")))
        return said[0]

    return F.aggregate(sub_questions, start, ask)


def acted(question: Column, policy: Callable[[Column, Column], Column], observe: Callable[[Column, Column], Column], max_steps: int = 8) -> Column:
    """struct(history, n, answer): thought, action and observation in turn until an action is Finish[answer], at most max_steps times (then the answer is null).

    policy(history, n): the action of step n, such as `Search[x]`. observe(tool, argument): what the tool gives; null reads as no result.
    """
    start = F.struct(F.concat(F.lit("Question: "), question, F.lit("\n")).alias("history"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("done"))

    def step(state: Column, n: Column) -> Column:
        def after(action: Column) -> Column:
            call, end = tool_call(action), finished(action)
            seen = F.when(end.isNotNull(), "done").otherwise(F.coalesce(observe(call["tool"], call["argument"]), F.lit("no result")))
            text = F.concat(state["history"], F.lit("Action "), n.cast("string"), F.lit(": "), action, F.lit("\nObservation "), n.cast("string"), F.lit(": "), seen, F.lit("\n"))
            return F.struct(text.alias("history"), n.cast("int").alias("n"), end.alias("answer"), end.isNotNull().alias("done"))

        return F.when(state["done"], state).otherwise(F.transform(F.array(policy(state["history"], n)), after)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), start, step, lambda s: F.struct(s["history"].alias("history"), s["n"].alias("n"), s["answer"].alias("answer")))


def agent_step(observation: Column, memory: Column, encode: Say, plan: Callable[[Column, Column], Column], act: Callable[[Column, Column], Column]) -> Column:
    """struct(state, plan, action, memory) of one step of an agent: the observation as a state, a plan for it, the action that carries it out, and the memory with both added."""
    state = encode(observation)
    return F.transform(F.array(F.struct(state.alias("state"), plan(state, memory).alias("plan"))), lambda s: F.struct(s["state"].alias("state"), s["plan"].alias("plan"), act(s["state"], s["plan"]).alias("action"), F.array_append(memory, F.concat(s["state"], F.lit(" -> "), s["plan"])).alias("memory")))[0]


def graded(chains: DataFrame, verdicts: str, label: str | None = None, wrong: str = "INCORRECT") -> DataFrame:
    """chains with score (share of the verdict texts without the mark; null for none) and, with a human label, agrees: whether a perfect score and the label say the same."""
    bad = F.size(F.filter(verdicts, lambda v: F.contains(v, F.lit(wrong))))
    out = chains.withColumn("score", F.when(F.size(verdicts) > 0, 1 - bad / F.size(verdicts)))
    return out if label is None else out.withColumn("agrees", (F.col("score") == 1) == F.col(label))


def as_result(found: DataFrame, algorithm: str, example: str = "example_id", path: str = "path_ids", score: str = "score") -> DataFrame:
    """(example_id, algorithm, path array<string>, score): what any search found, in one form."""
    return found.select(F.col(example).cast("string").alias("example_id"), F.lit(algorithm).alias("algorithm"), F.transform(path, lambda x: x.cast("string")).alias("path"), F.col(score).cast("double").alias("score"))
