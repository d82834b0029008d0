"""Prompts and histories as text, and small rewrites of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pooled(pool: Column, n: int, prefix: Column | None = None, sep: str = "") -> Column:
    """The first n examples of a pool array after a prefix."""
    text = F.array_join(F.slice(pool, 1, n), sep)
    return text if prefix is None else F.concat(prefix, text)


def shortened_plans(steps: Column, variants: int = 6) -> Column:
    """The plan, without its first two steps, without four, and so on."""
    return F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda k: F.slice(steps, k * 2 + 1, F.greatest(F.size(steps) - k * 2, F.lit(0))))


def capped_with_final(parts: Column, final: Column, most: int = 5) -> Column:
    """At most so many sub-questions, the final question once and last."""
    return F.array_append(F.array_remove(F.slice(parts, 1, most), final), final)


def claims(states: Column) -> Column:
    """Claims between the first two states and the last, one a line."""
    return F.array_join(F.slice(states, 2, F.greatest(F.size(states) - 2, F.lit(0))), "\n")


def plan_text(actions: Column) -> Column:
    return F.coalesce(F.array_join(actions, "\n"), F.lit(""))


def with_definitions(text: Column, chunks: Column) -> Column:
    """text with each chunk replaced by a name, and the names defined below; a fold over the chunks."""
    names = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), F.concat(F.lit("{{c"), i + 1, F.lit("}}")).alias("n")))
    body = F.aggregate(names, text, lambda t, x: F.replace(t, x["c"], x["n"]))
    return F.when(F.size(chunks) > 0, F.concat(body, F.lit("\n\nDefinitions:\n"), F.array_join(F.transform(names, lambda x: F.concat(x["n"], F.lit(": "), x["c"])), "\n"))).otherwise(text)


def truncated_lines(text: Column, static: str, max_run: int = 20, tail: int = 10) -> Column:
    """An observation without static lines beyond max_run in a row, and without lines `tail` or more past the last one that starts with a bracket."""
    lines = F.split(text, "\n")
    mark = F.transform(lines, lambda x, i: F.when(F.trim(x).startswith("["), i).otherwise(-1))
    run = F.aggregate(lines, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.when(F.trim(x).startswith(static), F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + 1).otherwise(0)))
    kept = F.filter(F.arrays_zip(lines.alias("x"), run.alias("r")), lambda z, i: (z["r"] <= max_run) & (i < F.greatest(F.array_max(mark), F.lit(0)) + tail))
    return F.array_join(F.transform(kept, lambda z: z["x"]), "\n")


def sentences(text: Column, keyword: Column | None = None, most: int = 5) -> Column:
    """The first sentences, or the first that hold a keyword."""
    s = F.transform(F.filter(F.split(text, r"\. "), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    return F.slice(s if keyword is None else F.filter(s, lambda x: F.lower(x).contains(F.lower(keyword))), 1, most)


def steps(text: Column, delimiter: str = r"\n") -> Column:
    return F.filter(F.transform(F.split(text, delimiter), lambda x: F.trim(x)), lambda x: x != "")


def question_line(text: Column) -> Column:
    return F.concat(F.lit("Q: "), F.trim(F.regexp_replace(text, r"\s+", " ")))


def computation(text: Column) -> Column:
    """What an open calculator mark asks for: after the last `<<`, before the equals sign, if it is arithmetic alone."""
    e = F.substring_index(F.substring_index(text, "<<", -1), "=", 1)
    return F.when(text.contains("<<") & e.rlike(r"^[0-9+\-*/(). ]+$"), e)


def indent(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\s*)", 1)


def progress(remaining: Column, height: Column) -> Column:
    """How far a page is scrolled, as a percentage."""
    return F.format_string("%.1f%%", 100 * (1 - F.try_divide(remaining, height)))


def stamped_name(name: Column) -> Column:
    """The time in a file name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd-HH-mm-ss"))


def thought_action(text: Column) -> Column:
    """struct(thought, action) of a reply with a fenced action, the closing fence added where it is missing; without a fence the reply is a message to send."""
    closed = F.when(F.size(F.split(text, "```")) % 2 == 0, F.concat(text, F.lit("```"))).otherwise(text)
    parts = F.split(closed, "```")
    return F.struct(F.trim(parts[0]).alias("thought"), F.when(F.size(parts) > 1, F.trim(F.get(parts, 1))).otherwise(F.concat(F.lit("send_msg_to_user('"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("')"))).alias("action"))


def step_block(n: Column, thought: Column, action: Column, observation: Column) -> Column:
    return F.format_string("Thought %d: %s\nAction %d: %s\nObservation %d: %s\n", n, thought, n, action, n, observation)


def identity(name: str, description: str, at: Column | None = None) -> Column:
    """The head of an agent's prompt, with the date and time if given."""
    head = F.lit(f"# Name:\n{name}\n\n# Description:\n{description}")
    return head if at is None else F.concat(head, F.lit("\n\n# Current Date and Time:\n"), F.date_format(at, "EEE, MMM d, yyyy HH:mm:ss"))


def stringified(answer: Column, kind: str) -> Column:
    """An answer as text: lists by comma, maps as key: value, booleans as yes and no, null as empty."""
    if kind == "list":
        return F.coalesce(F.array_join(answer, ", "), F.lit(""))
    if kind == "map":
        return F.coalesce(F.array_join(F.transform(F.map_entries(answer), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "), F.lit(""))
    if kind == "bool":
        return F.when(answer, "yes").when(~answer, "no").otherwise("")
    return F.coalesce(answer.cast("string"), F.lit(""))


def demonstration(question: Column, steps: Column, answer: Column, delimiter: str = " | ") -> Column:
    """A worked example: the question, its steps by the delimiter, and the answer."""
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), F.array_join(steps, delimiter), F.lit(" The answer is "), answer, F.lit("."))


def browsing_prompt(goal: Column, observation: Column, actions: Column, error: Column) -> Column:
    """The prompt of a browsing step: goal, page, what was done before and, if there is one, the last error."""
    trouble = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("\n# Error of the last action:\n"), error)).otherwise("")
    return F.concat(F.lit("# Goal:\n"), goal, F.lit("\n# Page:\n"), observation, F.lit("\n# Actions so far:\n"), F.array_join(actions, "\n"), trouble)


def prompts_along(trace: Column) -> Column:
    """The prompts of the states on a path."""
    return F.transform(trace, lambda s: s["prompt"])


def logic_example(facts: Column, query: Column, claims: Column, next_steps: Column) -> Column:
    """A few-shot example of claims that follow from facts, each with the claim that comes next."""
    pairs = F.transform(F.arrays_zip(claims.alias("c"), next_steps.alias("n")), lambda z, i: F.concat(F.lit("Claim "), (i + 1).cast("string"), F.lit(": "), z["c"], F.lit("\nNext "), (i + 1).cast("string"), F.lit(": "), z["n"]))
    return F.concat(F.lit("Facts: "), facts, F.lit("\nQuery: "), query, F.lit("\n"), F.array_join(pairs, "\n"))


def zipped_pool(first: Column, second: Column, seed: int, key: Column, n: int) -> Column:
    """n pairs of examples of like place from two pools, in an order drawn by seeded hash of the key and place."""
    pairs = F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda z, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), z.alias("z")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["z"])


def chosen_answer(of_tree: Column, of_state: Column, use_tree: bool) -> Column:
    """The answer that the tree's terminals agree on, or the terminal state's; the other one where it is null."""
    return F.coalesce(of_tree, of_state) if use_tree else F.coalesce(of_state, of_tree)
