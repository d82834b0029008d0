"""World models: how a state follows from an action, and when it is terminal. States are arrays or structs; all are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.extract import boxed, last_number


def appended(state: Column, action: Column) -> Column:
    """The default world: a state is the actions so far."""
    return F.array_append(F.coalesce(state, F.array().cast("array<string>")), action)


def answered(state: Column, question: Column, answer: Column, confidence: Column) -> Column:
    """A sub-question with its voted answer and confidence, added to the results so far."""
    return F.array_append(state, F.struct(question.alias("sub_question"), answer.alias("sub_answer"), confidence.alias("confidence")))


def last(state: Column) -> Column:
    return F.when(F.size(state) > 0, F.element_at(state, -1))


def ends_by_phrase(state: Column, phrase: str) -> Column:
    """Whether the last element holds the phrase (Now we can answer; The answer is; [PLAN END]; ####)."""
    return F.coalesce(last(state).contains(phrase), F.lit(False))


def ends_by_suffix(state: Column, suffix: str) -> Column:
    return F.coalesce(last(state).endswith(suffix), F.lit(False))


def ends_by_steps(step: Column, max_steps: int) -> Column:
    return step >= max_steps


def ends_by_equality(state: Column, goal: Column) -> Column:
    return F.coalesce(last(state) == goal, F.lit(False))


def ends_by_few_new_words(question: Column, sub_question: Column, most: int = 1) -> Column:
    """Whether the sub-question has at most so many words that the question hasn't."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return F.size(F.array_except(words(sub_question), words(question))) <= most


def ends_by_line(state: Column, line: str = "return result") -> Column:
    return F.coalesce((F.trim(last(state)) == line) | (F.trim(last(state)) == ""), F.lit(False))


def ends_by_box(state: Column, more: Column) -> Column:
    """A boxed answer, and no step that comes after it."""
    return F.coalesce(boxed(last(state)).isNotNull() & ~more, F.lit(False))


def rewritten(state: Column, action: Column) -> Column:
    """Claims: the last state and action and the new body."""
    return F.struct(state["body"].alias("last_state"), action.alias("last_action"), action.alias("body"))


def buffered(steps: Column, now: Column, before: Column, buffer: Column, action: Column, result: Column) -> Column:
    """Two actions make a step: the first goes to the buffer, the second empties it and moves the last state on."""
    first = F.coalesce(buffer, F.lit("")) == ""
    return F.struct((steps + 1).alias("step"), F.when(first, before).otherwise(now).alias("last_state"), result.alias("state"), F.when(first, action).otherwise(F.lit("")).alias("buffer"))


# numbers that make 24


def numbers_left(line: Column) -> Column:
    """The numbers after `left:` in a proposal."""
    return F.transform(F.regexp_extract_all(F.substring_index(F.substring_index(line, "left:", -1), ")", 1), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def after_operation(numbers: Column, used: Column, result: Column) -> Column:
    """The numbers without one occurrence of each used one, and the result, sorted; null if one isn't there."""
    rest = F.aggregate(used, numbers, lambda a, u: F.when(F.array_position(a, u) > 0, F.concat(F.slice(a, F.lit(1), F.greatest(F.array_position(a, u).cast("int") - 1, F.lit(0))), F.slice(a, F.array_position(a, u).cast("int") + 1, F.size(a)))))
    return F.when(rest.isNotNull(), F.array_sort(F.array_append(rest, result)))


def proposals(text: Column) -> Column:
    """Lines that say what is left."""
    return F.filter(F.split(text, "\n"), lambda x: x.contains("left"))


# five by five crosswords


def row(board: Column, i: int) -> Column:
    return F.slice(board, i * 5 + 1, 5)


def column(board: Column, i: int) -> Column:
    return F.filter(board, lambda x, k: k % 5 == i)


def placed(board: Column, slot: Column, word: Column) -> Column:
    """The board with a five-letter word in a slot: h1..h5 rows, v1..v5 columns."""
    n = F.substring(slot, 2, 1).cast("int") - 1
    letter = lambda k: F.upper(F.substring(word, k + 1, F.lit(1)))
    across = F.transform(board, lambda x, k: F.when(F.floor(k / 5) == n, letter(k % 5)).otherwise(x))
    down = F.transform(board, lambda x, k: F.when(k % 5 == n, letter(F.floor(k / 5).cast("int"))).otherwise(x))
    return F.when(F.substring(slot, 1, 1) == "h", across).otherwise(down)


def words_on(board: Column) -> Column:
    """The ten words, rows first."""
    return F.array(*[F.array_join(row(board, i), "") for i in range(5)], *[F.array_join(column(board, i), "") for i in range(5)])


def word_status(before: Column, now: Column) -> Column:
    """Of each word: 0 not filled, 1 filled, 2 changed from what was filled before."""
    return F.zip_with(before, now, lambda a, b: F.when(~a.contains("_") & (a != b), 2).when(~b.contains("_"), 1).otherwise(0))


def letters_right(board: Column, gold: Column) -> Column:
    return F.aggregate(F.zip_with(board, gold, lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda s, v: s + v) / 25


def words_right(board: Column, gold: Column) -> Column:
    return F.aggregate(F.zip_with(words_on(board), words_on(gold), lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda s, v: s + v) / 10


def candidates(text: Column) -> Column:
    """struct(slot, word, confidence) of lines like `h1. apple (sure)`; others are dropped. Confidence words are worth certain 1, high 0.5, medium 0.2, low 0.1."""
    pattern = r"^([hv][1-5])\. ([a-zA-Z]{5}) \((certain|high|medium|low)\).*$"
    worth = lambda c: F.when(c == "certain", 1.0).when(c == "high", 0.5).when(c == "medium", 0.2).otherwise(0.1)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("slot"), F.lower(F.regexp_extract(x, pattern, 2)).alias("word"), worth(F.regexp_extract(x, pattern, 3)).alias("confidence")))


def searchable(status: Column, depth: Column, max_depth: int) -> Column:
    """Whether search goes on from a board: no changed word, and not too deep."""
    return ~F.exists(status, lambda s: s == 2) & (depth < max_depth)


# tools


def tool_call(action: Column) -> Column:
    """struct(tool, argument) of `Name[argument]`, the name's first letter lower-cased; null if it isn't one."""
    a = F.concat(F.lower(F.substring(F.trim(action), 1, 1)), F.substr(F.trim(action), F.lit(2)))
    return F.when(a.rlike(r"^\w+\[.*\]"), F.struct(F.regexp_extract(a, r"^(\w+)\[", 1).alias("tool"), F.regexp_extract(a, r"^\w+\[(.*?)\]", 1).alias("argument")))


def calls_valid(code: Column, allowed: list[str]) -> Column:
    """At least one call, and all of them allowed."""
    names = F.regexp_extract_all(code, F.lit(r"(\w+)\("), F.lit(1))
    return (F.size(names) > 0) & F.forall(names, lambda n: n.isin(allowed))


def answer_of(state: Column) -> Column:
    """The last number of the last element."""
    return last_number(last(state))


# prompts


def rewritten_prompt(state: Column, prompt: Column) -> Column:
    """The state one prompt further: struct(prompt, depth)."""
    return F.struct(prompt.alias("prompt"), (state["depth"] + 1).alias("depth"))


def ends_by_score(depth: Column, score: Column, parent: Column, root: Column, best: Column, max_depth: int, min_depth: int) -> Column:
    """A prompt search stops at the depth limit; beyond the least depth also below the mean of parent and root, or above the best so far."""
    return (depth >= max_depth) | ((depth > min_depth) & F.coalesce((score < (parent + root) / 2) | (score > best), F.lit(False)))


def refined(state: Column, body: Column, confidence: Column) -> Column:
    """A refinement joins the array of struct(body, confidence) only if its confidence isn't below the last one's."""
    return F.when(F.coalesce(confidence >= F.element_at(state, -1)["confidence"], F.lit(True)), F.array_append(state, F.struct(body.alias("body"), confidence.alias("confidence")))).otherwise(state)


def ends_by_environment(terminated: Column, truncated: Column, step: Column, max_steps: int) -> Column:
    return F.coalesce(terminated, F.lit(False)) | F.coalesce(truncated, F.lit(False)) | (step >= max_steps)
