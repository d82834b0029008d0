"""Planning with blocks: text states, legal actions, transitions and plan checks.

A state is the array of its facts; an action is one of: pick up X; put down X; stack X on top of Y; unstack X from on top of Y.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# How facts are written in state texts.
CLEAR, TABLE, ON, HOLDING, EMPTY = "the {} block is clear", "the {} block is on the table", "the {} block is on top of the {} block", "the hand is currently holding the {} block", "the hand is empty"
_ACTION = re.compile(r"(pick up|put down|unstack|stack) the (\w+) block(?: (?:from )?on top of the (\w+) block)?")


def effects(action: str) -> tuple[set[str], set[str], set[str]] | None:
    """(needs, deletes, adds) of an action; null if it isn't one."""
    m = _ACTION.fullmatch(action.strip().lower())
    if not m:
        return None
    what, x, y = m.groups()
    clear, table, hold = CLEAR.format(x), TABLE.format(x), HOLDING.format(x)
    if what == "pick up" and y is None:
        return {clear, table, EMPTY}, {clear, table, EMPTY}, {hold}
    if what == "put down" and y is None:
        return {hold}, {hold}, {clear, table, EMPTY}
    if y is None:
        return None
    on, under = ON.format(x, y), CLEAR.format(y)
    if what == "unstack":
        return {on, clear, EMPTY}, {on, clear, EMPTY}, {hold, under}
    return {hold, under}, {hold, under}, {clear, on, EMPTY}


def advanced(facts: list[str], action: str) -> list[str] | None:
    """The facts after the action, in order; null if it isn't an action or can't be done."""
    e = effects(action or "")
    state = {f.strip().lower() for f in facts if f}
    if e is None or not e[0] <= state:
        return None
    return sorted((state - e[1]) | e[2])


def legal(facts: list[str]) -> list[str]:
    """All actions that can be done, in order."""
    state = {f.strip().lower() for f in facts if f}
    blocks = sorted({b for f in state for b in re.findall(r"the (\w+) block", f)})
    names = [f"{v} the {b} block" for b in blocks for v in ("pick up", "put down")] + [t.format(a, b) for a in blocks for b in blocks if a != b for t in ("stack the {} block on top of the {} block", "unstack the {} block from on top of the {} block")]
    return sorted(n for n in names if effects(n)[0] <= state)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def states_of(start: pd.Series, plan: pd.Series) -> pd.Series:
    """The states that a plan goes through, the first included; it ends before the first action that can't be done."""

    def one(facts, actions) -> list:
        out = [sorted({f.strip().lower() for f in facts})] if facts is not None else []
        for a in actions if actions is not None and out else []:
            s = advanced(out[-1], a)
            if s is None:
                break
            out.append(s)
        return out

    return pd.Series([one(a, b) for a, b in zip(start, plan, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def legal_actions(facts: pd.Series) -> pd.Series:
    return pd.Series([legal(list(f)) if f is not None else [] for f in facts])


def plan_valid(start: Column, plan: Column, goals: Column) -> Column:
    """Whether every action of the plan can be done and the last state has all goals."""
    s = states_of(start, plan)
    done = F.size(s) == F.size(plan) + 1
    return F.coalesce(done & (F.size(F.array_except(goals, F.element_at(s, -1))) == 0), F.lit(False))


def facts(text: Column) -> Column:
    """The facts of a state text, split at commas and "and"."""
    return F.filter(F.transform(F.split(F.rtrim(F.lower(text), F.lit(".")), r",\s*(?:and )?|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


# problems in the planning domain language, as text

#: Names of the first objects, as texts call them; fixed values.
COLOURS = ["red", "blue", "orange", "yellow", "white", "magenta", "black", "cyan", "green", "violet", "silver", "gold"]


def _section(text: Column, name: str) -> Column:
    """What stands after `(:name` up to the next section."""
    return F.regexp_extract(text, rf"(?s)\(:{name}(.*?)(?:\(:|$)", 1)


def _named(symbol: Column) -> Column:
    """a is the first colour, b the second, and so on; other symbols stay."""
    k = F.ascii(symbol) - 97
    return F.when((F.length(symbol) == 1) & (k >= 0) & (k < len(COLOURS)), F.get(F.array(*map(F.lit, COLOURS)), k)).otherwise(symbol)


def _fact(words: Column) -> Column:
    """A fact of the language as a sentence; unknown ones stay as they are."""
    x, y = _named(F.get(words, 1)), _named(F.get(words, 2))
    kind = words[0]
    return (
        F.when(kind == "handempty", EMPTY)
        .when(kind == "clear", F.concat(F.lit("the "), x, F.lit(" block is clear")))
        .when(kind == "ontable", F.concat(F.lit("the "), x, F.lit(" block is on the table")))
        .when(kind == "holding", F.concat(F.lit("the hand is currently holding the "), x, F.lit(" block")))
        .when(kind == "on", F.concat(F.lit("the "), x, F.lit(" block is on top of the "), y, F.lit(" block")))
        .otherwise(F.array_join(words, " "))
    )


def problem(text: Column) -> Column:
    """struct(objects, init, goals) of a problem file: its objects, and the facts of its start and goal as sentences in order."""
    words = lambda t: F.split(F.trim(t), r"\s+")
    all_facts = lambda t: F.array_sort(F.transform(F.regexp_extract_all(t, F.lit(r"\(([a-z][^()]*)\)"), F.lit(1)), lambda f: _fact(words(f))))
    objects = F.filter(words(F.regexp_extract(_section(text, "objects"), r"([^()]*)", 1)), lambda o: o != "")
    return F.struct(objects.alias("objects"), all_facts(_section(text, "init")).alias("init"), all_facts(_section(text, "goal")).alias("goals"))


def sentence(facts: Column) -> Column:
    """Facts as one text: by commas, the last after "and"."""
    n = F.size(facts)
    head = F.array_join(F.slice(facts, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(facts, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(facts, -1)))


def statement(template: Column, parsed: Column) -> Column:
    """A problem template with <init> and <goals> filled in."""
    return F.replace(F.replace(template, F.lit("<init>"), sentence(parsed["init"])), F.lit("<goals>"), sentence(parsed["goals"]))


def grounded(plan: Column) -> Column:
    """The lines of a text plan in the planning language: `(pick-up a)`, `(stack a b)`; lines that are no action are left out."""
    letter = F.create_map(*[F.lit(v) for i, c in enumerate(COLOURS) for v in (c, chr(97 + i))])
    of = lambda line, k: F.coalesce(F.try_element_at(letter, F.get(F.regexp_extract_all(line, F.lit(r"the (\w+) block"), F.lit(1)), k)), F.get(F.regexp_extract_all(line, F.lit(r"the (\w+) block"), F.lit(1)), k))
    verb = lambda line: F.replace(F.regexp_extract(line, r"^\s*(pick up|put down|unstack|stack)\b", 1), F.lit(" "), F.lit("-"))
    lines = F.filter(F.split(F.lower(plan), "\n"), lambda x: verb(x) != "")
    return F.transform(lines, lambda x: F.concat(F.lit("("), F.concat_ws(" ", verb(x), of(x, 0), F.when(verb(x).endswith("stack"), of(x, 1))), F.lit(")")))
