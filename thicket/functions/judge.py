"""Judges: whether an answer equals the gold one."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from thicket.functions.extract import normalised, spelled_number
from thicket.functions.maths import choice, fraction_value, matrix_rows, normal_form
from thicket.functions.symbolic import settled


def numeric_ladder(answer: Column, gold: Column) -> Column:
    """Equal as whole numbers, else as numbers, else as text; null answers are wrong."""
    return F.coalesce(answer.try_cast("bigint") == gold.try_cast("bigint"), answer.try_cast("double") == gold.try_cast("double"), answer == gold, F.lit(False))


def same_fold(answer: Column, gold: Column) -> Column:
    return F.coalesce(F.lower(answer) == F.lower(gold), F.lit(False))


def same(answer: Column, gold: Column) -> Column:
    return F.coalesce(answer == gold, F.lit(False))


def yes_no_is(answer: Column, gold: Column) -> Column:
    """yes or no against a boolean; null for any other answer."""
    a = F.lower(F.trim(answer))
    return F.when(a == "yes", gold).when(a == "no", ~gold)


def within(answer: Column, gold: Column, absolute: float = 1e-4, relative: float | None = None) -> Column:
    a, g = answer.try_cast("double"), gold.try_cast("double")
    bound = F.lit(absolute) if relative is None else relative * F.greatest(F.abs(a), F.abs(g))
    return F.coalesce(F.abs(a - g) <= bound, F.lit(False))


def exact_normalised(answer: Column, gold: Column) -> Column:
    return F.coalesce(normalised(answer) == normalised(gold), F.lit(False))


def maths_equal(answer: Column, gold: Column, percent: bool = True, symbolic: bool = False) -> Column:
    r"""Whether two mathematics answers are equal. Rungs, on the texts and on their normal forms: the same text; the choice letter gold asks for; the same number (a fraction of numbers is one), gold also taken as a hundredth or a hundredfold; the same text without brackets; the same tuple or matrix, place by place; the right side of an equation whose left side is a name. With symbolic, what is left is decided by identity testing (functions/symbolic.py), on the texts and on their normal forms; only those rows are looked at. Null answers are wrong."""
    close = lambda p, q: F.abs(p - q) <= 1e-4 * F.greatest(F.abs(p), F.abs(q))
    value = lambda c: F.coalesce(spelled_number(c), fraction_value(c))

    def number(a: Column, g: Column) -> Column:
        x, y = value(a), value(g)
        return close(x, y) | (close(x, y / 100) | close(x, y * 100) if percent else F.lit(False))

    def flat(a: Column, g: Column) -> Column:
        bare = lambda c: F.lower(F.translate(c, "()[]{} ", ""))
        return F.coalesce(number(a, g), F.lit(False)) | F.coalesce((bare(a) == bare(g)) & (bare(a) != ""), F.lit(False))

    def parts(x: Column, y: Column) -> Column:
        return F.coalesce((F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, flat), lambda v: v), F.lit(False))

    def rungs(a: Column, g: Column) -> Column:
        inside = lambda c: F.when(c.rlike(r"^[(\[].+,.+[)\]]$"), F.transform(F.split(F.substring(c, 2, F.length(c) - 2), ","), lambda x: F.trim(x)))
        rows, gold_rows = matrix_rows(a), matrix_rows(g)
        matrix = F.coalesce((F.size(rows) == F.size(gold_rows)) & F.forall(F.zip_with(rows, gold_rows, parts), lambda v: v), F.lit(False))
        return flat(a, g) | F.coalesce(parts(inside(a), inside(g)), F.lit(False)) | matrix

    a, g = F.trim(answer), F.trim(gold)
    right = lambda c: F.when(c.rlike(r"^[^=]{1,2}=[^=]+$"), F.trim(F.substring_index(c, "=", -1))).otherwise(c)
    same_text = F.coalesce(F.lower(a) == F.lower(g), F.lit(False))
    letter = g.isin("A", "B", "C", "D", "E") & (choice(a) == g)
    pairs = F.array(F.struct(right(a).alias("a"), right(g).alias("g")), F.struct(normal_form(a).alias("a"), normal_form(g).alias("g")))
    by_rule = same_text | F.coalesce(letter, F.lit(False)) | F.coalesce(F.exists(pairs, lambda p: rungs(p["a"], p["g"])), F.lit(False))
    if not symbolic:
        return by_rule
    plain = lambda c: F.translate(c, "$", "")
    return settled(by_rule, plain(a), plain(g), normal_form(a), normal_form(g))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(text: str | None) -> float | None:
    """The value of an expression of numbers, + - * / and brackets; null for anything else. Nothing is executed."""

    def of(n: ast.AST) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return float(n.value)
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](of(n.left), of(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](of(n.operand))
        raise ValueError("not arithmetic")

    try:
        return of(ast.parse((text or "").strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError):
        return None


@F.pandas_udf(DoubleType())
def calculated(text: pd.Series) -> pd.Series:
    """arithmetic() of each text."""
    return text.map(arithmetic).astype("float64")


def makes_target(puzzle: Column, equation: Column, target: int = 24) -> Column:
    """The equation's left side uses exactly the numbers of the puzzle and has the target as its value."""
    left = F.substring_index(equation, "=", 1)
    digits = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))
    return F.coalesce((digits(left) == digits(puzzle)) & (F.abs(calculated(left) - target) < 1e-6), F.lit(False))


def recalled(references: Column, text: Column) -> Column:
    """Share of the references that occur in the text as whole words, both normalised; null references don't count, none at all gives null."""
    there = F.filter(references, lambda r: r.isNotNull())
    padded = F.concat(F.lit(" "), normalised(text), F.lit(" "))
    hit = F.transform(there, lambda r: F.when(F.contains(padded, F.concat(F.lit(" "), normalised(r), F.lit(" "))), 1.0).otherwise(0.0))
    return F.when(F.size(there) > 0, F.aggregate(hit, F.lit(0.0), lambda a, v: a + v) / F.size(there))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements as often."""
    return F.coalesce(F.array_sort(a) == F.array_sort(b), F.lit(False))


def quasi_equal(answer: Column, gold: Column, unit: Column, relative: float = 0.03) -> Column:
    """Whether an answer is a gold number within a share of it, also when the gold unit holds a power of ten (`10^3 m`) that the answer has worked in; a unit without one changes nothing."""
    power = F.regexp_extract(F.coalesce(unit, F.lit("")), r"10\^\{?(-?[0-9]+)\}?", 1).try_cast("int")
    a, g = answer.try_cast("double"), gold.try_cast("double")
    close = lambda y: F.abs(a - y) <= relative * F.abs(y)
    return F.coalesce(close(g) | F.coalesce(close(g * F.pow(F.lit(10.0), power)), F.lit(False)), F.lit(False))
