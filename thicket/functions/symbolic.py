r"""Equality of expressions by identity testing: both are evaluated at seeded points modulo primes, where equal ones always agree and different ones almost never do.

An expression is parsed to a postfix list and evaluated at all points at once, in numpy, for each distinct text of an Arrow batch. A point is a prime p = 11 (mod 12), of which -1 is no square and every cube root is one number, and a value of each variable. Divisions are by inverses, so rational functions need no common form. The square root of a square is the one that is itself a square modulo p; these multiply as positive reals do, and variables are squares, so \sqrt{x^2} = x and \sqrt 2 \sqrt 8 = 4. An exponent is evaluated modulo p - 1, so 2^{x+1} = 2 2^x. Constants such as \pi and functions of an argument are numbers of their own that depend on the argument's value.

Points at which something isn't defined (a division by zero, the root of no square) don't count. With a root of a sum in it an expression may take either root, so what the points can't agree on is settled by real values at several positive points.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Points, how many of them must be defined, and the deepest nesting, longest text and largest exponent that are read.
POINTS, ENOUGH, NESTED, LONGEST, LARGEST = 48, 3, 60, 2000, 10**6
SMALL_PRIMES = (2, 3, 5, 7, 11, 13)
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "log", "ln", "exp")
REAL = {
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "cot": lambda x: 1 / math.tan(x), "sec": lambda x: 1 / math.cos(x), "csc": lambda x: 1 / math.sin(x),
    "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "log": math.log, "ln": math.log, "exp": math.exp,
}
CONSTANTS = {"\\pi": math.pi, "e": math.e}
_TOKEN = re.compile(r"\s+|(\d+(?:\.\d*)?|\.\d+)|(\\[a-zA-Z]+)|([a-zA-Z])|(.)", re.S)
_PLAIN = [("\\left", ""), ("\\right", ""), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/"), ("**", "^"), ("\\!", ""), ("\\,", " "), ("\\;", " "), ("\\ ", " "), ("−", "-"), ("π", "\\pi "), ("√", "\\sqrt ")]


def _prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide all numbers below 3 * 10^9."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def _primes(count: int) -> list[int]:
    """The largest primes below 2^31 that are 11 modulo 12 and of which the small primes are squares."""
    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if p % 12 == 11 and all(pow(q, (p - 1) // 2, p) == 1 for q in SMALL_PRIMES) and _prime(p):
            out.append(p)
        p -= 1
    return out


_POINTS = np.array(sorted(_primes(POINTS // 2) * 2), np.int64)


class Unreadable(ValueError):
    """The text isn't an expression that is read here."""


def parsed(text: str) -> list[tuple[str, object]]:
    """The postfix list of an expression: (num, (over, under)), (var, name), (const, name), (call, name), and (op, one of + - * / ^ neg sqrt root abs)."""
    if len(text) > LONGEST:
        raise Unreadable("too long")
    for a, b in _PLAIN:
        text = text.replace(a, b)
    tokens = [m.group() for m in _TOKEN.finditer(text) if m.group().strip()]
    out: list[tuple[str, object]] = []
    at = depth = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal at
        if at >= len(tokens) or (want and tokens[at] != want):
            raise Unreadable(f"{want or 'more'} expected")
        at += 1
        return tokens[at - 1]

    def inside(first: str, last: str) -> None:
        take(first)
        total()
        take(last)

    def argument(one_digit: bool = False) -> None:
        """What a command or an exponent takes: a group, or a sign and what it stands before, a letter, a command or a number."""
        nonlocal at
        t = peek()
        if t == "{":
            inside("{", "}")
        elif one_digit and t[:1].isdigit() and len(t) > 1 and "." not in t:  # of 12 a fraction takes the 1
            tokens[at] = t[1:]
            out.append(("num", (int(t[0]), 1)))
        elif t == "-":
            take()
            argument()
            out.append(("op", "neg"))
        else:
            atom()

    def atom() -> None:
        nonlocal depth
        depth += 1
        if depth > NESTED:
            raise Unreadable("too deep")
        t = take()
        if t[0].isdigit() or t[0] == ".":
            whole, _, rest = t.partition(".")
            out.append(("num", (int((whole or "0") + rest), 10 ** len(rest))))
        elif t in ("(", "[", "{", "\\{"):
            total()
            take({"(": ")", "[": "]", "{": "}", "\\{": "\\}"}[t])
        elif t == "|":
            total()
            take("|")
            out.append(("op", "abs"))
        elif t == "\\frac":
            argument(one_digit=True)
            argument(one_digit=True)
            out.append(("op", "/"))
        elif t == "\\sqrt" or t == "sqrt":
            if peek() == "[":
                take()
                total()
                take("]")
                argument()
                out.append(("op", "root"))
            else:
                argument()
                out.append(("op", "sqrt"))
        elif t.lstrip("\\") in FUNCTIONS and t[0] == "\\":
            power = None
            if peek() == "^":
                take()
                level = len(out)
                argument()
                power = out[level:]
                del out[level:]
            if peek() in ("(", "{", "["):
                atom()
            else:
                signed_product(of_function=True)
            out.append(("call", t[1:]))
            if power:
                out.extend([*power, ("op", "^")])
        elif t in CONSTANTS:
            out.append(("const", t))
        elif t[0].isalpha() or (t[0] == "\\" and t[1:].isalpha()):
            name = t
            if peek() == "_":
                take()
                begin = at
                level = len(out)
                argument()
                del out[level:]
                name += "_" + "".join(t for t in tokens[begin:at] if t not in "{}")
            out.append(("var", name))
        else:
            raise Unreadable(f"{t} isn't read")
        depth -= 1

    def factor() -> None:
        atom()
        while peek() in ("^", "!"):
            if take() == "!":
                raise Unreadable("factorials aren't read")
            argument()
            out.append(("op", "^"))

    def signed_product(of_function: bool = False) -> None:
        if peek() in ("-", "+"):
            minus = take() == "-"
            signed_product(of_function)
            if minus:
                out.append(("op", "neg"))
            return
        factor()
        while True:
            t = peek()
            if t in ("*", "/") and not of_function:
                take()
                minus = peek() == "-" and bool(take())
                factor()
                out.extend([("op", "neg")] if minus else [])
                out.append(("op", t))
            elif t and (t[0].isalnum() or t in ("(", "[", "{", "\\{") or (t[0] == "\\" and t[1:2].isalpha())) and not (of_function and (t in ("(", "[") or t.lstrip("\\") in FUNCTIONS)):
                factor()
                out.append(("op", "*"))
            else:
                return

    def total() -> None:
        signed_product()
        while peek() in ("+", "-"):
            t = take()
            signed_product()
            out.append(("op", t))

    total()
    if at < len(tokens):
        raise Unreadable(f"{tokens[at]} is left over")
    return out


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    """base ** exponent modulo p, place by place; exponents are from 0."""
    out, base, exponent = np.ones_like(base), base.copy(), exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1 == 1, out * base % p, out)
        base, exponent = base * base % p, exponent >> 1
    return out


@functools.lru_cache(4096)
def _seeded(name: str, argument: bytes) -> np.ndarray:
    a = np.frombuffer(argument, np.int64).tolist()
    x = [random.Random(f"{name} {v} {q} {i}").randrange(1, q) for i, (v, q) in enumerate(zip(a, _POINTS.tolist(), strict=True))]
    return np.array(x, np.int64) ** 2 % _POINTS


def _own(name: str, argument: np.ndarray) -> np.ndarray:
    """At each point a square that stands for a variable, a constant or a function's value: seeded by name and argument."""
    return _seeded(name, argument.tobytes())


@functools.lru_cache(4096)
def _number(over: int, under: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A fraction at the points, and as an exponent if it is whole."""
    at = np.array([over % q * pow(under, -1, q) % q for q in _POINTS.tolist()], np.int64)
    return at, np.array([over % (q - 1) for q in _POINTS.tolist()], np.int64) if under == 1 else None


def modular(postfix: list[tuple[str, object]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """(values at the points, where they are defined, whether a root's sign was a choice)."""
    p = _POINTS
    ok = np.ones(len(p), bool)
    chosen = False
    zero = np.zeros(len(p), np.int64)

    def inverse(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.array([pow(int(a), -1, int(m)) if math.gcd(int(a), int(m)) == 1 else 0 for a, m in zip(v, q, strict=True)], np.int64)

    # of each operand: its value modulo p, modulo p - 1 (as an exponent), its fraction where it is a number, whether it has a sum
    stack: list[tuple[np.ndarray, np.ndarray | None, tuple[int, int] | None, bool]] = []

    def root(v: np.ndarray, n: int) -> np.ndarray:
        """The n-th root that is a square where there is one; places without one are struck."""
        nonlocal ok
        while n % 2 == 0:
            ok = ok & ((v == 0) | (_power(v, (p - 1) // 2, p) == 1))
            v = _power(v, (p + 1) // 4, p)
            n //= 2
        if n > 1:
            one = np.array([math.gcd(n, int(q) - 1) == 1 for q in p])
            ok = ok & one
            v = _power(v, np.where(one, inverse(np.full(len(p), n), p - 1), 1), p)
        return v

    for kind, what in postfix:
        if kind == "num":
            over, under = what
            g = math.gcd(over, under)
            over, under = over // g, under // g
            stack.append((*_number(over, under), (over, under), False))
        elif kind in ("var", "const"):
            x = _own(str(what), zero)
            stack.append((x, x if kind == "var" else None, None, False))
        elif kind == "call":
            a, _, _, s = stack.pop()
            stack.append((_own(str(what), a), None, None, s))
        elif what in ("neg", "sqrt", "abs"):
            a, e, f, s = stack.pop()
            if what == "neg":
                stack.append(((p - a) % p, None if e is None else (p - 1 - e) % (p - 1), f and (-f[0], f[1]), s))
            else:
                chosen |= s or (what == "abs" and f is None)
                if what == "abs" and f is not None:
                    stack.append((a if f[0] >= 0 else (p - a) % p, None if e is None else e if f[0] >= 0 else (p - 1 - e) % (p - 1), (abs(f[0]), f[1]), s))
                else:
                    stack.append((root(a * a % p if what == "abs" else a, 2), None, None, s))
        else:
            (a, ea, fa, sa), (b, eb, fb, sb) = stack[-2:]
            del stack[-2:]
            number = fa is not None and fb is not None
            if what in ("+", "-"):
                sign = 1 if what == "+" else -1
                f = (fa[0] * fb[1] + sign * fb[0] * fa[1], fa[1] * fb[1]) if number else None
                stack.append(((a + sign * b) % p, None if ea is None or eb is None else (ea + sign * eb) % (p - 1), f, f is None))
            elif what == "*":
                f = (fa[0] * fb[0], fa[1] * fb[1]) if number else None
                stack.append((a * b % p, None if ea is None or eb is None else ea * eb % (p - 1), f, sa or sb))
            elif what == "/":
                ok = ok & (b != 0)
                f = (fa[0] * fb[1], fa[1] * fb[0]) if number and fb[0] else None
                if f and f[1] < 0:
                    f = (-f[0], -f[1])
                e = np.array([f[0] // f[1] % (int(q) - 1) for q in p], np.int64) if f and f[0] % f[1] == 0 else None
                stack.append((a * inverse(b, p) % p, e, f, sa or sb))
            elif what == "root":
                if fa is None or fa[1] != 1 or not 1 < fa[0] <= LARGEST:
                    raise Unreadable("roots are of whole numbers")
                chosen |= sb and fa[0] % 2 == 0
                stack.append((root(b, fa[0]), None, None, sb))
            else:  # ^
                if fb is not None:
                    g = math.gcd(*fb)
                    over, under = fb[0] // g, fb[1] // g
                    if abs(over) > LARGEST or under > LARGEST:
                        raise Unreadable("an exponent is too large")
                    chosen |= sa and under % 2 == 0
                    v = root(a, under)
                    if over < 0:
                        ok = ok & (v != 0)
                        v = inverse(v, p)
                    v = _power(v, np.full(len(p), abs(over)), p)
                    e = _power(ea, np.full(len(p), over), p - 1) if ea is not None and under == 1 and over >= 0 else None
                    f = (fa[0] ** over, fa[1] ** over) if fa is not None and under == 1 and 0 <= over <= 64 else None
                    stack.append((v, e, f, sa))
                elif eb is not None:
                    ok = ok & (a != 0)
                    stack.append((_power(a, eb, p), None, None, sa))
                else:
                    stack.append((_own("^", a << 31 | b), None, None, sa or sb))
    return stack[0][0], ok, chosen


def real(postfix: list[tuple[str, object]], seed: int) -> complex | None:
    """The value at a seeded point of positive reals; None where it isn't defined."""
    stack: list[complex] = []
    try:
        for kind, what in postfix:
            if kind == "num":
                stack.append(what[0] / what[1])
            elif kind == "var":
                stack.append(random.Random(f"{what} {seed}").uniform(0.5, 2.5))
            elif kind == "const":
                stack.append(CONSTANTS[str(what)])
            elif kind == "call":
                stack.append(REAL[str(what)](stack.pop().real))
            elif what in ("neg", "sqrt", "abs"):
                a = stack.pop()
                stack.append(-a if what == "neg" else abs(a) if what == "abs" else complex(a) ** 0.5)
            else:
                a, b = stack[-2:]
                del stack[-2:]
                if what == "root":
                    a, b = b, 1 / a
                    stack.append(-((-a) ** b) if isinstance(a, float) and a < 0 and round(1 / b) % 2 else complex(a) ** b)
                else:
                    stack.append(a + b if what == "+" else a - b if what == "-" else a * b if what == "*" else a / b if what == "/" else complex(a) ** b)
    except (ArithmeticError, ValueError):
        return None
    return complex(stack[0])


def _same(a: list, b: list) -> bool:
    x, ok_x, chosen_x = modular(a)
    y, ok_y, chosen_y = modular(b)
    ok = ok_x & ok_y
    if ok.sum() >= ENOUGH:
        agree = (x == y)[ok]
        if agree.all():
            return True
        if not chosen_x | chosen_y:
            return False
    pairs = [(real(a, k), real(b, k)) for k in range(4)]
    pairs = [(p, q) for p, q in pairs if p is not None and q is not None]
    return len(pairs) > 1 and all(abs(p - q) <= 1e-9 * max(abs(p), abs(q), 1e-9) for p, q in pairs)


def equal(a: str | None, b: str | None) -> bool:
    """Whether two expressions, or two equations, are equal wherever both are defined; equations are if the differences of their sides are equal up to sign. Texts that can't be read, and null, are equal to nothing."""
    if a is None or b is None:
        return False

    def sides(t: str) -> list:
        parts = t.split("=")
        if len(parts) > 2:
            raise Unreadable("several equals signs")
        return [parsed(s) for s in parts]

    try:
        x, y = sides(a), sides(b)
        if len(x) != len(y):
            return False
        if len(x) == 1:
            return _same(x[0], y[0])
        minus = [("op", "-")]
        x, y = x[0] + x[1] + minus, y[0] + y[1] + minus
        return _same(x, y) or _same(x, [*y, ("op", "neg")])
    except (Unreadable, RecursionError, OverflowError):
        return False


@F.pandas_udf(BooleanType())
def symbolic_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """equal() of each pair; a pair that comes several times in a batch is decided once. A degree-d difference of two expressions is 0 at a random point of a prime p with chance 2 d / p at most: at three points of two primes or more, for d up to 1000, that is one wrong "equal" in 10^11."""
    return pd.Series(_each(a, b), dtype="bool")


@F.pandas_udf(BooleanType())
def settled(known: pd.Series, a: pd.Series, b: pd.Series, form_a: pd.Series, form_b: pd.Series) -> pd.Series:
    """Where it isn't known already: whether two texts, or their normal forms, are equal()."""
    out = known.to_numpy(dtype=bool, na_value=False).copy()
    for x, y in ((a, b), (form_a, form_b)):
        open_ = ~out
        out[open_] = _each(x[open_], y[open_])
    return pd.Series(out)


def _each(a: pd.Series, b: pd.Series) -> list[bool]:
    told: dict[tuple, bool] = {}
    return [told[k] if (k := (x, y)) in told else told.setdefault(k, equal(x, y)) for x, y in zip(a, b, strict=True)]
