"""The rule language: text to tokens to a tree to a Column.

    or := and ("or" and)* ; and := not ("and" not)* ; not := "not" not | comparison
    comparison := operand ("<" | "<=" | ">" | ">=" | "crosses_above" | "crosses_below") operand | "(" or ")"

Operands are numbers, price and volume words, session words, or slot.field.
There is neither arithmetic nor equality. A null on the left side of and/or
decides, as in `functions.logic`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ..functions import logic

PRICES = ("open", "high", "low", "close", "volume")
SESSION = (
    "minutes_since_open", "minutes_to_close", "minutes_since_rth_open", "minutes_to_rth_close", "is_rth", "is_overnight", "is_post_rth",
)
_TOKENS = re.compile(r"\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<op><=|>=|<|>|\(|\))|(?P<word>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<bad>\S))")
COMPARISONS = ("<", "<=", ">", ">=", "crosses_above", "crosses_below")


class RuleError(ValueError):
    """A rule that cannot be read, with the place."""


@dataclass(frozen=True)
class Expr:
    kind: str  # number, operand, compare, and, or, not
    value: object = None
    args: tuple[Expr, ...] = ()


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            break
        if m["bad"]:
            raise RuleError(f"unexpected {m['bad']!r} at {m.start('bad')}")
        out.append(m["num"] or m["op"] or m["word"])
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[str], known: set[str]):
        self.tokens, self.known, self.at = tokens, known, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise RuleError("the rule ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, word: str, lower) -> Expr:
        found = lower()
        while self.peek() == word:
            self.take()
            found = Expr(word, None, (found, lower()))
        return found

    def either(self) -> Expr:
        return self.chain("or", self.both)

    def both(self) -> Expr:
        return self.chain("and", self.negated)

    def negated(self) -> Expr:
        if self.peek() == "not":
            self.take()
            return Expr("not", None, (self.negated(),))
        if self.peek() == "(":
            self.take()
            inner = self.either()
            if self.take() != ")":
                raise RuleError("a parenthesis is not closed")
            return inner
        left = self.operand()
        op = self.take()
        if op not in COMPARISONS:
            raise RuleError(f"expected a comparison, not {op!r}")
        return Expr("compare", op, (left, self.operand()))

    def operand(self) -> Expr:
        word = self.take()
        if re.fullmatch(r"-?\d+(?:\.\d+)?", word):
            return Expr("number", float(word))
        if word in PRICES or word in SESSION or word in self.known:
            return Expr("operand", word)
        raise RuleError(f"unknown operand {word!r}")


def parse(text: str, known: set[str] = frozenset()) -> Expr:
    """The tree of a rule; `known` are the slot.field names."""
    parser = _Parser(tokenize(text), set(known))
    found = parser.either()
    if parser.peek() is not None:
        raise RuleError(f"unexpected {parser.peek()!r}")
    return found


def canonical(e: Expr) -> str:
    """One spelling for all texts of the same tree."""
    if e.kind == "number":
        return repr(e.value)
    if e.kind == "operand":
        return str(e.value)
    if e.kind == "compare":
        return f"({canonical(e.args[0])} {e.value} {canonical(e.args[1])})"
    if e.kind == "not":
        return f"(not {canonical(e.args[0])})"
    return f"({canonical(e.args[0])} {e.kind} {canonical(e.args[1])})"


def has_cross(e: Expr) -> bool:
    return (e.kind == "compare" and str(e.value).startswith("crosses")) or any(map(has_cross, e.args))


def operands(e: Expr) -> set[str]:
    """All words that a rule reads."""
    return {str(e.value)} if e.kind == "operand" else set().union(*map(operands, e.args))


def evaluate(e: Expr, values: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(known, value) of a rule over arrays whose first axis is time; not-a-number is null, and a cross looks one row back."""
    if e.kind == "compare":
        a, b = (np.full((1, 1), x.value) if x.kind == "number" else values[str(x.value)] for x in e.args)
        a, b = np.broadcast_arrays(a, b)
        if str(e.value).startswith("crosses") and len(a) == 1:  # two numbers never cross
            shape = next(iter(values.values())).shape[0], 1
            return np.ones(shape, bool), np.zeros(shape, bool)
        known = ~(np.isnan(a) | np.isnan(b))
        with np.errstate(invalid="ignore"):
            if not str(e.value).startswith("crosses"):
                return known, {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[str(e.value)]
            up = e.value == "crosses_above"
            now, was = (a > b, a <= b) if up else (a < b, a >= b)
        out, sure = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
        out[1:] = was[:-1] & now[1:]
        # As in SQL, one side that is false decides even if the other is null.
        sure[1:] = (known[:-1] & known[1:]) | (known[:-1] & ~was[:-1]) | (known[1:] & ~now[1:])
        return sure, out & sure
    known, value = evaluate(e.args[0], values)
    if e.kind == "not":
        return known, known & ~value
    also, other = evaluate(e.args[1], values)
    decided = known & (~value if e.kind == "and" else value)
    return known & (decided | also), np.where(decided, value, other)


def compile_rule(e: Expr, columns: dict[str, Column], over: WindowSpec) -> Column:
    """A nullable boolean column; prices are signal prices in points."""
    if e.kind == "number":
        return F.lit(e.value)
    if e.kind == "operand":
        return columns.get(e.value, F.col(str(e.value)))
    args = [compile_rule(a, columns, over) for a in e.args]
    if e.kind == "compare":
        if str(e.value).startswith("crosses"):
            return logic.crosses(args[0], args[1], over, e.value == "crosses_above")
        return logic.compare(args[0], e.value, args[1])
    if e.kind == "not":
        return ~args[0]
    return (logic.strict_and if e.kind == "and" else logic.strict_or)(*args)
