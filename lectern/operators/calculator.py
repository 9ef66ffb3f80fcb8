"""Arithmetic on numbers alone: + - * / ** %, signs and brackets, within bounds.

Expressions are read by binding powers, a token at a time, and worked out as they are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow

MOST_CHARS, MOST_EXPONENT, MOST_BITS, MOST_DEPTH = 500, 4096, 65_536, 90
_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<sign>\*\*|[-+*/%()]))")
#: Binding power to the left and to the right: a power binds tighter than a sign before it, and to the right first.
_BINDING = {"+": (1, 2), "-": (1, 2), "*": (3, 4), "/": (3, 4), "%": (3, 4), "**": (8, 7)}
_SIGNED = 6
Number = int | float


class Refused(ValueError):
    """An expression that isn't evaluated."""


def _raised(a: Number, b: Number) -> Number:
    if abs(b) > MOST_EXPONENT:
        raise Refused("exponent out of range")
    # Bits are counted before the power is taken.
    if isinstance(a, int) and isinstance(b, int) and b > 0 and a.bit_length() * b > MOST_BITS:
        raise Refused("too large")
    return a**b


_OPERATION: dict[str, Callable[[Number, Number], Number]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "**": _raised}


def _bounded(x: Number) -> Number:
    if isinstance(x, int):
        if x.bit_length() > MOST_BITS:
            raise Refused("too large")
    elif isinstance(x, complex) or not math.isfinite(x):
        raise Refused("not a finite real number")
    return x


def _tokens(expression: str) -> list[str]:
    found, at, end = [], 0, len(expression.rstrip())
    while at < end:
        m = _TOKEN.match(expression, at)
        if not m:
            raise Refused("only numbers and + - * / ** %")
        found.append(m["number"] or m["sign"])
        at = m.end()
    return found


class _Reader:
    def __init__(self, tokens: list[str]) -> None:
        self.left, self.depth = tokens[::-1], 0

    def operand(self) -> Number:
        token = self.left.pop() if self.left else ""
        if token in ("+", "-"):
            x = self.value(_SIGNED)
            return x if token == "+" else -x
        if token == "(":
            x = self.value(0)
            if not self.left or self.left.pop() != ")":
                raise Refused("not an expression")
            return x
        if not token or token in _BINDING or token == ")" or re.fullmatch(r"0\d*[1-9]\d*", token):
            raise Refused("not an expression")
        return _bounded(int(token) if token.isdigit() else float(token))

    def value(self, least: int) -> Number:
        """The value of what follows, up to an operator that binds less than least."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Refused("nested too deeply")
        x = self.operand()
        while self.left and self.left[-1] in _BINDING and _BINDING[self.left[-1]][0] >= least:
            sign = self.left.pop()
            x = _bounded(_OPERATION[sign](x, self.value(_BINDING[sign][1])))
        self.depth -= 1
        return x


def calculate(expression: str) -> Number:
    if len(expression) > MOST_CHARS:
        raise Refused("too long")
    reader = _Reader(_tokens(expression))
    try:
        found = reader.value(0)
    except ZeroDivisionError as e:
        raise Refused("division by zero") from e
    except OverflowError as e:
        raise Refused("too large") from e
    if reader.left:
        raise Refused("not an expression")
    return found


def told(expression: str | None) -> tuple[str | None, str | None]:
    """Result as text (whole numbers without a point) and, instead, why there is none."""
    try:
        v = calculate(expression or "")
    except Refused as e:
        return None, str(e)
    return str(int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v), None


def calculated(rows: DataFrame, column: str) -> DataFrame:
    """rows with result and refused."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [told(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], [*names, "result", "refused"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("result", T.StringType()), T.StructField("refused", T.StringType())]))
