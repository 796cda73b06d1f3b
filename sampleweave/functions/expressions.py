"""A small expression language (numbers, names, + - * / % ^, comparisons, and/or/not, if(c, a, b), c ? a : b, functions) over columns or numpy arrays.

It is parsed here, never evaluated as Python, and becomes one Catalyst expression.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from sampleweave.functions.scalars import divided

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(:=|<=|>=|==|!=|<>|[-+*/%^()<>=?:,;&|!]))")
CONSTANTS = {"pi": math.pi, "epsilon": 1e-10, "inf": math.inf}
#: For columns and for numpy: functions of one argument, and of two or more.
COLUMNS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "log": F.log, "log10": F.log10, "log2": F.log2, "sqrt": F.sqrt, "abs": F.abs, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": F.round, "sgn": F.signum, "frac": lambda x: x - F.signum(x) * F.floor(F.abs(x)), "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "min": F.least, "max": F.greatest, "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "clamp": lambda lo, x, hi: F.least(F.greatest(x, lo), hi)}
ARRAYS = {"sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "exp": np.exp, "log": np.log, "log10": np.log10, "log2": np.log2, "sqrt": np.sqrt, "abs": np.abs, "floor": np.floor, "ceil": np.ceil, "round": np.round, "sgn": np.sign, "frac": lambda x: x - np.trunc(x), "trunc": np.trunc, "min": np.minimum, "max": np.maximum, "pow": np.power, "atan2": np.arctan2, "hypot": np.hypot, "clamp": lambda lo, x, hi: np.minimum(np.maximum(x, lo), hi)}

BINARY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "|": operator.or_, "or": operator.or_, "&": operator.and_, "and": operator.and_, "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Parser:
    """Precedence climbing. build: "columns" or "arrays"."""

    LEVELS = [("or", "|"), ("and", "&"), ("==", "=", "!=", "<>", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]

    def __init__(self, text: str, names: dict[str, Any], build: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r} in expression")
            self.tokens.append(m.group(1) or m.group(2) or m.group(3))
            at = m.end()
        self.at, self.names, self.build = 0, names, build
        self.functions: dict[str, Callable] = COLUMNS if build == "columns" else ARRAYS

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if token is None or want is not None and token != want:
            raise ValueError(f"expected {want or 'more'}, got {token}")
        self.at += 1
        return token

    def whole(self) -> Any:
        out = self.choice()
        if self.peek() == ";":
            self.take()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()} in expression")
        return out

    def when(self, c: Any, a: Any, b: Any) -> Any:
        return F.when(c, a).otherwise(b) if self.build == "columns" else np.where(c, a, b)

    def choice(self) -> Any:
        c = self.level(0)
        if self.peek() != "?":
            return c
        self.take()
        a = self.choice()
        self.take(":")
        return self.when(c, a, self.choice())

    def level(self, k: int) -> Any:
        if k == len(self.LEVELS):
            return self.unary()
        out = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            out = self.applied(self.take(), out, self.level(k + 1))
        return out

    def applied(self, op: str, a: Any, b: Any) -> Any:
        if op == "/":
            return divided(a, b) if self.build == "columns" else np.where(b == 0, np.nan, a / np.where(b == 0, 1, b))
        if op == "%":
            return a % b if self.build == "columns" else np.fmod(a, b)
        return BINARY[op](a, b)

    def unary(self) -> Any:
        if self.peek() in ("-", "+", "not", "!"):
            return self.signed(self.take(), self.unary())
        base = self.atom()
        if self.peek() == "^":
            self.take()
            base = self.called("pow", [base, self.unary()])
        return base

    def signed(self, op: str, x: Any) -> Any:
        return -x if op == "-" else x if op == "+" else ~x

    def called(self, name: str, args: list[Any]) -> Any:
        return self.functions[name](*args)

    def named(self, name: str) -> Any:
        return self.names[name]

    def atom(self) -> Any:
        token = self.take()
        if token == "(":
            out = self.choice()
            self.take(")")
            return out
        if token[0].isdigit() or token[0] == ".":
            return self.number(float(token))
        if self.peek() == "(":
            self.take()
            args = [self.choice()]
            while self.peek() == ",":
                self.take()
                args.append(self.choice())
            self.take(")")
            if token == "if":
                return self.when(*args)
            if token not in self.functions:
                raise ValueError(f"unknown function {token}")
            return self.called(token, args)
        if token in self.names:
            return self.named(token)
        if token in CONSTANTS:
            return self.number(CONSTANTS[token])
        raise ValueError(f"unknown name {token}")

    def number(self, x: float) -> Any:
        return F.lit(x) if self.build == "columns" else np.float64(x)


def translated(text: str, names: dict[str, Any]) -> Any:
    """The expression over columns."""
    return Parser(text, names, "columns").whole()


def computed(text: str, names: dict[str, Any]) -> Any:
    """The expression over numbers or numpy arrays."""
    with np.errstate(all="ignore"):
        return Parser(text, {k: np.asarray(v, np.float64) for k, v in names.items()}, "arrays").whole()


class Later(Parser):
    """Builds a function of the names in place of a value, so that an expression is parsed once for many values."""

    def when(self, c: Any, a: Any, b: Any) -> Any:
        return lambda n: a(n) if c(n) else b(n)

    def applied(self, op: str, a: Any, b: Any) -> Any:
        if op == "/":
            return lambda n: np.nan if (d := b(n)) == 0 else a(n) / d
        if op == "%":
            return lambda n: np.fmod(a(n), b(n))
        f = BINARY[op]
        return lambda n: f(a(n), b(n))

    def signed(self, op: str, x: Any) -> Any:
        return (lambda n: -x(n)) if op == "-" else x if op == "+" else (lambda n: not x(n))

    def called(self, name: str, args: list[Any]) -> Any:
        f = self.functions[name]
        return lambda n: f(*(x(n) for x in args))

    def named(self, name: str) -> Any:
        return lambda n: n[name]

    def number(self, x: float) -> Any:
        return lambda n, x=np.float64(x): x


class Weights(Parser):
    """Builds (weight of x, weight of y, constant); an error for what is no weighted sum."""

    def when(self, c: Any, a: Any, b: Any) -> Any:
        raise TypeError("a choice")

    def applied(self, op: str, a: Any, b: Any) -> Any:
        if op in "+-":
            return a + b if op == "+" else a - b
        if op == "*" and not a[:2].any():
            return a[2] * b
        if op in "*/" and not b[:2].any() and (op == "*" or b[2]):
            return a * b[2] if op == "*" else a / b[2]
        raise TypeError(op)

    def signed(self, op: str, x: Any) -> Any:
        if op not in "+-":
            raise TypeError(op)
        return -x if op == "-" else x

    def called(self, name: str, args: list[Any]) -> Any:
        if any(x[:2].any() for x in args):
            raise TypeError(name)
        return np.array([0.0, 0.0, self.functions[name](*(x[2] for x in args))])

    def number(self, x: float) -> Any:
        return np.array([0.0, 0.0, x])


def parsed_once(text: str) -> Callable[[dict[str, Any]], Any]:
    """The expression as a function of its names (x, y, a, b, c)."""
    return Later(text, dict.fromkeys("xyabc"), "later").whole()


def weighted(text: str, constants: dict[str, float]) -> tuple[float, float, float] | None:
    """The weights of x and y and the constant of an expression that is their sum; None for any other."""
    names = {k: np.array([0.0, 0.0, v]) for k, v in constants.items()} | {"x": np.array([1.0, 0.0, 0.0]), "y": np.array([0.0, 1.0, 0.0])}
    try:
        with np.errstate(all="ignore"):
            found = Weights(text, names, "weights").whole()
    except TypeError:
        return None
    return tuple(float(v) for v in found) if np.isfinite(found).all() else None


def vector_program(text: str, values: np.ndarray, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> np.ndarray:
    """A program of assignments over whole vectors, such as 'vecOut := a * vecIn;'; vecOut is the result and has the length of vecIn."""
    names: dict[str, Any] = {"vecIn": values, "vecOut": np.zeros_like(values, np.float64), "a": a, "b": b, "c": c}
    for line in filter(str.strip, text.split(";")):
        name, sign, right = line.partition(":=")
        if not sign:
            raise ValueError(f"no assignment: {line.strip()}")
        names[name.strip()] = computed(right, names)
    out = np.broadcast_to(names["vecOut"], values.shape)
    return np.array(out, np.float64)


def names_in(text: str) -> set[str]:
    return {m.group(2) for m in TOKEN.finditer(text) if m.group(2)}
