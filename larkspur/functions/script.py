"""The embedded expression language: one parser, two evaluators.

``column`` compiles an expression over named variables to a Spark Column, which
Catalyst optimises and generates code for; ``evaluate`` runs it on Python values
(for expressions that stand in a data column, through Arrow batches).

Grammar, loosest first: ``||``; ``&&``; comparisons; binary commands (``a min
b``, right-associative); ``+ -``; ``* / %``; prefix ``- !`` and unary commands.
Trigonometry is in radians.  A word without a leading underscore that is no
known command acts on a host program only: with operands it gives the first one,
alone it is null (a named variable comes before that).
"""

from __future__ import annotations

import math
import random as _random
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.ship import ship

_LEX = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"((?:[^"]|"")*)"|'((?:[^']|'')*)'|([A-Za-z_]\w*)|(\|\||&&|==|!=|>=|<=|[-+*/%^<>!(),\[\]]))""")


class ScriptError(ValueError):
    """The expression cannot be read or applied."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    value: object = None


_NULAR = {"pi", "true", "false", "nil", "random"}
_UNARY = {
    "sqrt", "sin", "cos", "tan", "abs", "exp", "ln", "log", "log10", "asin", "acos", "atan", "deg", "rad", "cosec", "sec", "cot",
    "round", "floor", "ceil", "trunc", "sign", "str", "toupper", "tolower", "typename", "count", "parsenumber", "trim", "isnil", "vectormagnitude", "hint",
}
_BINARY = {"min", "max", "atan2", "clamp", "select", "in", "find", "pushback", "deleteat", "isequalto", "replace", "and", "or", "mod"}


def parse(text: str) -> Node:
    tokens: list[tuple[str, object]] = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ScriptError(f"cannot read expression at: {text[at : at + 20]!r}")
        at = m.end()
        number, double, single, word, op = m.groups()
        if number is not None:
            tokens.append(("lit", float(number)))
        elif double is not None or single is not None:
            tokens.append(("lit", double.replace('""', '"') if double is not None else single.replace("''", "'")))
        elif word:
            tokens.append(("word", word))
        else:
            tokens.append(("op", op))
    pos = 0

    def peek() -> tuple[str, object]:
        return tokens[pos] if pos < len(tokens) else ("end", None)

    def take(op: str | None = None) -> object:
        nonlocal pos
        kind, value = peek()
        if op is not None and value != op:
            raise ScriptError(f"expected {op}, found {value}")
        pos += 1
        return value

    def left(level: Callable[[], Node], ops: tuple[str, ...]) -> Node:
        node = level()
        while (peek()[0] == "op" and peek()[1] in ops) or (peek()[0] == "word" and str(peek()[1]).lower() in ops):
            node = Node(str(take()).lower(), (node, level()))
        return node

    def disjunction() -> Node:
        return left(conjunction, ("||", "or"))

    def conjunction() -> Node:
        return left(comparison, ("&&", "and"))

    def comparison() -> Node:
        return left(command, ("==", "!=", ">=", "<=", ">", "<"))

    def command() -> Node:
        node = addition()
        kind, value = peek()
        if kind == "word" and str(value).lower() in _BINARY - {"and", "or", "mod"}:
            take()
            return Node(str(value).lower(), (node, command()))
        if kind == "word" and foreign(str(value)):
            take()
            return Node("host", (node, command()))
        return node

    def addition() -> Node:
        return left(product, ("+", "-"))

    def product() -> Node:
        return left(prefix, ("*", "/", "%", "mod"))

    def foreign(word: str) -> bool:
        return not word.startswith("_") and word.lower() not in _NULAR | _UNARY | _BINARY

    def prefix() -> Node:
        kind, value = peek()
        after = tokens[pos + 1] if pos + 1 < len(tokens) else ("end", None)
        operand = after[0] == "lit" or (after[0] == "op" and after[1] in ("(", "[")) or (after[0] == "word" and str(after[1]).lower() not in _BINARY)
        if kind == "word" and foreign(str(value)) and operand:
            take()
            return Node("host", (prefix(),))
        if kind == "op" and value in ("-", "!", "+"):
            take()
            return Node({"-": "neg", "!": "not", "+": "plus"}[str(value)], (prefix(),))
        if kind == "word" and str(value).lower() in _UNARY:
            take()
            return Node(str(value).lower(), (prefix(),))
        return power()

    def power() -> Node:
        node = primary()
        if peek() == ("op", "^"):
            take()
            return Node("^", (node, prefix()))
        return node

    def primary() -> Node:
        kind, value = peek()
        if kind == "lit":
            take()
            return Node("lit", value=value)
        if value == "(":
            take()
            node = disjunction()
            take(")")
            return node
        if value == "[":
            take()
            items = []
            while peek()[1] != "]" or peek()[0] != "op":
                items.append(disjunction())
                if peek()[1] == ",":
                    take()
            take("]")
            return Node("array", tuple(items))
        if kind == "word":
            take()
            low = str(value).lower()
            if low in _NULAR:
                return Node(low)
            return Node("var", value=str(value))
        raise ScriptError(f"unexpected {value!r}")

    node = disjunction()
    if pos != len(tokens):
        raise ScriptError(f"unexpected {peek()[1]!r}")
    return node


_MATH = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs, "exp": F.exp, "ln": F.ln, "log": F.log10, "log10": F.log10,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "deg": F.degrees, "rad": F.radians, "cosec": F.csc, "sec": F.sec, "cot": F.cot,
    "floor": F.floor, "ceil": F.ceil, "sign": F.signum,
}


def column(expression: str | Node, variables: Mapping[str, Column]) -> Column:
    """Spark Column of an expression; an unknown variable is null."""
    node = parse(expression) if isinstance(expression, str) else expression
    named = {k.lower(): v for k, v in variables.items()}

    def go(n: Node) -> Column:
        a = [go(x) for x in n.args]
        match n.op:
            case "lit":
                return F.lit(n.value)
            case "var":
                return named.get(n.value.lower(), F.lit(None))
            case "pi":
                return F.pi()
            case "true" | "false":
                return F.lit(n.op == "true")
            case "nil":
                return F.lit(None)
            case "random":
                return F.rand()
            case "array":
                return F.array(*a)
            case "+":
                return a[0] + a[1]
            case "-":
                return a[0] - a[1]
            case "*":
                return a[0] * a[1]
            case "/":
                return F.try_divide(a[0], a[1])
            case "%" | "mod":
                return F.try_mod(a[0].cast("double"), a[1].cast("double"))
            case "^":
                return F.pow(a[0], a[1])
            case "neg":
                return -a[0]
            case "plus":
                return a[0]
            case "not":
                return ~a[0]
            case "||" | "or":
                return a[0] | a[1]
            case "&&" | "and":
                return a[0] & a[1]
            case "==":
                return a[0] == a[1]
            case "!=":
                return a[0] != a[1]
            case "<":
                return a[0] < a[1]
            case "<=":
                return a[0] <= a[1]
            case ">":
                return a[0] > a[1]
            case ">=":
                return a[0] >= a[1]
            case "round":
                return F.round(a[0].cast("double"))
            case "trunc":
                return F.when(a[0] < 0, F.ceil(a[0])).otherwise(F.floor(a[0]))
            case "min":
                return F.least(a[0], a[1])
            case "max":
                return F.greatest(a[0], a[1])
            case "atan2":
                return F.atan2(a[0], a[1])
            case "clamp":
                return F.least(F.greatest(a[0], F.get(a[1], F.lit(0))), F.get(a[1], F.lit(1)))
            case "str":
                return a[0].cast("string")
            case "toupper":
                return F.upper(a[0])
            case "tolower":
                return F.lower(a[0])
            case "trim":
                return F.trim(a[0])
            case "typename":
                kind = F.typeof(a[0])
                scalar = F.when(kind == "string", "STRING").when(kind == "boolean", "BOOL").otherwise("SCALAR")
                return F.when(F.startswith(kind, F.lit("array")), "ARRAY").otherwise(scalar)
            case "count":
                return F.size(a[0]) if n.args[0].op == "array" else F.coalesce(F.length(a[0].cast("string"))) if n.args[0].op == "lit" else F.size(a[0])
            case "parsenumber":
                return F.coalesce(F.trim(a[0]).try_cast("double"), F.lit(0.0))
            case "isnil":
                return a[0].isNull()
            case "vectormagnitude":
                return F.sqrt(F.aggregate(a[0], F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
            case "select":
                return F.get(a[0], a[1].cast("int"))
            case "in":
                return F.array_contains(a[1], a[0])
            case "find":
                return (F.instr(a[0], str(n.args[1].value)) if n.args[1].op == "lit" else F.locate(a[1], a[0])) - 1
            case "replace":
                return F.replace(a[0], F.get(a[1], F.lit(0)), F.get(a[1], F.lit(1)))
            case "pushback":
                return F.array_append(a[0], a[1])
            case "deleteat":
                return F.filter(a[0], lambda x, i: i != a[1].cast("int"))
            case "isequalto":
                return a[0].eqNullSafe(a[1])
            case "host" | "hint":
                return a[0]
            case op if op in _MATH:
                return _MATH[op](a[0])
        raise ScriptError(f"unknown command {n.op}")

    return go(node)


def evaluate(expression: str | Node, variables: Mapping[str, object] | None = None) -> object:
    """Python value of an expression; an error or an unknown variable gives None."""
    node = parse(expression) if isinstance(expression, str) else expression
    named = {k.lower(): v for k, v in (variables or {}).items()}
    half = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    unary: dict[str, Callable] = {
        "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "abs": abs, "exp": math.exp, "ln": math.log, "log": math.log10, "log10": math.log10,
        "asin": math.asin, "acos": math.acos, "atan": math.atan, "deg": math.degrees, "rad": math.radians, "cosec": lambda x: 1 / math.sin(x), "sec": lambda x: 1 / math.cos(x),
        "cot": lambda x: 1 / math.tan(x), "round": half, "floor": math.floor, "ceil": math.ceil, "trunc": math.trunc, "sign": lambda x: (x > 0) - (x < 0),
        "str": str, "toupper": str.upper, "tolower": str.lower, "trim": str.strip, "count": len, "isnil": lambda x: x is None, "neg": lambda x: -x, "plus": lambda x: x,
        "not": lambda x: not x, "vectormagnitude": lambda x: math.sqrt(sum(v * v for v in x)), "hint": lambda x: x, "host": lambda x: x,
        "typename": lambda x: "ARRAY" if isinstance(x, list) else "STRING" if isinstance(x, str) else "BOOL" if isinstance(x, bool) else "SCALAR",
        "parsenumber": lambda x: _number(x),
    }
    binary: dict[str, Callable] = {
        "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": math.fmod, "mod": math.fmod, "^": lambda x, y: x**y,
        "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
        "||": lambda x, y: bool(x or y), "or": lambda x, y: bool(x or y), "&&": lambda x, y: bool(x and y), "and": lambda x, y: bool(x and y),
        "min": min, "max": max, "atan2": math.atan2, "clamp": lambda x, y: min(max(x, y[0]), y[1]), "select": lambda x, y: x[int(y)], "in": lambda x, y: x in y,
        "find": lambda x, y: x.find(y) if isinstance(x, str) else (x.index(y) if y in x else -1), "pushback": lambda x, y: [*x, y],
        "deleteat": lambda x, y: [v for i, v in enumerate(x) if i != int(y)], "isequalto": lambda x, y: x == y, "host": lambda x, y: x, "replace": lambda x, y: x.replace(y[0], y[1]),
    }

    def go(n: Node) -> object:
        match n.op:
            case "lit":
                return n.value
            case "var":
                return named.get(n.value.lower())
            case "pi":
                return math.pi
            case "true" | "false":
                return n.op == "true"
            case "nil":
                return None
            case "random":
                return _random.random()
            case "array":
                return [go(x) for x in n.args]
        values = [go(x) for x in n.args]
        return (unary if len(values) == 1 else binary)[n.op](*values)

    try:
        return go(node)
    except (ArithmeticError, TypeError, ValueError, IndexError, KeyError, AttributeError):
        return None


def _number(x: object) -> float:
    try:
        return float(str(x).strip())
    except ValueError:
        return 0.0


def evaluator():
    """The vectorised function behind ``evaluate_column``, to be called or registered."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, object] = {}

        def one(t: object) -> str | None:
            if t is None:
                return None
            if t not in known:
                try:
                    v = evaluate(str(t))
                except (ScriptError, RecursionError):
                    v = None
                known[t] = None if v is None else (str(v).lower() if isinstance(v, bool) else str(v))
            return known[t]

        return s.map(one)

    return run


def evaluate_column(expression: Column) -> Column:
    """Evaluate expressions that stand in a text column; results as text, null where they fail."""
    if session := SparkSession.getActiveSession():
        ship(session)
    return evaluator()(expression)
