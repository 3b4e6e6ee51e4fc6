"""Scalar expression helpers that Spark lacks or spells differently; all are plain Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- two-valued logic and loose comparison (compat profile) ---


def eq2(a: Column, b: Column) -> Column:
    """``a = b`` that is false, not null, when a side is null."""
    return F.coalesce(a == b, F.lit(False))


def ne2(a: Column, b: Column) -> Column:
    """``a <> b`` that is true when a side is null."""
    return ~eq2(a, b)


def lt2(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def le2(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def in2(value: Column, *options: Column) -> Column:
    """IN with null equal to null."""
    return F.exists(F.array(*options), lambda x: x.eqNullSafe(value))


def loose_lt(a: Column, b: Column) -> Column:
    """``a < b`` for texts that compares numerically where both sides are numbers."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(x < y, a < b, F.lit(False))


def approx_eq(a: Column, b: Column, epsilon: float = 2.220446049250313e-16) -> Column:
    """Float equality within machine epsilon."""
    return F.coalesce(F.abs(a - b) < epsilon, F.lit(False))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; null on division by zero."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def mod_float(a: Column, b: Column) -> Column:
    """Remainder as a double; null on zero."""
    return F.try_mod(a.cast("double"), b.cast("double"))


# --- patterns ---


def like_plain(c: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_`` only: a backslash is an ordinary character."""
    return c.like(pattern.replace("\\", "\\\\"))


def glob_regex(pattern: str) -> str:
    """Whole-string regular expression of a glob with ``*`` and ``?``."""
    return "(?s)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"


def glob_match(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def match_ci(c: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(c), F.lower(needle))


# --- strings and types ---


def concat_null_text(*parts: Column) -> Column:
    """Concatenation that writes NULL as text (compat profile)."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts])


def char_codes(*codes: Column) -> Column:
    """Text of Unicode code points (Spark's ``char`` stops at 255)."""
    def one(n: Column) -> Column:
        high = F.lpad(F.hex(n.cast("long")), 8, "0")
        return F.decode(F.unhex(high), "UTF-32")

    return F.concat(*[F.when((c < 0) | (c > 0x10FFFF), F.lit("")).otherwise(one(c)) for c in codes])


def trim_chars(c: Column, chars: str, side: str = "both") -> Column:
    """Trim a set of characters from ``left``, ``right`` or ``both`` ends."""
    f = {"left": F.ltrim, "right": F.rtrim, "both": F.btrim}[side]
    return f(c, F.lit(chars))


def type_tag(type_name: str, c: Column) -> Column:
    """``null``, ``integer``, ``real``, ``text`` or ``array`` for a column of the given Spark type."""
    base = type_name.split("(")[0]
    tag = (
        "integer" if base in ("tinyint", "smallint", "int", "bigint", "boolean")
        else "real" if base in ("float", "double", "decimal")
        else "array" if base.startswith("array")
        else "text"
    )
    return F.when(c.isNull(), F.lit("null")).otherwise(F.lit(tag))


def round_half_away(c: Column, digits: int = 0) -> Column:
    """Rounding away from zero at halves, always a double."""
    return F.round(c.cast("double"), digits)


def loose_cast(c: Column, kind: str) -> Column:
    """CAST where an empty text is zero and a text that is no number is null."""
    text = F.trim(c.cast("string"))
    if kind in ("bigint", "long", "int"):
        return F.when(text == "", F.lit(0)).otherwise(F.coalesce(text.try_cast("bigint"), F.floor(text.try_cast("double")).try_cast("bigint"))).cast("bigint")
    if kind == "double":
        return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    if kind == "boolean":
        return F.when(text.try_cast("double").isNotNull(), text.try_cast("double") != 0).otherwise(F.lower(text).isin("true", "t", "yes"))
    return c.try_cast(kind)


# --- dates ---

#: Strftime and MySQL date codes with their Spark patterns.
_DATE_CODES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "i": "mm", "s": "ss", "y": "yy",
    "b": "MMM", "j": "DDD", "p": "a", "I": "hh", "h": "hh", "f": "SSSSSS", "e": "d", "c": "M",
}


def date_pattern(percent: str, mysql: bool = False) -> str:
    """Spark datetime pattern of a ``%`` format; other text is quoted."""
    out, literal, k = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while k < len(percent):
        ch = percent[k]
        if ch == "%" and k + 1 < len(percent):
            code = percent[k + 1]
            k += 2
            if code == "%":
                literal += "%"
            elif mysql and code == "M":
                flush()
                out.append("MMMM")
            elif code in _DATE_CODES:
                flush()
                out.append(_DATE_CODES[code])
            else:
                literal += "%" + code
            continue
        literal += ch
        k += 1
    flush()
    return "".join(out)


def date_format_percent(c: Column, percent: str, mysql: bool = False) -> Column:
    return F.date_format(c, date_pattern(percent, mysql))


_MODIFIER = re.compile(r"^\s*([+-]?\d+)\s*(second|minute|hour|day|week|month|year)s?\s*$", re.I)


def modifier_steps(modifiers: Sequence[str], calendar: bool = True) -> list[tuple[int, str]]:
    """Date modifiers as ``(number, unit)`` in seconds, minutes, hours, days, months, years, or ``(0, unit)`` to cut at its start.

    ``localtime`` and ``utc`` change nothing.  Without ``calendar`` a month is 30
    days and a year 365.  Any other text is an error.
    """
    out = []
    for text in modifiers:
        low = text.strip().lower()
        if low in ("localtime", "utc"):
            continue
        if low in ("start of day", "start of month", "start of year"):
            out.append((0, low[9:]))
            continue
        m = _MODIFIER.match(text)
        if not m:
            raise ValueError(f"unknown date modifier: {text!r}")
        n, unit = int(m[1]), m[2].lower()
        if unit == "week":
            n, unit = n * 7, "day"
        if not calendar and unit in ("month", "year"):
            n, unit = n * (30 if unit == "month" else 365), "day"
        if n:
            out.append((n, unit))
    return out


def shift(c: Column, *modifiers: str, calendar: bool = True) -> Column:
    """Apply modifiers such as ``+3 days``, ``-1 month`` or ``start of day`` to a timestamp; see ``modifier_steps``."""
    for n, unit in modifier_steps(modifiers, calendar):
        c = c + F.expr(f"INTERVAL '{n}' {unit.upper()}") if n else F.date_trunc(unit, c)
    return c


# --- arrays ---


def array_delete_at(c: Column, index: int) -> Column:
    """Array without its 0-based ``index``-th element."""
    return F.filter(c, lambda x, i: i != index)


def magnitude(c: Column) -> Column:
    """Euclidean length of a numeric array."""
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
