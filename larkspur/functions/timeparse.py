"""Vectorised parsing of mixed timestamp text over Arrow arrays.

Texts of one batch are grouped by *shape* (every digit replaced by ``9``).  A
shape is compiled once into digit positions; all its rows are then read as a
byte matrix and parsed with array arithmetic, so the work per row does not
depend on how many formats are mixed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text longer than this, runs of blanks counted as one, names no instant: the longest form, with the longest zone
#: name and a fraction of 300 digits, stays below.
MAX_CHARS = 400
#: Runs of blanks are only looked for in texts longer than this.
SHORT = 80
_BLANKS = " \t\r\n\f\v "
#: English month names in calendar order.
_MONTHS = "january february march april may june july august september october november december".split()
#: Names that mean UTC on any server.
_UTC_NAMES = {"Z", "UTC", "GMT", "UT"}

_CLOCK = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_TAIL = r"[ ]*(?P<ap>[AaPp][Mm])?[ ]*(?:(?P<off>[+-]99(?::?99)?)|(?P<abbr>[A-Za-z]{1,6}))?[ ]*(?:\[(?P<zone>[A-Za-z0-9_+/-]+)\])?"
_FORMS = [
    re.compile(r"(?P<y>9999)([-/.])(?P<mo>99)\2(?P<d>99)(?:T|[ ]+)" + _CLOCK + _TAIL),
    re.compile(r"(?P<y>9999)(?P<mo>99)(?P<d>99)T(?P<h>99):?(?P<mi>99)(?::?(?P<s>99)(?:[.,](?P<f>9+))?)?" + _TAIL),
    re.compile(r"(?P<p1>9{1,2})(?P<sep>[/.])(?P<p2>9{1,2})(?P=sep)(?P<y>9999),?(?:T|[ ]+)" + _CLOCK + _TAIL),
    re.compile(r"(?:[A-Za-z]{3,9},?[ ]+)?(?P<d>9{1,2})[ -](?P<name>[A-Za-z]{3,9})\.?[ -](?P<y>9999),?[ ]+" + _CLOCK + _TAIL),
]
_EPOCH = re.compile(r"(?P<e>9{9,11}|9{13}|9{16}|9{19})")

RESULT = pa.struct([("base_us", pa.int64()), ("off_s", pa.int32()), ("place", pa.string())])


@lru_cache(maxsize=8192)
def _recipe(shape: str) -> tuple[str, re.Match] | None:
    if _EPOCH.fullmatch(shape):
        return "epoch", _EPOCH.fullmatch(shape)
    for form in _FORMS:
        if m := form.fullmatch(shape):
            name = m.groupdict().get("name")
            if name and not any(x == name.lower() or (len(name) <= 4 and x.startswith(name.lower()[:3])) for x in _MONTHS):
                return None
            return "clock", m
    return None


def _number(cells: np.ndarray, m: re.Match, group: str) -> np.ndarray:
    lo, hi = m.span(group)
    out = np.zeros(len(cells), np.int64)
    for k in range(lo, hi):
        out = out * 10 + (cells[:, k] - 48)
    return out


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    fine = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1)
    months = np.where(fine, (y - 1970) * 12 + mo - 1, 0).astype("datetime64[M]")
    first = months.astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, fine & (d <= length)


def parse(texts: pa.Array, month_first: pa.Array, dotted_too: pa.Array | None = None) -> pa.StructArray:
    """``base_us`` (microseconds on the text's own clock), ``off_s`` (its offset, null if not
    settled by the text) and ``place`` (abbreviation, or ``[zone]``) of every text; ``base_us`` is
    null where the text names no date-time.  Digits finer than a microsecond are cut.  Dates in
    figures with ``/`` are month-first where ``month_first`` says so, with ``.`` only if ``dotted_too``
    does as well.
    """
    n = len(texts)
    base, off = np.zeros(n, np.int64), np.zeros(n, np.int32)
    ok, settled = np.zeros(n, bool), np.zeros(n, bool)
    places: list[str] = [""]
    place = np.zeros(n, np.int32)
    t = pc.utf8_trim(texts.cast(pa.string()), characters=_BLANKS)
    long = pc.fill_null(pc.greater(pc.binary_length(t), SHORT), False)
    if pc.any(long).as_py():
        t = pc.replace_with_mask(t, long, pc.replace_substring_regex(t.filter(long), r"[\s\v]{2,}", " "))
    t = pc.if_else(pc.fill_null(pc.less_equal(pc.binary_length(t), MAX_CHARS), False), t, "")
    if isinstance(t, pa.ChunkedArray):
        t = t.combine_chunks()
    shapes = pc.replace_substring_regex(t, "[0-9]", "9").dictionary_encode()
    codes = shapes.indices.to_numpy(zero_copy_only=False)
    mdy = pc.fill_null(month_first, False).to_numpy(zero_copy_only=False).astype(bool)
    dots = np.zeros(n, bool) if dotted_too is None else pc.fill_null(dotted_too, False).to_numpy(zero_copy_only=False).astype(bool)
    offsets = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2], np.uint8) if n and t.buffers()[2] is not None else np.zeros(0, np.uint8)
    by_code = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[by_code], np.arange(len(shapes.dictionary) + 1))
    for code, shape in enumerate(shapes.dictionary.to_pylist()):
        if not shape or not shape.isascii() or not (found := _recipe(shape)):
            continue
        kind, m = found
        rows = by_code[edges[code] : edges[code + 1]]
        cells = data[offsets[rows][:, None] + np.arange(len(shape))]
        if kind == "epoch":
            value, size = _number(cells, m, "e"), len(shape)
            base[rows] = value * 1_000_000 if size <= 11 else value * 1000 if size == 13 else value if size == 16 else value // 1000
            ok[rows] = settled[rows] = True
            continue
        g = m.groupdict()
        y = _number(cells, m, "y")
        if g.get("p1"):
            one, two = _number(cells, m, "p1"), _number(cells, m, "p2")
            flip = mdy[rows] & (dots[rows] | (g["sep"] == "/"))
            mo, d = np.where(flip, one, two), np.where(flip, two, one)
        elif g.get("name"):
            d = _number(cells, m, "d")
            mo = np.full(len(rows), next(i for i, x in enumerate(_MONTHS, 1) if x.startswith(g["name"].lower()[:3])))
        else:
            mo, d = _number(cells, m, "mo"), _number(cells, m, "d")
        h, mi = _number(cells, m, "h"), _number(cells, m, "mi")
        s = _number(cells, m, "s") if g["s"] else np.zeros(len(rows), np.int64)
        fine = np.ones(len(rows), bool)
        if g.get("ap"):
            fine &= (h >= 1) & (h <= 12)
            h = h % 12 + (12 if g["ap"].lower() == "pm" else 0)
        days, exists = _days(y, mo, d)
        fine &= exists & (h < 24) & (mi < 60) & (s < 60)
        micros = np.zeros(len(rows), np.int64)
        if g["f"]:
            lo, hi = m.span("f")
            for k in range(6):
                micros = micros * 10 + (cells[:, lo + k] - 48 if lo + k < hi else 0)
        base[rows] = ((days * 24 + h) * 60 + mi) * 60_000_000 + s * 1_000_000 + micros
        if g["off"]:
            lo, hi = m.span("off")
            digits = [k for k in range(lo + 1, hi) if shape[k] == "9"]
            hours = (cells[:, digits[0]] - 48).astype(np.int64) * 10 + (cells[:, digits[1]] - 48)
            minutes = (cells[:, digits[2]] - 48).astype(np.int64) * 10 + (cells[:, digits[3]] - 48) if len(digits) == 4 else 0
            fine &= (hours <= 18) & (minutes < 60)
            off[rows] = (hours * 3600 + minutes * 60) * (-1 if shape[lo] == "-" else 1)
            settled[rows] = True
        elif g["abbr"]:
            if g["abbr"].upper() in _UTC_NAMES:
                settled[rows] = True
            else:
                places.append(g["abbr"].upper())
                place[rows] = len(places) - 1
        elif g["zone"]:
            if "9" in g["zone"]:  # a zone name with figures: the shape does not tell it
                lo, hi = m.span("zone")
                names, inverse = np.unique(cells[:, lo:hi], axis=0, return_inverse=True)
                place[rows] = len(places) + inverse.reshape(-1)
                places += [f"[{x.tobytes().decode()}]" for x in names]
            else:
                places.append(f"[{g['zone']}]")
                place[rows] = len(places) - 1
        ok[rows] = fine
    names = pa.DictionaryArray.from_arrays(pa.array(place), pa.array(places)).cast(pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(base, mask=~ok), pa.array(off, mask=~(ok & settled)), names], fields=list(RESULT)
    )
