"""Reading nested item texts: JSON or the array notation with ``nil`` and single quotes."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"""\s*(?:([\[\]{},:])|"((?:[^"]|"")*)"|'((?:[^']|'')*)'|([^\s\[\]{},:"']+))""")


class Unreadable(ValueError):
    """The text is cut off or in neither notation."""


def read_sqf(text: str):
    """Value of an array-notation text; raises ``Unreadable``.

    Strings double their own quote inside; ``nil``, ``any`` and ``<null>`` are
    null; ``true`` and ``false`` in any case; everything else must be a number.
    """
    at, end = 0, len(text.rstrip())
    stack: list[list] = []
    expect_value, result, done = True, None, False
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done:
            raise Unreadable
        at = m.end()
        mark, double, single, bare = m.groups()
        if mark == "[":
            if not expect_value:
                raise Unreadable
            stack.append([])
            continue
        if mark == ",":
            if expect_value or not stack:
                raise Unreadable
            expect_value = True
            continue
        if mark == "]":
            if not stack or (expect_value and stack[-1]):
                raise Unreadable
            value = stack.pop()
        elif mark:
            raise Unreadable
        else:
            if not expect_value:
                raise Unreadable
            if double is not None:
                value = double.replace('""', '"')
            elif single is not None:
                value = single.replace("''", "'")
            else:
                word = bare.lower()
                if word in ("nil", "null", "any", "<null>"):
                    value = None
                elif word in ("true", "false"):
                    value = word == "true"
                else:
                    try:
                        value = float(word) if re.search(r"[.e]", word) else int(word)
                    except ValueError:
                        raise Unreadable from None
        if stack:
            stack[-1].append(value)
            expect_value = False
        else:
            result, done = value, True
    if stack or not done:
        raise Unreadable
    return result


_JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))', re.S)


def read_json(text: str):
    """Value of a JSON text of any depth (the decoder of the standard library recurses); raises ``Unreadable``."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    except ValueError:
        raise Unreadable from None
    at, end = 0, len(text.rstrip())
    stack: list = []
    keys: list[str | None] = []
    # What may come next: "value", "first" (value or end of list), "key", "first key", ":" or ",".
    expect, result = "value", None
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if not m or expect == "nothing":
            raise Unreadable
        at = m.end()
        mark, quoted, bare = m.groups()
        if mark in ("[", "{") and expect in ("value", "first"):
            stack.append([] if mark == "[" else {})
            keys.append(None)
            expect = "first" if mark == "[" else "first key"
            continue
        if quoted and expect in ("key", "first key"):
            keys[-1] = json.loads(quoted)
            expect = ":"
            continue
        if mark == ":" and expect == ":":
            expect = "value"
            continue
        if mark == "," and expect == "," and stack:
            expect = "value" if isinstance(stack[-1], list) else "key"
            continue
        if mark in ("]", "}"):
            fine = expect in (",", "first") if mark == "]" else expect in (",", "first key")
            if not stack or not fine or isinstance(stack[-1], list) != (mark == "]"):
                raise Unreadable
            value = stack.pop()
            keys.pop()
        elif not mark and expect in ("value", "first"):
            try:
                value = json.loads(quoted or bare)
            except ValueError:
                raise Unreadable from None
        else:
            raise Unreadable
        if not stack:
            result, expect = value, "nothing"
        elif isinstance(stack[-1], list):
            stack[-1].append(value)
            expect = ","
        else:
            stack[-1][keys[-1]] = value
            expect = ","
    if expect != "nothing":
        raise Unreadable
    return result


def read(text: str):
    """Value of a text in either notation, however deep; raises ``Unreadable``."""
    try:
        return read_json(text)
    except Unreadable:
        return read_sqf(text)


def read_list(value) -> list:
    """The entries of a list field: a list, a lone item, or either as text (wrapped any number of times); raises ``Unreadable``.

    A list whose second entry is a number is one item in array notation.
    """
    while isinstance(value, str):
        text = value.strip()
        if text[:1] not in ("[", "{", '"', "'"):
            return [text] if text else []
        value = read(text)
    if value is None:
        return []
    if isinstance(value, list):
        if len(value) >= 2 and isinstance(value[0], str) and isinstance(value[1], (int, float)) and not isinstance(value[1], bool):
            return [value]
        return value
    return [value]


def gear_list(text: str) -> list:
    """The item list of a whole text: named ``gear`` in an object, wrapped deeper, or standing alone."""
    value = text.strip()
    while isinstance(value, str):
        value = value.strip()
        if not value:
            return []
        if value[0] not in ("[", "{", '"', "'"):
            raise Unreadable
        value = read(value)
    if not isinstance(value, dict):
        return read_list(value)
    level = [value]
    while level:
        below = []
        for node in level:
            if "gear" in node:
                return read_list(node["gear"])
            for v in node.values():
                if isinstance(v, str) and v.lstrip()[:1] == "{":
                    try:
                        v = read(v)
                    except Unreadable:
                        continue
                if isinstance(v, dict):
                    below.append(v)
        level = below
    return [value] if item_class(value) is not None else []


def item_class(item) -> str | None:
    """The class of an item, or None if the entry is no item."""
    if isinstance(item, str):
        return item
    if isinstance(item, dict):
        found = item.get("class", item.get("className"))
        return found if isinstance(found, str) else None
    if isinstance(item, list) and item and isinstance(item[0], str):
        return item[0]
    return None


def item_count(item) -> int | None:
    """The count of an item as an integer, None if not given or no number."""
    raw = item.get("count") if isinstance(item, dict) else item[1] if isinstance(item, list) and len(item) > 1 else None
    if isinstance(raw, bool) or raw is None:
        return None
    try:
        return int(float(raw)) if abs(float(raw)) < 2**62 else None
    except (TypeError, ValueError, OverflowError):
        return None


def item_children(item):
    """``(field, raw list)`` of an item's child lists."""
    if isinstance(item, dict):
        return [(f, item[f]) for f in ("attachments", "mags", "contents") if item.get(f) is not None]
    if isinstance(item, list) and len(item) > 2 and item[2] is not None:
        return [("contents", item[2])]
    return ()
