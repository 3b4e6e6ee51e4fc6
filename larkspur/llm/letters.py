"""Texts as bytes of one Latin-1 letter each, whatever script they are written in.

Letters of other scripts have no byte in Latin-1.  What decomposes into plain
letters does so (``œ``, ``ﬁ``, ``š``), look-alikes of Latin letters become these,
any other letter or digit is written in the 32 bytes 0x80 to 0x9F, which stand
for no character of a text, and everything else is a blank.
"""

from __future__ import annotations

import unicodedata

#: First of the 32 bytes that write letters of other scripts.
OTHER = 0x80
_OTHERS = bytes(range(OTHER, OTHER + 32))
#: Greek and Cyrillic letters that look like Latin ones, and letters that do not decompose.
_ALIKE = dict(zip("οаеорсухіѕјɑ", "oaeopcyxisja")) | {"œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d", "ŋ": "n"}
#: Blocks of scripts written without blanks between words (kana, ideographs, Hangul syllables stay words).
_UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF), (0x0E00, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F))
#: The same as a character class of a regular expression.
UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSPACED)


class _Table(dict):
    """Code point to its Latin-1 spelling, found when first asked for."""

    def __init__(self, exact: bool) -> None:
        super().__init__()
        self.exact = exact

    def __missing__(self, code: int) -> str:
        if code < 256:
            self[code] = chr(code) if not OTHER <= code < OTHER + 32 else " "
        else:
            low = chr(code).lower()
            # Typographic hyphens and line marks keep what they do in the text.
            self[code] = "-" if 0x2010 <= code <= 0x2012 else "\n" if code in (0x2028, 0x2029) else "".join(map(self._one, unicodedata.normalize("NFKD", _ALIKE.get(low, low))))
        return self[code]

    def _one(self, ch: str) -> str:
        ch = _ALIKE.get(ch, ch)
        if ch.isascii():
            return ch if ch.isalnum() else " "
        if unicodedata.category(ch)[0] == "M":
            return ""
        if not ch.isalnum():
            return " "
        if not self.exact:
            return chr(OTHER + (ord(ch) & 31))
        # Four digits to the base 32 hold any code point.
        return "".join(chr(OTHER + (ord(ch) >> shift & 31)) for shift in (15, 10, 5, 0))


_ROUGH, _EXACT = _Table(False), _Table(True)


def latin(text: str, exact: bool = False) -> bytes:
    """Bytes of a text.  A letter of another script is one byte (several share one), with ``exact`` four of its own."""
    if text.isascii():
        return text.encode("ascii")
    try:
        return text.encode("latin-1").translate(None, _OTHERS)
    except UnicodeEncodeError:
        return text.translate(_EXACT if exact else _ROUGH).encode("latin-1", "ignore")
