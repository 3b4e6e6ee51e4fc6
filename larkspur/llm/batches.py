"""Cutting Arrow batches of texts into portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters handled at once.
PORTION = 4_000_000
#: Longer texts are read in pieces that share so many characters at least, far more than any window spans.
OVERLAP = 50_000


def portions(ids: list, texts: list[str | None], size: int = PORTION, overlap: int = OVERLAP) -> Iterator[tuple[list, list[str]]]:
    """``ids, texts`` portions of at most ``size`` characters that together hold every text whole.

    A text longer than that comes in several overlapping pieces under the same
    id; null texts come as empty ones.
    """
    out_ids: list = []
    out: list[str] = []
    held = 0
    for i, t in zip(ids, texts):
        t = t or ""
        pieces = [t] if len(t) <= size else [t[k : k + size] for k in range(0, max(1, len(t) - overlap), size - overlap)]
        for p in pieces:
            if out and held + len(p) > size:
                yield out_ids, out
                out_ids, out, held = [], [], 0
            out_ids.append(i)
            out.append(p)
            held += len(p)
    if out:
        yield out_ids, out
