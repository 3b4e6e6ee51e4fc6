"""Evaluation passages inside a training corpus.

Text is reduced to a string over 32 symbols (letters and digits, accents and
look-alikes folded, letters of other scripts spread over the same symbols,
everything else dropped), so layout, hyphenation, case and punctuation play no
part.  For every document, in one pass over its whole text:

1. *Q-gram filter.*  Shared q-grams of document and item are counted in
   diagonal bands that overlap by half.  Seeds are the q-grams that stand in one
   place only, so phrases and formulas common to several items never seed.
   Stretches of ``PASSAGE`` words or more that items share (equal items, near
   copies) are one place, and their q-grams seed all of these items.
2. *Edit budget.*  By the q-gram lemma a stretch of ``w`` symbols with ``e``
   changed words of length ``l`` keeps at least ``(w - q + 1) - e (l + q - 1)``
   q-grams; bands below the bound for the shortest reportable stretch drop out.
   Neighbouring bands between which other matter may stand count together.
3. *Banded alignment* of the retained regions, for all candidates of a batch at
   once, tells which words of the item really stand in the document.

Words of an item that stand in a large share of the corpus are stock formulas
and do not count towards a leak.  Their frequency is counted over all documents,
but in distinct surroundings, so that copies, reprints and versions of one text
weigh once; and a stretch of ``PASSAGE`` words or more, a leak by itself, does
not weigh at all, however many documents carry it.

Broadcast bound: the item index (at most ``MAX_ITEM_CHARS`` characters, checked)
goes to the workers, never anything that grows with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import OVERLAP, PORTION, portions
from larkspur.llm.letters import OTHER, UNSPACED, latin
from larkspur.plans.materialize import cut
from larkspur.plans.ship import ship

Q = 8
#: Diagonals per half band.
HALF = 32
#: Most that a run of foreign symbols inside a region can cost.
JUMP = 24
#: Symbols by which a region is widened on both sides before the alignment.
MARGIN = 48
#: Regions of one document and item further apart than this are not one stretch.
MAX_GAP = 400
#: Symbols aligned at once; longer regions are aligned in pieces that overlap by the margins.
PIECE = 16_384
#: Item words of a connected stretch that is a leak by itself and never a formula.
PASSAGE = 20
#: Most item words in a row that may be missing (changed) inside such a stretch.
CHANGED = 2
#: Words in a row that two items must share to be compared.
WINDOW = 5
#: Symbols on either side of a match that are its surroundings.
AROUND = 1000
#: Signatures of the surroundings (one shared is enough), and least hashes in each.
SIGNATURES, HASHES = 10, 6
#: Largest total length of all items that is sent to the workers.
MAX_ITEM_CHARS = 50_000_000
_SEP = 255


def _code_table() -> np.ndarray:
    """Latin-1 byte to symbol 0..31, or 255 for bytes that are dropped."""
    table = np.full(256, _SEP, np.uint8)
    plain = "abcdefghijklmnopqrstuvwxyz"
    for i, ch in enumerate(plain):
        table[ord(ch)] = table[ord(ch.upper())] = i
    # Look-alikes of scanned text share a symbol.
    for ch, like in (("0", "o"), ("1", "l"), ("i", "l"), ("I", "l"), ("5", "s"), ("8", "b")):
        table[ord(ch)] = table[ord(like)]
    for i, ch in enumerate("234679"):
        table[ord(ch)] = 26 + i
    for accented, base in (("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("ñ", "n"), ("òóôõöø", "o"), ("ùúûü", "u"), ("ýÿ", "y"), ("ß", "s")):
        for ch in accented:
            table[ord(ch)] = table[ord(base)]
            if ch.upper() != ch and len(ch.upper()) == 1 and ord(ch.upper()) < 256:
                table[ord(ch.upper())] = table[ord(base)]
    table[OTHER : OTHER + 32] = np.arange(32)
    return table


CODES = _code_table()
#: A word of an item: a run without blanks, or one character of a script that sets none between words.
_WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")


def _grams(codes: np.ndarray) -> np.ndarray:
    """Packed q-grams (Q = 8 symbols of 5 bits) starting at every position."""
    c = codes.astype(np.int64)
    if len(c) < Q:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 5) | c[1:]
    four = (two[:-2] << 10) | two[2:]
    return (four[:-4] << 20) | four[4:]


@dataclass
class ItemIndex:
    """Symbols and words of all items, end to end, and their seed q-grams."""

    ids: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    word_of: np.ndarray
    grams: np.ndarray
    #: Where the places of every seed begin, and the places of all of them.
    post: np.ndarray
    gram_at: np.ndarray
    bound: np.ndarray


def _slot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.int64(-7046029254386353131)) >> np.int64(42) & np.int64((1 << 22) - 1)


def _folded(text: str | None) -> list[np.ndarray]:
    """The words of a text as symbols; words without any are left out."""
    parts = (CODES[np.frombuffer(latin(m[0]), np.uint8)] for m in _WORD.finditer(text or ""))
    return [p[p != _SEP] for p in parts if (p != _SEP).any()]


def _places(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For every word of all items the first word that it copies, itself if none.

    Words are copies where two items share a stretch of ``PASSAGE`` words or more
    with at most ``CHANGED`` in a row changed, found by their common windows of
    ``WINDOW`` words.  All pairs of items that share a window are compared.
    """
    place = np.arange(len(words))
    n = len(words) - WINDOW + 1
    if n < 1:
        return place
    window = np.unique(np.lib.stride_tricks.sliding_window_view(words, WINDOW), axis=0, return_inverse=True)[1].reshape(-1)
    inside = np.flatnonzero(item[:n] == item[WINDOW - 1 :])
    order = inside[np.argsort(window[inside], kind="stable")]
    pairs = []
    for step in range(1, len(order)):
        same = window[order[step:]] == window[order[:-step]]
        if not same.any():
            break
        a, b = order[:-step][same], order[step:][same]
        pairs.append(np.stack([a, b])[:, item[a] != item[b]])
    if not pairs or not (both := np.concatenate(pairs, axis=1)).size:
        return place
    both = (both[:, :, None] + np.arange(WINDOW)).reshape(2, -1)
    both = np.unique(both, axis=1)
    a, b = both[:, np.lexsort((both[0], both[1] - both[0], item[both[1]], item[both[0]]))]
    new = (np.diff(b - a, prepend=-1) != 0) | (np.diff(item[a], prepend=-1) != 0) | (np.diff(item[b], prepend=-1) != 0) | (np.diff(a, prepend=a[0]) > CHANGED + 1)
    edge = np.flatnonzero(new)
    last = np.concatenate([edge[1:], [len(a)]]) - 1
    long = (a[last] - a[edge] + 1 >= PASSAGE)[np.cumsum(new) - 1]
    a, b = a[long], b[long]
    while True:
        before = place.copy()
        least = np.minimum(place[a], place[b])
        np.minimum.at(place, a, least)
        np.minimum.at(place, b, least)
        if (place == before).all():
            return place


def build_index(items: list[tuple[int, str | None]], min_words: int = 9, changed: int = 1) -> ItemIndex:
    """Index ``(item_id, text)``; an item without letters or digits is kept but never matches.

    ``bound`` is the number of seeds per item that a band must share: the q-gram
    lemma's count for a stretch of ``min_words`` average words of which
    ``changed`` are changed, scaled by the item's share of seeds among its q-grams.
    """
    codes, word_of, starts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int32)], [0]
    lengths, counts, known = [], [], {}
    names: list[int] = []
    for _, text in items:
        parts = _folded(text)
        codes += parts
        word_of.append(np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]))
        names += [known.setdefault(p.tobytes(), len(known)) for p in parts]
        size = len(word_of[-1])
        starts.append(starts[-1] + size)
        counts.append(len(parts))
        lengths.append(size / max(1, len(parts)))
    whole, edges = np.concatenate(codes), np.asarray(starts, np.int64)
    grams = _grams(whole)
    item = np.searchsorted(edges, np.arange(len(grams)), side="right") - 1
    inside = np.arange(len(grams)) + Q <= edges[item + 1]
    grams, at, item = grams[inside], np.flatnonzero(inside), item[inside]
    place = _places(np.asarray(names, np.int64), np.repeat(np.arange(len(items)), counts))
    begin = np.cumsum([0, *map(len, codes[1:])])
    word = np.searchsorted(begin, at, side="right") - 1
    canon = begin[place[word]] + at - begin[word] if len(at) else at
    order = np.lexsort((at, grams))
    grams, at, item, canon = grams[order], at[order], item[order], canon[order]
    value, first, times = np.unique(grams, return_index=True, return_counts=True)
    one = np.minimum.reduceat(canon, first) == np.maximum.reduceat(canon, first) if len(first) else np.zeros(0, bool)
    once = np.flatnonzero(np.repeat(one, times))
    per_item = np.bincount(item, minlength=len(items))
    seeds = np.bincount(item[once], minlength=len(items))
    mean = np.asarray(lengths) if items else np.zeros(0)
    lemma = (min_words * mean - Q + 1) - changed * (mean + Q - 1)
    bound = np.maximum(6, np.floor(lemma * seeds / np.maximum(1, per_item))).astype(np.int64)
    return ItemIndex(
        np.asarray([i for i, _ in items], np.int64), whole, edges, np.concatenate(word_of),
        value[one], np.concatenate([[0], np.cumsum(times[one])]), at[once], bound,
    )


def _chained(which: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Seeds of the fullest chain that a band pair is part of.

    A pair of the same document and item (``which``) follows another if it comes
    later in the document (``begin``), at most ``MAX_GAP`` symbols on, on another
    diagonal, and goes on in the item at most ``MARGIN`` after the other.  They
    may overlap there, as a chance seed of the band can widen them, but seeds of
    one place that stand twice in the document do not count twice.
    """
    order = np.lexsort((begin, which))
    w, b, lo, hi, t = which[order], begin[order], lo[order], hi[order], total[order]
    end = b + hi - lo
    reach = np.flatnonzero(np.concatenate([[False], (w[1:] == w[:-1])]) | np.concatenate([w[1:] == w[:-1], [False]]))
    fore, back = t.copy(), t.copy()
    links = []
    for step in range(1, len(reach)):
        i, j = reach[:-step], reach[step:]
        same = w[i] == w[j]
        if not same.any():
            break
        ok = same & (b[j] - end[i] <= MAX_GAP) & (b[j] - lo[j] - b[i] + lo[i] > 2 * HALF) & (lo[j] - hi[i] <= MARGIN) & (lo[j] - lo[i] > 2 * Q)
        links.append(np.stack([i[ok], j[ok]]))
    if links:
        i, j = np.concatenate(links, axis=1)
        for k in np.lexsort((i, j)).tolist():
            fore[j[k]] = max(fore[j[k]], t[j[k]] + fore[i[k]])
        for k in np.lexsort((j, i))[::-1].tolist():
            back[i[k]] = max(back[i[k]], t[i[k]] + back[j[k]])
    out = np.empty_like(total)
    out[order] = fore + back - t
    return out


def _candidates(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, at: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, ...]:
    """Retained regions: ``doc, item, least diagonal of the band pair, first and last item position``."""
    band = diagonal // HALF
    low = band.min()
    width = int(band.max() - low) + 3
    key = (doc * len(index.ids) + item) * width + (band - low)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    cell, begin, count = np.unique(key, return_index=True, return_counts=True)
    first, last = np.minimum.reduceat(at, begin), np.maximum.reduceat(at, begin)
    # Bands overlap by half, so a cell belongs to two of them; it speaks for the fuller one.

    def of(x: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
        k = np.minimum(np.searchsorted(cell, x), len(cell) - 1)
        return np.where(cell[k] == x, values[k], missing)

    below, above = of(cell - 1, count, 0), of(cell + 1, count, 0)
    pair = np.unique(np.where(above >= below, cell, cell - 1))
    total = of(pair, count, 0) + of(pair + 1, count, 0)
    lo = np.minimum(of(pair, first, 2**40), of(pair + 1, first, 2**40))
    hi = np.maximum(of(pair, last, -1), of(pair + 1, last, -1))
    which = pair // width
    keep = _chained(which, lo + (pair % width + low) * HALF, lo, hi, total) >= index.bound[which % len(index.ids)]
    pair, which = pair[keep], which[keep]
    return which // len(index.ids), which % len(index.ids), (pair % width + low) * HALF, lo[keep], hi[keep] + Q


def _align(rows: np.ndarray, cols: np.ndarray, band: int) -> np.ndarray:
    """Where the symbols of every row text stand, in order, in its column text, or -1 (banded edit distance).

    ``rows`` is (n, L), ``cols`` is (n, L + band); cell (i, k) compares ``rows[i]``
    with ``cols[i + k]``.  Both ends of the column text are free; a run of foreign
    symbols costs at most ``JUMP``, so matter that stands in between does not hide
    one of the sides.
    """
    n, length = rows.shape
    ramp = np.arange(band, dtype=np.int16)
    best = np.zeros((n, band), np.int16)
    way = np.empty((length, n, band), np.uint8)
    source = np.empty((length, n, band), np.uint8)
    index = np.arange(band, dtype=np.uint8)
    for i in range(length):
        over = best + (cols[:, i : i + band] != rows[:, i : i + 1])
        skip = np.full((n, band), 30000, np.int16)
        skip[:, :-1] = best[:, 1:] + 1
        down = np.minimum(over, skip)
        walk = np.minimum.accumulate(down - ramp, axis=1) + ramp
        least = np.minimum.accumulate(down, axis=1)
        source[i] = np.maximum.accumulate(np.where(down == least, index, 0), axis=1)
        best = np.minimum(walk, least + JUMP)
        way[i] = np.where(best < down, np.where(walk <= best, 2, 3), np.where(over <= skip, 0, 1))
        # Only differences count, so the sums stay small in a text of any length.
        best -= best.min(axis=1, keepdims=True)
    k = best.argmin(axis=1)
    i = np.full(n, length - 1)
    found = np.full((n, length), -1)
    live = np.arange(n)
    while len(live):
        step = way[i[live], live, k[live]]
        diagonal = live[step == 0]
        same = rows[diagonal, i[diagonal]] == cols[diagonal, i[diagonal] + k[diagonal]]
        found[diagonal, i[diagonal]] = np.where(same, i[diagonal] + k[diagonal], -1)
        i[diagonal] -= 1
        up = live[step == 1]
        i[up] -= 1
        k[up] += 1
        k[live[step == 2]] -= 1
        far = live[step == 3]
        k[far] = source[i[far], far, k[far]]
        live = live[i[live] >= 0]
    return found


def _surroundings(codes: np.ndarray, begin: int, first: int, last: int, end: int) -> list[int]:
    """Signatures of the text ``begin..end`` around the match ``first..last``; near copies share one of them."""
    sides = [_grams(codes[max(begin, first - AROUND) : first]), _grams(codes[last + 1 : min(end, last + 1 + AROUND)])]
    grams = np.concatenate(sides)
    if not len(grams):
        return [0] * SIGNATURES
    with np.errstate(over="ignore"):
        mixed = grams.astype(np.uint64) * np.uint64(11400714819323198485)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(13787848793156543929)
        mixed ^= mixed >> np.uint64(32)
        least = np.full(SIGNATURES * HASHES, np.iinfo(np.uint64).max)
        np.minimum.at(least, (mixed >> np.uint64(32)) % np.uint64(len(least)), mixed)
        odd = np.arange(1, 2 * HASHES, 2, dtype=np.uint64) * np.uint64(11400714819323198485)
        return (least.reshape(SIGNATURES, HASHES) * odd).sum(axis=1).view(np.int64).tolist()


def _formulaic(words: list[int]) -> list[int]:
    """The words that do not belong to a stretch of ``PASSAGE`` item words with at most ``CHANGED`` in a row missing."""
    w = np.asarray(words)
    run = np.cumsum(np.diff(w, prepend=w[0]) > CHANGED + 1)
    edge = np.flatnonzero(np.diff(run, prepend=-1))
    span = np.maximum.reduceat(w, edge) - np.minimum.reduceat(w, edge) + 1
    return w[span[run] < PASSAGE].tolist()


def matches(texts: list[str | None], index: ItemIndex, bitmap: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """``(text number, item number, matched word numbers of the item)`` of every region chain in a batch of whole texts."""
    return [found[:3] for found in stretches(texts, index, bitmap)]


def stretches(texts: list[str | None], index: ItemIndex, bitmap: np.ndarray) -> list[tuple[int, int, list[int], list[int]]]:
    """What ``matches`` gives, and the signatures of the text around each match."""
    raw = [latin(t) if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = CODES[np.frombuffer(b"".join(raw), np.uint8)]
    kept = np.flatnonzero(codes != _SEP)
    edges = np.searchsorted(kept, np.concatenate([[0], np.cumsum(sizes)]))
    codes = codes[kept]
    grams = _grams(codes)
    if not len(grams) or not len(index.grams):
        return []
    at = np.flatnonzero(bitmap[_slot(grams)])
    k = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    real = index.grams[k] == grams[at]
    at, k = at[real], k[real]
    doc = np.searchsorted(edges, at, side="right") - 1
    inside = at + Q <= edges[doc + 1]
    at, k, doc = at[inside], k[inside], doc[inside]
    if not len(at):
        return []
    times = index.post[k + 1] - index.post[k]
    again = np.repeat(np.arange(len(k)), times)
    place = index.gram_at[np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times) + index.post[k][again]]
    at, doc = at[again], doc[again]
    item = np.searchsorted(index.starts, place, side="right") - 1
    c_doc, c_item, c_diag, c_lo, c_hi = _candidates(doc, item, at - place, place, index)
    if not len(c_doc):
        return []
    pieces = np.maximum(1, -(-(c_hi - c_lo) // PIECE))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    c_doc, c_item, c_diag, c_lo, c_hi = (np.repeat(x, pieces) for x in (c_doc, c_item, c_diag, c_lo, c_hi))
    c_lo, c_hi = c_lo + nth * PIECE, np.minimum(c_hi, c_lo + (nth + 1) * PIECE)
    lo = np.maximum(c_lo - MARGIN, index.starts[c_item])
    hi = np.minimum(c_hi + MARGIN, index.starts[c_item + 1])
    band = 2 * HALF + 16
    out: dict[tuple[int, int], list] = {}
    order = np.argsort(hi - lo, kind="stable")
    at_once = 0
    while at_once < len(order):
        longest = int((hi - lo)[order[at_once]])
        group = order[at_once : at_once + 1]
        # Regions of like length go together, as many as fit in about 32 MB of directions.
        more = order[at_once : at_once + max(1, 16_000_000 // (max(64, int(longest * 1.3)) * band))]
        group = more[(hi - lo)[more] <= max(64, longest * 1.3)]
        at_once += len(group)
        length = int((hi - lo)[group].max())
        r = lo[group][:, None] + np.arange(length)
        r_ok = r < hi[group][:, None]
        rows = np.where(r_ok, index.codes[np.minimum(r, len(index.codes) - 1)], 254)
        c = (lo[group] + c_diag[group] - 8)[:, None] + np.arange(length + band)
        c_ok = (c >= edges[c_doc[group]][:, None]) & (c < edges[c_doc[group] + 1][:, None])
        cols = np.where(c_ok, codes[np.clip(c, 0, len(codes) - 1)], 253)
        found = np.where(r_ok, _align(rows, cols, band), -1)
        for g, place, span, c_at in zip(group.tolist(), found, r, c):
            word = index.word_of[span[: int(hi[g] - lo[g])]]
            place = place[: len(word)]
            hit = place >= 0
            base = int(word[0])
            full = np.bincount(word - base)
            part = np.bincount(word[hit] - base, minlength=len(full))
            good = np.flatnonzero((part >= 0.7 * full) & (full > 0)) + base
            if len(good):
                where = int(lo[g] + c_diag[g])
                of_good = c_at[place[hit & np.isin(word, good)]]
                out.setdefault((int(c_doc[g]), int(c_item[g])), []).append((int(lo[g]), where, where + len(word), good, int(of_good[0]), int(of_good[-1])))
    result = []
    for (d, i), regions in out.items():
        regions.sort(key=lambda x: x[1])
        chain, far, first, last = set(regions[0][3].tolist()), *regions[0][2:3], *regions[0][4:]
        chains = []
        for _, begin, end, good, one, other in regions[1:]:
            if begin - far <= MAX_GAP:
                chain, first, last = chain | set(good.tolist()), min(first, one), max(last, other)
            else:
                chains.append((chain, first, last))
                chain, first, last = set(good.tolist()), one, other
            far = max(far, end)
        for chain, first, last in [*chains, (chain, first, last)]:
            result.append((d, i, sorted(chain), _surroundings(codes, int(edges[d]), first, last, int(edges[d + 1]))))
    return result


def item_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, words``: item words (numbers) that a document carries in one region chain, a row for every chain.

    ``formulaic`` are those of them that may belong to a formula, ``around`` the
    signatures of the text next to the match.
    """
    spark = docs.sparkSession
    ship(spark)
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    if total > MAX_ITEM_CHARS:
        raise ValueError(f"the items hold {total} characters; at most {MAX_ITEM_CHARS} can be indexed at once")
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL").distinct()
    # Items of one text are looked for once and all reported.
    ids_of: dict[tuple[bytes, ...], list[int]] = {}
    kept = []
    for i, t in sorted((r.i, r.t or "") for r in rows.collect()):
        ids_of.setdefault(key := tuple(p.tobytes() for p in _folded(t)), []).append(i)
        if len(ids_of[key]) == 1:
            kept.append((i, t))
    index = build_index(kept)
    equal = [list(dict.fromkeys(x)) for x in ids_of.values()]
    # Pieces of a very long text share more than the longest item with as much other matter in between.
    overlap = OVERLAP + 8 * max((len(t) for _, t in kept), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << 22, bool)
        bitmap[_slot(index.grams)] = True
        for batch in batches:
            for ids, texts in portions(batch.column(0).to_pylist(), batch.column(1).to_pylist(), PORTION + overlap, overlap):
                found = [(d, i, w, a) for d, n, w, a in stretches(texts, index, bitmap) for i in equal[n]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, _, _, _ in found], pa.int64()),
                        pa.array([i for _, i, _, _ in found], pa.int64()),
                        pa.array([w for _, _, w, _ in found], pa.list_(pa.int32())),
                        pa.array([_formulaic(w) for _, _, w, _ in found], pa.list_(pa.int32())),
                        pa.array([a for _, _, _, a in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "item_id", "words", "formulaic", "around"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, item_id long, words array<int>, formulaic array<int>, around array<long>")


def _contexts(pairs: DataFrame) -> DataFrame:
    """``item_id, word, df``: in how many distinct surroundings a word stands in a formulaic stretch.

    Matches of an item whose surroundings share a signature are copies of each
    other; the least document among them stands for all.
    """
    alone = pairs.filter(F.size("formulaic") > 0)
    one = alone.groupBy("item_id", "formulaic", "around").agg(F.min("doc_id").alias("doc_id"))
    one = one.select("item_id", "formulaic", "doc_id", F.posexplode("around").alias("nth", "signature"))
    leader = one.groupBy("item_id", "nth", "signature").agg(F.min("doc_id").alias("leader"))
    led = one.join(leader, ["item_id", "nth", "signature"]).groupBy("item_id", "formulaic", "doc_id").agg(F.min("leader").alias("leader"))
    words = led.select("item_id", "leader", F.explode("formulaic").alias("word")).distinct()
    return words.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("df"))


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = 15,
    max_hole: int = 10,
    stock_share: float = 0.005,
    stock_floor: int = 10,
    stock_part: float = 0.4,
) -> DataFrame:
    """``doc_id, item_id, n_words`` of every document that carries at least ``min_words`` words of an item
    in order in one connected stretch, stock formulas not counted.

    A word of an item is stock when it is matched in more distinct surroundings
    than ``stock_share`` of all documents (and than ``stock_floor``); copies of
    one text weigh once, and a stretch of ``PASSAGE`` words or more (isolated
    ones changed) weighs nothing, as it is a leak by itself.  An item of which more than
    ``stock_part`` would be stock is widely copied rather than formulaic, and all
    its words count.  A stretch ends where more
    than ``max_hole`` words of the item in a row are missing.  Null and empty
    texts carry nothing; repeated documents give one row; texts of any length
    are read whole.
    """
    pairs = cut(item_matches(docs, items))
    limit = max(stock_floor, stock_share * docs.count())
    common = _contexts(pairs)
    blanks = F.regexp_replace("text", f"([{UNSPACED}])", " $1 ")
    sizes = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.size(F.split(F.trim(blanks), r"\s+"))).alias("size"))
    # One row per item at most, of at most MAX_ITEM_CHARS words in all.
    stock = common.filter(F.col("df") > limit).groupBy("item_id").agg(F.collect_set("word").alias("stock"))
    stock = stock.join(F.broadcast(sizes), "item_id").filter(F.size("stock") <= stock_part * F.col("size")).drop("size")
    x = pairs.join(F.broadcast(stock), "item_id", "left")
    x = x.withColumn("own", F.when(F.col("stock").isNull(), F.col("words")).otherwise(F.array_sort(F.array_except("words", "stock"))))
    run = F.aggregate(
        "own",
        F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(-1).alias("last")),
        lambda a, w: F.struct(
            F.greatest(a.best, F.when(w - a.last - 1 <= max_hole, a.now + 1).otherwise(1)).alias("best"),
            F.when(w - a.last - 1 <= max_hole, a.now + 1).otherwise(1).alias("now"),
            w.alias("last"),
        ),
        lambda a: a.best,
    )
    x = x.withColumn("n_words", run).filter(F.col("n_words") >= min_words)
    return x.groupBy("doc_id", "item_id").agg(F.max("n_words").cast("long").alias("n_words"))
