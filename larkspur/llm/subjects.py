"""Subject areas of documents by mined class-association rules.

1. *Mining.*  A bounded sample of the labelled documents is cut into sentences.
   Parallel frequent-pattern growth, bounded to sets of two words, finds the
   sets that occur with a class: a sentence's words are put in the order of the
   frequency list, every word takes its prefix as conditional pattern base, and
   the bases are counted per (word, prefix word) and class with combining on the
   map side, never gathered.  A set whose confidence is high enough becomes a
   rule.  A rule is redundant, and dropped, when a more general rule of the same
   class is about as confident.
2. *Scoring.*  Every document is read whole.  A sentence's evidence for a class
   combines the rules that match in it; the document's score is the best sum
   over ``WINDOW`` consecutive sentences, so that a passing mention in a single
   sentence stays low however often rules match elsewhere.
3. *Calibration.*  Counts are kept per fold of the sample, so that the same pass
   gives the rules mined without each fold.  Every labelled document is scored by
   the rules that have not seen it; monotone regression of its labels on these
   scores maps evidence to probability; what is likelier than half of the best F1 is given.

Broadcast bound: the rules, which come from the bounded sample and are counted
before they leave it (more than ``MAX_RULES`` is an error); nothing that grows
with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import portions
from larkspur.llm.letters import OTHER, latin
from larkspur.plans.materialize import cut
from larkspur.plans.ship import ship

#: Sentences over which evidence adds up.
WINDOW = 3
#: Parts of the labelled sample that are scored by the rules of the others.
FOLDS = 5
#: More rules than this are an error, not a cut: raise the support or the confidence.
MAX_RULES = 200_000
_BREAK = 1


def _letter_table() -> bytes:
    """Latin-1 byte to a folded letter, 1 for a sentence mark, 2 for a newline, 3 for a digit, else 0."""
    table = bytearray(256)
    for ch in "abcdefghijklmnopqrstuvwxyz":
        table[ord(ch)] = table[ord(ch.upper())] = ord(ch)
    for accented, base in (("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("ñ", "n"), ("òóôõöø", "o"), ("ùúûü", "u"), ("ýÿ", "y"), ("ß", "s")):
        for ch in accented:
            table[ord(ch)] = ord(base)
            if ch.upper() != ch and len(ch.upper()) == 1 and ord(ch.upper()) < 256:
                table[ord(ch.upper())] = ord(base)
    for byte in range(OTHER, OTHER + 32):
        table[byte] = byte
    for ch in ".!?":
        table[ord(ch)] = _BREAK
    table[ord("\n")] = 2
    for ch in "0123456789":
        table[ord(ch)] = 3
    return bytes(table)


_TABLE = _letter_table()
_HYPHEN = re.compile(rb"-\n(?=[a-z])")


def _folded(text: str) -> bytes:
    raw = latin(text, exact=True)
    if b"-\n" in raw:
        raw = _HYPHEN.sub(b"", raw)
    return raw.translate(_TABLE) + b"\x02\x02"


@dataclass
class Words:
    """Words of a batch: hash, document and sentence (numbered over the whole batch)."""

    value: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[1], np.full(max(0, n - 1), 1099511628211)]).astype(np.int64))


def word_hash(word: str) -> int:
    """Hash of a folded word, as in ``read_words``."""
    codes = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.int64)
    with np.errstate(over="ignore"):
        return int((codes * _powers(len(codes))).sum())


def _layout(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [_folded(t) if t else b"\x02\x02" for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    b = np.frombuffer(b"".join(raw), np.uint8)
    letter = b >= 97
    # A sentence ends at a mark after a word and before a blank, and at an empty line.
    after = np.append(b[1:], 0)
    before = np.concatenate([[0], b[:-1]])
    ends = ((b == _BREAK) & (before >= 97) & ((after == 0) | (after == 2))) | ((b == 2) & (before == 2))
    sentence = np.cumsum(ends)
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    size = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1 - start
    return b, edges, sentence, start, size, letter


def read_words(texts: list[str | None]) -> Words:
    """All words of a batch of whole texts, hashed (words of one letter are left out)."""
    b, edges, sentence, start, size, letter = _layout(texts)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    chars = b[letter].astype(np.int64)
    offset = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(offset, size)
    with np.errstate(over="ignore"):
        value = np.add.reduceat(chars * _powers(int(size.max()))[place], offset)
    real = size > 1
    start, value = start[real], value[real]
    return Words(value, np.searchsorted(edges, start, side="right") - 1, sentence[start])


def sentences(text: str) -> list[list[str]]:
    """Folded words of each sentence of a text (the mining side of ``read_words``)."""
    b, _, sentence, start, size, _ = _layout([text])
    whole, out, last = b.tobytes(), [], None
    for s, n, k in zip(start.tolist(), size.tolist(), sentence[start].tolist()):
        if n < 2:
            continue
        if k != last:
            out.append([])
            last = k
        out[-1].append(whole[s : s + n].decode("latin-1"))
    return out


@dataclass
class RuleSet:
    """Rules ``words -> subject`` with confidences, the fitted threshold and the map from score to probability.

    ``steps`` are ``(least score, probability)``, rising in both; below the first the probability is 0.
    """

    subjects: list[str]
    rules: list[tuple[tuple[str, ...], int, float]]
    threshold: float = 1.2
    steps: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.2, 1.0))

    def probability(self, score: np.ndarray) -> np.ndarray:
        at = np.searchsorted([x for x, _ in self.steps], score, side="right")
        return np.concatenate([[0.0], [p for _, p in self.steps]])[at]


class Scorer:
    """Lookup tables of a rule set, built once per task."""

    def __init__(self, rules: RuleSet) -> None:
        words = sorted({w for r, _, _ in rules.rules for w in r})
        hashes = np.array([word_hash(w) for w in words], np.int64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {words[k]: i for i, k in enumerate(order.tolist())}
        self.n_words, self.n_classes = max(1, len(words)), max(1, len(rules.subjects))
        self.single = np.zeros((self.n_words, self.n_classes))
        pair_key, pair_cell = [], []
        for r, c, confidence in rules.rules:
            if len(r) == 1:
                self.single[number[r[0]], c] = confidence
            else:
                x, y = sorted(number[w] for w in r)
                pair_key.append(x * self.n_words + y)
                pair_cell.append((c, confidence))
        order = np.argsort(np.array(pair_key, np.int64), kind="stable")
        self.pair_key = np.array(pair_key, np.int64)[order]
        self.pair_class = np.array([c for c, _ in pair_cell], np.int64)[order]
        self.pair_conf = np.array([x for _, x in pair_cell], float)[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.int64(-7046029254386353131)) >> np.int64(44) & np.int64((1 << 20) - 1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``doc, class, score`` of every pair with any evidence."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        w = read_words(texts)
        if not len(w.value) or not len(self.hashes):
            return none
        at = np.flatnonzero(self.bitmap[self._slot(w.value)])
        k = np.minimum(np.searchsorted(self.hashes, w.value[at]), len(self.hashes) - 1)
        real = self.hashes[k] == w.value[at]
        at, k = at[real], k[real]
        if not len(at):
            return none
        # Distinct rule words per sentence.
        key = np.unique(w.sentence[at] * self.n_words + k)
        sent, word = key // self.n_words, key % self.n_words
        first = np.unique(w.sentence[at], return_index=True)
        doc_of = dict(zip(first[0].tolist(), w.doc[at][first[1]].tolist()))
        # Evidence: how little is left unexplained when all matching rules of a class speak (noisy or).
        rows, cols = np.nonzero(self.single[word])
        cells = [sent[rows] * self.n_classes + cols]
        loss = [np.log1p(-np.minimum(self.single[word][rows, cols], 0.99))]
        if len(self.pair_key):
            # Until no two rule words of one sentence stand so far apart in its list.
            for step in range(1, len(sent)):
                near = np.flatnonzero(sent[step:] == sent[:-step])
                if not len(near):
                    break
                pk = word[near] * self.n_words + word[near + step]
                lo, hi = np.searchsorted(self.pair_key, pk, "left"), np.searchsorted(self.pair_key, pk, "right")
                hit = np.repeat(np.arange(len(pk)), hi - lo)
                if len(hit):
                    which = np.repeat(lo, hi - lo) + np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                    cells.append(sent[near][hit] * self.n_classes + self.pair_class[which])
                    loss.append(np.log1p(-np.minimum(self.pair_conf[which], 0.99)))
        cell, loss = np.concatenate(cells), np.concatenate(loss)
        if not len(cell):
            return none
        used, slot = np.unique(cell, return_inverse=True)
        evidence = 1 - np.exp(np.bincount(slot, weights=loss))
        sent, cls = used // self.n_classes, used % self.n_classes
        doc = np.array([doc_of[s] for s in sent.tolist()], np.int64)
        order = np.lexsort((sent, cls, doc))
        sent, cls, doc, evidence = sent[order], cls[order], doc[order], evidence[order]
        total = evidence.copy()
        for step in range(1, WINDOW):
            if step >= len(sent):
                break
            same = (doc[step:] == doc[:-step]) & (cls[step:] == cls[:-step]) & (sent[step:] - sent[:-step] < WINDOW)
            total[:-step] += np.where(same, evidence[step:], 0)
        pair = doc * self.n_classes + cls
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return doc[begin], cls[begin], np.maximum.reduceat(total, begin)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_documents: int) -> DataFrame:
    """``doc_id, text, subjects`` of at most ``max_documents`` labelled documents, chosen by a hash of the id."""
    own = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    # At most max_documents ids with a handful of subjects each: a proven bound.
    x = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter("text IS NOT NULL")
    return x.dropDuplicates(["doc_id"])


def _training(counts: str, without: int | None) -> Column:
    """Sum of the fold counts of ``counts``, but those of one fold."""
    parts = [F.col(f"{counts}{f}") for f in range(FOLDS) if f != without]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _per_fold(name: str) -> list[Column]:
    return [F.count_if(F.col("fold") == f).alias(f"{name}{f}") for f in range(FOLDS)]


def mine(sample: DataFrame, subjects: list[str], min_confidence: float = 0.5, support_share: float = 0.0015) -> list[RuleSet]:
    """Class-association rules of a (settled) labelled sample with ``fold``: of the whole, then without each fold.

    A word must stand in ``support_share`` of the training documents of its class, and in at least 4, and stand out
    there; a set of words in as many sentences.
    """
    per_fold = {r.fold: r.n for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    trainings: list[int | None] = [None, *range(FOLDS)]
    n_docs = {w: sum(n for f, n in per_fold.items() if f != w) for w in trainings}
    if not n_docs[None]:
        return [RuleSet(subjects, []) for _ in trainings]
    least = {w: max(4, round(support_share * n)) for w, n in n_docs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, folds, labels, words = [], [], [], []
            for i, t, s, f in zip(*[b.column(k).to_pylist() for k in range(4)]):
                for sentence in {tuple(sorted(set(x))) for x in sentences(t)}:
                    ids.append(i)
                    folds.append(f)
                    labels.append(s)
                    words.append(sentence)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(folds, pa.int32()), pa.array(labels, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string()))],
                names=["doc_id", "fold", "labels", "words"],
            )

    # One row per distinct sentence of a document.
    rows = cut(sample.select("doc_id", "text", "subjects", "fold").mapInArrow(run, "doc_id long, fold int, labels array<string>, words array<string>"))
    rows = rows.withColumn("sentence", F.monotonically_increasing_id())
    # Only words that stand out for some class in a training set take part there; all others could form no rule.
    by_doc = rows.select("doc_id", "fold", "labels", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.first("fold").alias("fold"), F.first("labels").alias("labels"))
    totals = by_doc.groupBy("word").agg(*_per_fold("n"))
    joint = by_doc.select("word", "fold", F.explode("labels").alias("label")).groupBy("word", "label").agg(*_per_fold("k"))
    prior = sample.select("fold", F.explode("subjects").alias("label")).groupBy("label").agg(*_per_fold("p"))
    told = joint.join(totals, "word").join(F.broadcast(prior), "label")
    bits = F.lit(0)
    for b, w in enumerate(trainings):
        k, n, base = _training("k", w), _training("n", w), _training("p", w) / max(1, n_docs[w])
        share = F.try_divide(k, n)
        stands_out = ((F.try_divide(share, base) >= 2.0) | (share - base >= 0.25 * (1 - base))) & (k >= least[w])
        bits = bits.bitwiseOR(F.when(stands_out, 1 << b).otherwise(0))
    vocabulary = told.groupBy("word").agg(F.bit_or(bits).alias("in_sets"), F.max(_training("n", None)).alias("f")).filter("in_sets > 0")
    # The frequency list: frequent words first, so prefixes are short lists of frequent words.
    vocabulary = vocabulary.select("word", "in_sets", F.struct((-F.col("f")).alias("f"), "word", "in_sets").alias("entry"))
    kept = rows.select("sentence", "fold", "labels", F.explode("words").alias("word")).join(vocabulary, "word")
    baskets = kept.groupBy("sentence").agg(F.first("fold").alias("fold"), F.first("labels").alias("labels"), F.array_sort(F.collect_list("entry")).alias("items"))
    # Every word with itself (sets of one) and with its prefix (sets of two); the class "" counts the sentences of any.
    base_of = F.posexplode("items").alias("at", "item")
    grown = baskets.select("fold", F.concat(F.array(F.lit("")), "labels").alias("labels"), "items", base_of)
    grown = grown.select("fold", "labels", "item", F.explode(F.slice("items", F.lit(1), F.col("at") + 1)).alias("other"))
    sets = grown.select("fold", F.explode("labels").alias("label"), F.col("other.word").alias("a"), F.col("item.word").alias("b"), F.col("other.in_sets").bitwiseAND(F.col("item.in_sets")).alias("in_sets"))
    counts = cut(sets.filter("in_sets > 0").groupBy("a", "b", "label", "in_sets").agg(*_per_fold("c")))
    anyone = counts.filter("label = ''").select("a", "b", *[F.col(f"c{f}").alias(f"t{f}") for f in range(FOLDS)])
    classes = cut(counts.filter(F.col("label").isin(subjects)).join(anyone, ["a", "b"]))
    cells = []
    for b, w in enumerate(trainings):
        fine = (F.col("in_sets").bitwiseAND(F.lit(1 << b)) != 0) & (_training("c", w) >= least[w])
        # A Laplace estimate keeps rare sets from looking certain.
        cells.append(F.struct(F.lit(b).alias("no"), F.when(fine, (_training("c", w) + 0.5) / (_training("t", w) + 1.5)).alias("p")))
    own = classes.select("a", "b", "label", F.inline(F.array(*cells))).filter(F.col("p") >= min_confidence)
    single = own.filter("a = b")
    pair = own.filter("a <> b")
    for side in ("a", "b"):
        general = single.select(F.col("a").alias(side), "label", "no", F.col("p").alias(f"p_{side}"))
        pair = pair.join(general, [side, "label", "no"], "left")
    pair = pair.filter(F.col("p") >= F.greatest(F.coalesce("p_a", F.lit(0.0)), F.coalesce("p_b", F.lit(0.0))) + 0.1)
    rules = single.select("a", "b", "label", "no", "p").unionByName(pair.select("a", "b", "label", "no", "p"))
    found = rules.limit(MAX_RULES * len(trainings) + 1).collect()
    if len(found) > MAX_RULES * len(trainings):
        raise ValueError(f"more than {MAX_RULES} rules; raise min_confidence or support_share")
    number = {s: i for i, s in enumerate(subjects)}
    out: list[list] = [[] for _ in trainings]
    for r in found:
        out[r.no].append(((r.a,) if r.a == r.b else (r.a, r.b), number[r.label], r.p))
    return [RuleSet(subjects, sorted(x, key=lambda r: (-r[2], r[0], r[1]))) for x in out]


def score_documents(docs: DataFrame, rules: RuleSet, least: float = 0.0) -> DataFrame:
    """``doc_id, subject, score`` of every document and class with evidence over ``least``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(rules)
        for b in batches:
            for ids, texts in portions(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc, cls, score = scorer.score(texts)
                big = score > least
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d in doc[big].tolist()], pa.int64()),
                        pa.array([rules.subjects[c] for c in cls[big].tolist()], pa.string()),
                        pa.array(score[big]),
                    ],
                    names=["doc_id", "subject", "score"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, subject string, score double")


def calibrate(rules: RuleSet, without: list[RuleSet], sample: DataFrame) -> RuleSet:
    """``rules`` with the threshold for F1 (half of the best F1, as a probability) and the map from score to probability,
    both fitted on the sample's documents as scored by the rules ``without`` their fold.  Where these give no score, ``rules`` stay as they are.
    """
    # Ids, labels and scores of the bounded sample come to the driver; its texts do not.
    labels = {r.doc_id: set(r.subjects) for r in sample.select("doc_id", "subjects").collect()}
    wanted = sum(len(v & set(rules.subjects)) for v in labels.values())
    scored: DataFrame | None = None
    for fold, held_out in enumerate(without):
        part = score_documents(sample.filter(F.col("fold") == fold), held_out)
        scored = part if scored is None else scored.unionByName(part)
    best = scored.groupBy("doc_id", "subject").agg(F.max("score").alias("score"))
    pairs = [(r.score, r.subject in labels[r.doc_id]) for r in best.collect()]
    if not any(t for _, t in pairs):
        return rules
    score, true = np.array([x for x, _ in pairs]), np.array([x for _, x in pairs])
    order = np.lexsort((~true, -score))
    score, true = score[order], true[order]
    f1 = 2 * np.cumsum(true) / (np.arange(1, len(true) + 1) + max(1, wanted))
    f1[:-1] = np.where(score[:-1] == score[1:], 0, f1[:-1])
    # Pool adjacent violators: blocks of (least score, labels, pairs) with rising shares.
    blocks: list[list[float]] = []
    for s, t in zip(score[::-1].tolist(), true[::-1].tolist()):
        blocks.append([s, float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    steps = tuple((b[0], b[1] / b[2]) for b in blocks)
    # A pair raises F1 as long as its probability is over half of the best F1.
    at = next(k for k, (_, p) in enumerate(steps) if p >= float(f1.max()) / 2)
    below = steps[at - 1][0] if at else 0.0
    last = max((s for s in score.tolist() if s < steps[at][0]), default=below)
    return RuleSet(rules.subjects, rules.rules, (last + steps[at][0]) / 2, steps)


def subject_areas(docs: DataFrame, areas: DataFrame, labels: DataFrame, max_documents: int = 6000, scores: bool = False) -> DataFrame:
    """``doc_id, subject`` (with ``score``, the calibrated probability, if asked) of the areas that each document's dispute is about.

    ``max_documents`` bounds the labelled documents from which rules are mined
    and the threshold is fitted; every document is scored, whole.  Documents
    without evidence get no row, null and empty texts neither; repeated
    documents give one row.  Without labels there are no rules and no rows.
    Subjects outside ``areas`` are ignored; ``areas`` is a short list (at most
    1,000 rows, checked).
    """
    names = [r[0] for r in areas.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1,000 subject areas")
    ship(docs.sparkSession)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = cut(labelled_sample(docs, labels, max_documents).withColumn("fold", fold))
    rules, *without = mine(sample, names)
    rules = calibrate(rules, without, sample)
    out = score_documents(docs, rules, rules.threshold)
    best = out.groupBy("doc_id", "subject").agg(F.max("score").alias("score"))
    if not scores:
        return best.drop("score")
    # The map as one literal array: the probability of the last step that the score reaches.
    steps = F.array(*[F.struct(F.lit(x).alias("from"), F.lit(p).alias("p")) for x, p in rules.steps])
    return best.withColumn("score", F.coalesce(F.array_max(F.transform(F.filter(steps, lambda s: s["from"] <= F.col("score")), lambda s: s["p"])), F.lit(0.0)))
