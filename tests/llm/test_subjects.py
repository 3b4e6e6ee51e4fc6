import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import subjects

TERMS = {"boats": ["harbour mast", "sail rope", "anchor chain", "tide table"], "bread": ["rye loaf", "oven stone", "flour sack", "yeast jar"], "bells": ["bronze bell", "tower clock", "clapper iron", "peal book"]}
NEUTRAL = ["the court has read the bundle and heard both sides", "an appeal lies only with leave", "counsel put the matter shortly", "the witness was plain and consistent"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for d in range(n):
        own = rng.sample(list(TERMS), rng.choice([0, 1, 1, 2]))
        paragraphs = []
        for s in own:
            for _ in range(2):
                a, b, c, e = (rng.choice(TERMS[s]) for _ in range(4))
                paragraphs.append(f"The {a} was lost near the {b}. Nobody asked about the {c}. They kept the {e} apart.")
        for _ in range(4):
            paragraphs.append(" ".join(x.capitalize() + "." for x in rng.sample(NEUTRAL, 3)))
        if rng.random() < 0.5:
            other = rng.choice(list(TERMS))
            paragraphs.append(f"{NEUTRAL[0]}. Counsel compared it to a {rng.choice(TERMS[other])}. {NEUTRAL[1]}. {NEUTRAL[2]}. {NEUTRAL[3]}.")
        rng.shuffle(paragraphs)
        docs.append((d, "\n\n".join(f"{i}. {p}" for i, p in enumerate(paragraphs))))
        truth[d] = set(own)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(500, 1)
    labels = [(d, s, "desk") for d in range(150) for s in truth[d]]
    labels += [(3, "nonsense", "x"), (None, "boats", "x"), (4, None, "x"), (9999, "boats", "x")] + labels[:5]
    df = spark.createDataFrame([*docs, (7000, ""), (7001, None)], "doc_id long, text string")
    areas = spark.createDataFrame([(s, "note") for s in TERMS] + [(None, "n")], "subject string, scope_note string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    found = {(r.doc_id, r.subject) for r in subjects.subject_areas(df, areas, lab).collect() if r.doc_id >= 150}
    want = {(d, s) for d in truth if d >= 150 for s in truth[d]}
    hit = len(found & want)
    assert hit / len(found) > 0.95 and hit / len(want) > 0.95


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    areas = spark.createDataFrame([("boats", "n")], "subject string, scope_note string")
    none = spark.createDataFrame([], "doc_id long, subject string, labelled_by string")
    assert subjects.subject_areas(df, areas, none).count() == 0


def test_word_reading_agrees(words):
    texts = [words(50) + ". Ünïcode Wörds-\nbroken here! A b 12 cd.", "", None, "x" * 500, "one.two three"]
    read = subjects.read_words(texts)
    for d, t in enumerate(texts):
        flat = [w for s in subjects.sentences(t or "") for w in s]
        assert [subjects.word_hash(w) for w in flat] == read.value[read.doc == d].tolist()
    assert "wordsbroken" in subjects.sentences(texts[0])[-2]
    assert len(np.unique(read.sentence[read.doc == 0])) == len(subjects.sentences(texts[0]))


def test_pairs_of_a_long_sentence_all_count(words):
    long = [f"{a}{b}{c}" for a in "bdfgk" for b in ("al", "er", "on") for c in ("ta", "mi")]
    for i, x in enumerate(long):
        for y in long[i + 1 :]:
            scorer = subjects.Scorer(subjects.RuleSet(["s"], [((x, y), 0, 0.9)] + [((w,), 0, 0.0) for w in long]))
            assert scorer.score([" ".join(long) + "."])[2].max() > 0.8


def test_scores_are_probabilities_of_held_out_documents(spark):
    docs, truth = corpus(600, 3)
    labels = [(d, s, "desk") for d in range(400) for s in truth[d]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([(s, "note") for s in TERMS], "subject string, scope_note string")
    out = subjects.subject_areas(df, areas, spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string"), scores=True).collect()
    new = [(r.score, r.subject in truth[r.doc_id]) for r in out if r.doc_id >= 400]
    assert all(0 <= p <= 1 for p, _ in new)
    assert abs(np.mean([p for p, _ in new]) - np.mean([t for _, t in new])) < 0.1


def test_calibration_rises_with_the_score():
    rules = subjects.RuleSet(["s"], [], 1.0, ((0.5, 0.1), (1.0, 0.7), (2.0, 1.0)))
    assert rules.probability(np.array([0.2, 0.5, 0.9, 1.0, 5.0])).tolist() == [0.0, 0.1, 0.1, 0.7, 1.0]


def test_typography_and_scripts_break_no_word_or_sentence():
    got = subjects.sentences('The “seller” read the œuvre – slowly. Второе слово здесь. 第二 문장 “end”.')
    assert got[0] == ["the", "seller", "read", "the", "oeuvre", "slowly"] and len(got) == 3
    assert len(got[1]) == 3 and len(set(got[1])) == 3
    long = "a" * 70 + "b"
    assert subjects.sentences(long + " " + "a" * 70 + "c") == [[long, "a" * 70 + "c"]]
    assert subjects.word_hash(long) != subjects.word_hash("a" * 70 + "c")


def test_mining_counts_by_fold(spark):
    sample = spark.createDataFrame([(d, "Rye loaf here. Plain words follow.", ["bread"] if d % 2 else ["bells"], d % subjects.FOLDS) for d in range(60)], "doc_id long, text string, subjects array<string>, fold int")
    sample = sample.withColumn("text", F.when(F.element_at("subjects", 1) == "bells", F.lit("Bronze bell here. Plain words follow.")).otherwise(F.col("text")))
    sets = subjects.mine(sample, ["bells", "bread"])
    assert len(sets) == subjects.FOLDS + 1
    for k, rules in enumerate(sets):
        own = {w: (c, p) for w, c, p in rules.rules}
        n = 30 if k == 0 else 30 - 60 // subjects.FOLDS // 2
        assert own[("rye",)] == (1, (n + 0.5) / (n + 1.5)) and own[("bell",)][0] == 0 and ("plain",) not in own and ("loaf", "rye") not in own
