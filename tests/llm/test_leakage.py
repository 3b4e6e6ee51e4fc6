import random

import numpy as np

from larkspur.llm import leakage
from larkspur.llm.letters import latin


def brute_words(item, doc):
    """Longest common subsequence of words: an upper bound of what can be found."""
    a, b = item.split(), doc.split()
    best = np.zeros(len(b) + 1, int)
    for x in a:
        row = best.copy()
        for j, y in enumerate(b):
            row[j + 1] = max(row[j], best[j + 1], best[j] + 1 if x == y else 0)
        best = row
    return best[-1]


def test_leaks_are_found_and_decoys_are_not(spark, words):
    rng = random.Random(9)
    stock = words(16)
    items = [(i, f"{stock} {words(60)}" if i % 3 == 0 else words(70)) for i in range(12)] + [(90, ""), (91, None), (92, "!!")]
    docs, want = [], set()
    for d in range(200):
        body = words(rng.randrange(50, 400)).split()
        if d % 2 == 0:
            body[10:10] = stock.split()
        if d % 4 == 1:
            i = rng.randrange(12)
            w = items[i][1].split()
            n = rng.choice([26, 30, 45])
            start = rng.randrange(16, len(w) - n)
            piece = w[start : start + n]
            for _ in range(n // 10):
                piece[rng.randrange(n)] = "[REDACTED]"
            if d % 8 == 1:
                piece[n // 2 : n // 2] = words(12).split()
            body[30:30] = [x.upper() if d % 3 else x for x in piece]
            want.add((d, i))
        elif d % 4 == 3:
            w = items[rng.randrange(12)][1].split()
            body[30:30] = w[40:50]
        text = " ".join(body)
        if d % 5 == 0:
            text = text.replace(" ", "\n", 60).replace("ba", "ba-\n", 2)
        docs.append((d, text, "x"))
    docs += [(1000, "", "x"), (1001, None, "x"), (1002, "-\n" * 1000, "x"), (1003, "a" * 300_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df.unionAll(df.limit(3)), it).collect()}
    assert found == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0


def test_alignment_never_claims_more_than_the_text_holds(words):
    rng = random.Random(2)
    item = words(60)
    index = leakage.build_index([(1, item), (2, words(60))])
    bitmap = np.zeros(1 << 22, bool)
    bitmap[leakage._slot(index.grams)] = True
    for _ in range(20):
        w = item.split()
        lo, n = rng.randrange(20), rng.randrange(20, 40)
        doc = words(40) + " " + " ".join(w[lo : lo + n]) + " " + words(40)
        got = {i: m for _, i, m in leakage.matches([doc], index, bitmap)}
        assert set(range(lo + 1, lo + n - 1)) <= set(got[0])
        assert len(got[0]) <= brute_words(item, doc) + 6


def test_codes_fold_typography():
    table = leakage.CODES
    code = lambda s: [int(c) for c in table[np.frombuffer(latin(s), np.uint8)] if c != 255]
    assert code("É, “ﬁne” 10") == code("e fine lo") and code("[…]█—\x93") == []
    assert code("œuvre Šariс “сοde”") == code("oeuvre saric code")
    assert len(set(code("бвгджзклмнптф"))) == 13 and latin("Ж", True) != latin("Ц", True)


def test_portions_hold_every_text_whole(spark, words):
    from larkspur.llm.batches import portions

    texts = ["ab" * 40, None, "", "xyz" * 100, "q"]
    got = {}
    for ids, part in portions(list(range(5)), texts, size=50, overlap=10):
        assert sum(map(len, part)) <= 50 or len(part) == 1
        for i, p in zip(ids, part):
            got[i] = p if i not in got else got[i] + p[10:]
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_leak_far_inside_a_very_long_text(spark, words):
    item = words(60)
    docs = spark.createDataFrame([(1, "z9 " * 3_000_000 + item + " z9" * 200_000)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in leakage.leaked_items(docs, items).select("doc_id", "item_id").collect()] == [(1, 5)]


def leaks(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, it).collect()}


def test_a_passage_copied_into_a_third_of_the_documents_is_no_formula(spark, words):
    stock = words(16)
    items = [(1, words(91)), (2, f"{stock} {words(75)}"), (3, words(91))]
    passage = " ".join(items[0][1].split()[40:70])
    # Copies of one text, with some scanning errors: 20 words, of which the outer ones are changed.
    torn = " ".join(items[2][1].split()[40:57])
    copy = f"{words(150)} gone {torn} gone lost {words(150)}".split()
    docs, want = [], set()
    for d in range(300):
        if d % 3 == 0:
            docs.append((d, f"{words(90)} {passage} {words(90)}"))
            want.add((d, 1))
        elif d % 3 == 1:
            docs.append((d, f"{words(90)} {stock} {words(90)}"))
        else:
            text = [*copy]
            text[d % 140] = text[200 + d % 100] = "x"
            docs.append((d, " ".join(text)))
            want.add((d, 3))
    assert leaks(spark, docs, items) == want


def test_items_that_share_their_text_are_all_found(spark, words):
    stock, half = words(16), words(40)
    near = words(70).split()
    items = [(i, f"{stock} {words(60)}") for i in range(4)]
    items += [(10, words(70)), (20, f"{half} {words(40)}"), (21, f"{words(40)} {half}"), (30, " ".join(near))]
    near[15] = near[35] = near[55] = "changed"
    items += [(31, " ".join(near)), (11, items[4][1].upper()), (12, items[4][1])]
    text = dict(items)
    docs = [(d, f"{words(60)} {piece} {words(60)}") for d, piece in enumerate((text[10], " ".join(text[10].split()[20:46]), half, text[30], text[21], stock, text[2]))]
    want = {(d, i) for d in (0, 1) for i in (10, 11, 12)} | {(d, i) for d in (2, 4) for i in (20, 21)} | {(3, 30), (3, 31), (6, 2)}
    assert leaks(spark, docs, items) == want


def test_a_longer_formula_elsewhere_does_not_hide_a_passage(spark, words):
    stock = words(19)
    item = f"{stock} {words(60)}"
    passage = " ".join(item.split()[40:57])
    docs = [(d, f"{words(60)} {stock} {words(200)}") for d in range(100)]
    docs.append((100, f"{words(60)} {stock} {words(200)} {passage} {words(60)}"))
    assert leaks(spark, docs, [(1, item), (2, words(80))]) == {(100, 1)}


def test_a_passage_interrupted_by_much_other_matter(spark, words):
    items = [(1, words(91)), (2, words(91))]
    w = [t.split() for _, t in items]
    one = f"{' '.join(w[0][40:54])} {words(50)} {' '.join(w[0][54:60])}"
    weak = [*w[1][30:40], *words(40).split(), *w[1][40:50]]
    for k in (2, 6, 52, 56):
        weak[k] = "changed"
    docs = [(0, f"{words(90)} {one} {words(90)}"), (1, f"{words(90)} {' '.join(weak)} {words(90)}")]
    index = leakage.build_index(items)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[leakage._slot(index.grams)] = True
    got = {(d, i): m for d, i, m in leakage.matches([t for _, t in docs], index, bitmap)}
    assert set(range(42, 58)) <= set(got[0, 0])
    assert leaks(spark, docs, items) == {(0, 1), (1, 2)}


def test_other_scripts(spark):
    rng = random.Random(8)
    cyrillic = lambda n: " ".join("".join(rng.choice("абвгдежзиклмнопрстуфхцчшщэюя") for _ in range(rng.randrange(4, 9))) for _ in range(n))
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [(1, cyrillic(70)), (2, han(120)), (3, cyrillic(70)), (4, han(120))]
    piece = " ".join(items[0][1].split()[20:50])
    docs = [(0, f"{cyrillic(90)} {piece.upper()} {cyrillic(90)}"), (1, han(300) + items[1][1][30:80] + han(300)), (2, cyrillic(200) + han(200))]
    assert leaks(spark, docs, items) == {(0, 1), (1, 2)}


def test_an_item_longer_than_a_piece(spark, words):
    item = words(9000)
    w = item.split()
    for k in range(50, 9000, 97):
        w[k] = "changed"
    docs = [(0, f"{words(90)} {' '.join(w)} {words(90)}"), (1, words(500))]
    assert leaks(spark, docs, [(1, item), (2, words(80))]) == {(0, 1)}
    index = leakage.build_index([(1, item)])
    bitmap = np.zeros(1 << 22, bool)
    bitmap[leakage._slot(index.grams)] = True
    assert len(leakage.matches([docs[0][1]], index, bitmap)[0][2]) > 8800


def test_recall_on_nested_and_repeated_items_and_a_passage_in_one_percent(spark, words):
    rng = random.Random(21)
    inner, plain = words(50), words(90)
    items = [(1, inner), (2, f"{words(20)} {inner} {words(20)}"), (3, plain), (4, plain), (5, words(90))]
    common = " ".join(items[4][1].split()[30:56])
    docs, want = [], set()
    for d in range(1000):
        body = words(rng.randrange(60, 160)).split()
        if d % 100 == 7:  # one percent, everywhere in other surroundings
            body[30:30] = common.split()
            want.add((d, 5))
        elif d % 50 == 3:
            start = rng.randrange(20)
            body[20:20] = inner.split()[start : start + 27]
            want |= {(d, 1), (d, 2)}
        elif d % 50 == 9:
            start = rng.randrange(50)
            body[20:20] = plain.split()[start : start + 32]
            body[20 + 11] = "changed"
            want |= {(d, 3), (d, 4)}
        docs.append((d, " ".join(body)))
    found = leaks(spark, docs, items)
    assert len(found & want) / len(want) > 0.9 and len(found & want) / len(found) > 0.99
