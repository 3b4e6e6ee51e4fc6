import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.llm import packing

HAVE = Path(packing.TOKENIZERS, "byte_bpe_50k.tiktoken").exists()


def check(out, sizes, capacity):
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        by_bin.setdefault(r.container, []).append(r)
    assert set(by_doc) == set(sizes)
    for d, parts in by_doc.items():
        parts.sort()
        assert [p for p, _ in parts] == list(range(len(parts))) and sum(n for _, n in parts) == sizes[d]
        assert len(parts) == max(1, -(-sizes[d] // capacity))
    for rows in by_bin.values():
        assert sum(r.n_tokens for r in rows) <= capacity and {r.fill for r in rows} == {sum(r.n_tokens for r in rows)}
    return len(by_bin)


def test_packing(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, 1, 100, 100, 2048, 4096, 5000, rng.randrange(20, 2048), rng.randrange(200, 900)]) for i in range(3500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    out = packing.pack(df, 2048).collect()
    n = check(out, sizes, 2048)
    assert n <= 1.02 * sum(sizes.values()) / 2048 + 2
    again = packing.pack(df.repartition(7), 2048).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_small_inputs(spark):
    for sizes in ({}, {1: 0}, {1: 5}, {1: 10, 2: 20, 3: 3}, {i: 7 for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
        check(packing.pack(df, 10).collect(), sizes, 10)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 0)


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    best = packing.evolve(sizes, 100, 3)
    assert sorted(i for b in best.bins for i in b) == list(range(200))
    assert all(sum(sizes[i] for i in b) == load <= 100 for b, load in zip(best.bins, best.loads))
    assert len(best.bins) <= -(-sum(sizes) // 100) + 1


@pytest.mark.skipif(not HAVE, reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "word " * 50_000), (None, "x")], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    assert sorted(map(tuple, packing.token_counts(df).collect())) == [(1, 2), (2, 0), (3, 0), (4, 50_001)]
