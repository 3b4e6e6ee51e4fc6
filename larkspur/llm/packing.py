"""Filling fixed-capacity containers with whole documents.

Documents are measured in tokens once; from then on only sizes travel.  They
are dealt into blocks by a hash.  Every block is evolved on several islands (a
task each) by a grouping genetic algorithm: a crossover injects well-filled
containers of one parent into the other, drops the containers that hold a
document twice, and best-fits the displaced documents.  After every epoch but
the last each island sends its best solution to the next one, which evolves on
with it; at the end the islands' elites meet and evolve together.  Containers
filled beyond ``SETTLED`` stand; the documents of the others are
dealt into new blocks and packed again, so poor rests of different blocks meet.
"""

from __future__ import annotations

import ast
import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.materialize import cut
from larkspur.plans.ship import ship

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Documents per block.
BLOCK = 1500
ISLANDS = 3
#: Times that the islands evolve, with a migration after each.
EPOCHS = 2
#: A container filled to this share is not opened again.
SETTLED = 0.985
_ROUNDS = 3


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens`` of every document (whole texts; null and empty texts have 0); repeats drop out."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = encoding._core_bpe.encode_ordinary if hasattr(encoding, "_core_bpe") else encoding.encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    pattern = pattern_of(folder)
    # Executors get the vocabulary from the driver, also those that start later.
    docs.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, n_tokens long").distinct()


def pattern_of(folder: str) -> str:
    """The split pattern that belongs to the vocabulary files of ``folder``."""
    with open(f"{folder}/__init__.py") as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and node.targets[0].id == "PATTERN":
                return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {folder}/__init__.py")


class Solution:
    """Containers as lists of item numbers with their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> float:
        """Mean squared fill: prefers few, full containers."""
        return sum((x / capacity) ** 2 for x in self.loads) / max(1, len(self.loads))


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> Solution:
    """Put ``items`` one by one into the fullest container that still takes them."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads))
    for i in items:
        size = sizes[i]
        k = bisect.bisect_left(free, (size, -1))
        if k < len(free):
            left, b = free.pop(k)
            bins[b].append(i)
            loads[b] += size
            bisect.insort(free, (left - size, b))
        else:
            bins.append([i])
            loads.append(size)
            bisect.insort(free, (capacity - size, len(bins) - 1))
    return Solution(bins, loads)


def cross(a: Solution, b: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Inject well-filled containers of ``b`` into ``a``; displaced items are best-fitted, largest first."""
    order = sorted(range(len(b.bins)), key=lambda k: (-b.loads[k], rng.random()))
    take = order[: max(1, int(len(order) * rng.uniform(0.2, 0.6)))]
    taken: set[int] = set()
    for k in take:
        taken.update(b.bins[k])
    bins, loads = [list(b.bins[k]) for k in take], [b.loads[k] for k in take]
    loose = []
    for items, load in zip(a.bins, a.loads):
        if taken.isdisjoint(items):
            bins.append(list(items))
            loads.append(load)
        else:
            loose += [i for i in items if i not in taken]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(bins, loads, loose, sizes, capacity)


def mutate(s: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Empty the poorest containers and a few others, and fit their items anew in a disturbed order."""
    if len(s.bins) < 2:
        return s
    poor = sorted(range(len(s.bins)), key=lambda k: s.loads[k])
    out = set(poor[: max(1, len(poor) // 12)]) | {rng.randrange(len(s.bins)) for _ in range(max(1, len(poor) // 12))}
    loose = [i for k in out for i in s.bins[k]]
    keep = [k for k in range(len(s.bins)) if k not in out]
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
    return best_fit([list(s.bins[k]) for k in keep], [s.loads[k] for k in keep], loose, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, start: list[Solution] = (), population: int = 6, generations: int = 12) -> Solution:
    """Best solution after ``generations``; deterministic in its arguments."""
    rng = random.Random(seed)
    ideal = -(-sum(sizes) // capacity)
    items = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = [*start, best_fit([], [], items, sizes, capacity)]
    while len(pool) < population:
        spread = 0.05 * len(pool)
        pool.append(best_fit([], [], sorted(items, key=lambda i: -sizes[i] * rng.uniform(1 - spread, 1)), sizes, capacity))
    score = lambda s: (-len(s.bins), s.fitness(capacity))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(pool[0].bins) <= ideal:
            break
        children = []
        for _ in range(population // 2):
            a, b = rng.sample(pool[: max(2, population * 2 // 3)], 2)
            child = cross(a, b, sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.6 else child)
        children.append(mutate(pool[0], sizes, capacity, rng))
        pool = sorted([*pool, *children], key=score, reverse=True)[:population]
    return pool[0]


def _solutions(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[Solution]]:
    """The block's items and the solutions that came with them, one per ``island`` value; all list the items alike."""
    frame, found = None, []
    for _, one in pdf.sort_values(["island", "doc_id", "piece"]).groupby("island", sort=True):
        one = one.reset_index(drop=True)
        frame = one if frame is None else frame
        n = int(one["slot"].max()) + 1
        if not n:
            continue
        bins: list[list[int]] = [[] for _ in range(n)]
        for i, b in enumerate(one["slot"].tolist()):
            bins[b].append(i)
        found.append(Solution(bins, np.bincount(one["slot"], weights=one["size"], minlength=n).astype(int).tolist()))
    return frame, found


def _island(capacity: int, epoch: int):
    """One island's epoch; it starts from its own best solution and the migrant's (``slot`` is -1 where there is none yet)."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, at = int(key[0]), int(key[1])
        frame, start = _solutions(pdf.assign(island=np.where(pdf["island"] == at, -1, pdf["island"])))
        best = evolve(frame["size"].tolist(), capacity, 1_000_003 * block + 31 * at + epoch, start, generations=12 // EPOCHS)
        slot = np.empty(len(frame), np.int64)
        for b, items in enumerate(best.bins):
            slot[items] = b
        return frame.assign(slot=slot, island=at)[["block", "island", "doc_id", "piece", "size", "slot"]]

    return run


def _meet(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frame, elite = _solutions(pdf)
        best = evolve(frame["size"].tolist(), capacity, 7919 * int(key[0]), elite, population=6, generations=10)
        slot, load = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        for b, items in enumerate(best.bins):
            slot[items], load[items] = b, best.loads[b]
        return frame.assign(slot=slot, load=load)[["block", "doc_id", "piece", "size", "slot", "load"]]

    return run


def pack(sizes: DataFrame, capacity: int, rounds: int = _ROUNDS) -> DataFrame:
    """``doc_id, piece, n_tokens, container, fill`` for ``doc_id, n_tokens`` rows.

    A document larger than ``capacity`` is cut into full pieces, each a container
    of its own, and one rest that is packed like a document; no other document is
    split.  A document of no tokens is packed too and takes no room.  ``piece``
    counts from 0.  The result is the same at every run and independent of the
    partitioning.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(sizes.sparkSession)
    c = F.col
    # Written once: measuring the documents is most of the work.
    whole = cut(sizes).withColumn("full", F.floor(c("n_tokens") / F.lit(capacity)).cast("int"))
    alone = whole.filter("full > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), c("full").cast("long") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("n_tokens")
    )
    alone = alone.select("*", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"), F.lit(capacity).cast("long").alias("fill"))
    rest = whole.select("doc_id", c("full").cast("long").alias("piece"), (c("n_tokens") - c("full") * capacity).alias("size"))
    rest = rest.filter((c("size") > 0) | (c("piece") == 0))
    done: DataFrame | None = alone
    left = cut(rest)
    for r in range(rounds):
        n = left.count()
        if n == 0:
            break
        blocks = max(1, round(n / BLOCK))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(blocks)))
        islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        schema = "block long, island int, doc_id long, piece long, size long, slot long"
        evolved = islands.withColumns({"place": c("island"), "slot": F.lit(-1).cast("long")})
        for epoch in range(EPOCHS):
            evolved = evolved.groupBy("block", "place").applyInPandas(_island(capacity, epoch), schema)
            if epoch < EPOCHS - 1:
                # Every solution stays and goes on to the next island as well.
                places = F.array(c("island"), F.pmod(c("island") + 1, F.lit(ISLANDS)))
                evolved = evolved.withColumn("place", F.explode(places))
        merged = evolved.groupBy("block").applyInPandas(_meet(capacity), "block long, doc_id long, piece long, size long, slot long, load long")
        merged = cut(merged)
        last = r == rounds - 1 or blocks == 1
        closed = merged if last else merged.filter(c("load") >= SETTLED * capacity)
        out = closed.select(
            "doc_id", "piece", c("size").alias("n_tokens"), F.concat_ws("-", F.lit(f"r{r}"), "block", "slot").alias("container"), c("load").alias("fill")
        )
        done = done.unionByName(out)
        if last:
            break
        left = merged.filter(c("load") < SETTLED * capacity).select("doc_id", "piece", "size")
    return done
