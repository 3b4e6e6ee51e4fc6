"""Trigram similarity: scores, filters, posting lists and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.materialize import cut
from larkspur.plans.skew import hot_keys

#: Similarity from which two texts match by default.
THRESHOLD = 0.3
#: Tasks that share the texts of a common trigram.
SPLIT = 32


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the lower-cased text with two blanks at both ends; null for null."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def similarity(a: Column, b: Column | str) -> Column:
    """Jaccard similarity of the trigram sets."""
    x, y = trigrams(a), trigrams(F.lit(b) if isinstance(b, str) else b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def fuzzy_match(a: Column, b: Column | str, threshold: float = THRESHOLD) -> Column:
    return similarity(a, b) >= threshold


def posting_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """``gram, key, n_grams``: one row per distinct trigram of a text (a trigram index)."""
    x = df.select(F.col(key), trigrams(F.col(text)).alias("_g")).filter("_g IS NOT NULL")
    return x.select(F.explode("_g").alias("gram"), key, F.size("_g").alias("n_grams"))


def fuzzy_join(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``left_key, right_key, score`` of all pairs of texts with similarity of ``threshold`` or more.

    Equal texts are joined once: both sides reduce to their distinct texts, pairs
    of texts meet through a prefix of their rarest trigrams (texts of Jaccard
    ``t`` share one of the ``n - ceil(t n) + 1`` rarest, so no pair is lost), and
    exact scores come from the trigram sets.  Rows expand to keys at the end.
    A trigram that stands in a large share of the prefixes is split: one side's
    texts over ``SPLIT`` tasks, the other's copied to each.  Null texts match
    nothing.
    """
    def texts(df: DataFrame, text: str) -> DataFrame:
        return df.select(F.col(text).alias("t")).filter("t IS NOT NULL").distinct().withColumn("g", trigrams(F.col("t")))

    a, b = texts(left, left_text), texts(right, right_text)
    frequency = a.select(F.explode("g").alias("gram")).unionAll(b.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))

    def prefix(x: DataFrame, name: str) -> DataFrame:
        ranked = x.select("t", F.explode("g").alias("gram")).join(frequency, "gram").groupBy("t").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("f", "gram"))), lambda s: s.gram).alias("o")
        )
        keep = F.size("o") - F.ceil(F.lit(threshold) * F.size("o") - 1e-9) + 1
        return ranked.select(F.col("t").alias(name), F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(1), keep).cast("int"))).alias("gram"))

    left_grams, right_grams = cut(prefix(a, "ta")), prefix(b, "tb")
    hot = hot_keys(left_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "n")
    is_hot = F.col("gram").isin(hot) if hot else F.lit(False)
    left_grams = left_grams.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("ta"), F.lit(SPLIT))).otherwise(F.lit(0).cast("long")))
    copies = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right_grams = right_grams.withColumn("part", F.explode(copies))
    pairs = left_grams.join(right_grams, ["gram", "part"]).select("ta", "tb").distinct()
    scored = pairs.withColumn("score", similarity(F.col("ta"), F.col("tb"))).filter(F.col("score") >= threshold)
    l = left.select(F.col(left_key).alias("left_key"), F.col(left_text).alias("ta"))
    r = right.select(F.col(right_key).alias("right_key"), F.col(right_text).alias("tb"))
    return scored.join(l, "ta").join(r, "tb").select("left_key", "right_key", "score")


#: SQL spellings of the same expressions; a session registers them as temporary functions.
SQL_FUNCTIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION trigrams(s STRING) RETURNS ARRAY<STRING>
       RETURN array_distinct(transform(sequence(1, length(concat('  ', lower(s), '  ')) - 2), i -> substr(concat('  ', lower(s), '  '), i, 3)))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION fts_score(s STRING, p STRING) RETURNS DOUBLE
       RETURN size(array_intersect(trigrams(s), trigrams(p))) / size(array_union(trigrams(s), trigrams(p)))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION fuzzy_match(s STRING, p STRING, t DOUBLE DEFAULT 0.3) RETURNS BOOLEAN
       RETURN fts_score(s, p) >= t""",
]
