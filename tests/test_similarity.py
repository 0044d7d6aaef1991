"""Similarities against plain dynamic programming."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.similarity import (
    common_subsequence, indel_percent, indel_ratio, letter_counts, partial_percent, partial_ratio, shared_letters, word_similarity,
)
from lectern.operators.text_jobs import similar_words
from lectern.streaming.recitation import likeness

words = st.text(alphabet="abcd", max_size=9)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similarity(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - edits(a, b) / max(len(a), len(b))


@given(words, words)
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == lcs(a, b)


@given(words, words)
def test_likeness(a, b):
    assert likeness(a, b) == similarity(a, b)


@given(words, words)
def test_partial_is_best_window(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return
    n = len(short)
    windows = [long[max(0, i) : i + n] for i in range(-n + 1, len(long))]
    best = max(indel_percent(short, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(indel_percent(long, short[max(0, i) : i + n]) for i in range(-n + 1, n)))
    assert abs(partial_percent(a, b) - best) < 1e-9


def test_word_similarity_column(spark):
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("abc", "abd"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(word_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [similarity(a, b) for a, b in pairs]


def test_shared_letters_bound_the_subsequence(spark):
    import random

    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abcż\U0001f600 ") for _ in range(rng.randint(0, 20)))
    pairs = [(make(), make()) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", shared_letters(letter_counts(F.col("a")), letter_counts(F.col("b"))).alias("n")).collect()
    for r in got:
        assert r.n >= lcs(r.a, r.b)
        if r.a and r.b:
            assert r.n == sum((Counter(r.a) & Counter(r.b)).values())


def test_ratio_columns(spark):
    pairs = [("", ""), ("", "a"), ("abc", "xabcx"), (None, "a"), ("kitten", "sitting"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", indel_ratio("a", "b").alias("r"), partial_ratio("a", "b").alias("p")).collect()
    for r in got:
        known = r.a is not None and r.b is not None
        assert r.r == (indel_percent(r.a, r.b) if known else None) and r.p == (partial_percent(r.a, r.b) if known else None)


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_similar_words_misses_none(_):
    import random

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(500)})
    asked = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    for threshold in (0.6, 0.8):
        got = similar_words(
            spark.createDataFrame([(w,) for w in asked], "asked string"),
            spark.createDataFrame([(w,) for w in vocabulary], "word string"),
            threshold,
        ).collect()
        want = {(a, w) for a in asked for w in vocabulary if similarity(a, w) >= threshold}
        assert {(r["asked"], r["word"]) for r in got} == want
        assert len(got) == len(want)
