"""Phoneme numbers of tasks against the phonemes of SQL expressions."""

import random

from pyspark.sql import functions as F

from lectern.functions import phonemes
from lectern.functions.phonemes import phoneme_numbers, text_to_phonemes


def test_numbers_stand_for_the_phonemes(spark):
    rng = random.Random(3)
    letters = [*phonemes.LETTER_PHONEMES, *phonemes.HAMZA_FORMS, *phonemes._DROPPED, *phonemes.DISCONNECTED_LETTER_NAMES, " ", " ", " ", "\t", "\n", "x", "9", "\U0001f600", "￿"]
    texts = ["", " ", "ا", "اَ", "اx", "x ا", "أ", "ق والم ن", "ٓ"]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.flatten(text_to_phonemes(F.col("text"))).alias("p"))
    wanted = {r["k"]: r["p"] for r in rows.collect()}
    flat, begin = phoneme_numbers(texts)
    got = [[phonemes._SOUNDS[n] for n in flat[begin[k] : begin[k + 1]]] for k in range(len(texts))]
    assert got == [wanted[k] for k in range(len(texts))] and begin[-1] == flat.size
    assert phoneme_numbers([])[1].tolist() == [0]
