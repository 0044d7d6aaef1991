"""Text jobs over whole tables: normal forms, tokens, phonemes, similar words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import phonemes as ph
from lectern.functions import text as tx
from lectern.functions.similarity import indel_ratio, partial_ratio, word_similarity

# --- fixed values -----------------------------------------------------------
REFUGE_KEYS = ("اعوذ", "أعوذ")
OPENING_KEY = "بسم"
# ----------------------------------------------------------------------------


def special_segment_start(text: Column) -> Column:
    """Does a segment hold a keyword of the two opening formulas?"""
    return tx.contains_any(tx.normalize_segment(text), (*REFUGE_KEYS, OPENING_KEY))


def normalize_corpus(verses: DataFrame) -> DataFrame:
    """Verses with clean text, number, first word and the three normal forms."""
    raw = F.col("aya_text")
    return verses.select(
        "id", "sura_no", "aya_no",
        tx.clean_text(raw).alias("clean"),
        tx.clean_text(raw, remove_diacritics=True).alias("plain"),
        tx.word_count(raw).alias("n_words"),
        tx.strip_verse_number(raw).alias("unnumbered"),
        tx.strip_verse_number(raw, need_space=True).alias("unnumbered_strict"),
        tx.extract_verse_number(raw).alias("number_text"),
        tx.arabic_indic_to_int(tx.extract_verse_number(raw)).alias("number"),
        tx.first_word(raw).alias("first_word"),
        tx.normalize_arabic(raw).alias("search_form"),
        tx.normalize_for_alignment(raw).alias("alignment_form"),
        tx.normalize_segment(raw).alias("segment_form"),
        tx.expand_muqattaat(tx.clean_text(raw)).alias("spelled"),
        special_segment_start(raw).alias("special_start"),
    )


def token_table(verses: DataFrame, need_space: bool = False) -> DataFrame:
    """One row per word of each verse."""
    return verses.select(
        "id", "sura_no", "aya_no", F.posexplode(tx.tokenize(F.col("aya_text"), need_space)).alias("pos", "text")
    ).select(
        "id",
        (F.col("pos") + 1).cast("bigint").alias("word_no"),
        "text",
        tx.word_ref(F.col("sura_no"), F.col("aya_no"), F.col("pos") + 1).alias("word_ref"),
    )


def phoneme_table(words: DataFrame, web_form: bool = False) -> DataFrame:
    """Phonemes of each word, their number, and the disconnected-letter flag."""
    text = F.col("text")
    return words.withColumns({
        "phonemes": ph.word_to_phonemes(text, web_form),
        "n_phonemes": ph.phoneme_count(text, web_form),
        "is_muqattaat": ph.is_muqattaat(text),
    })


def phoneme_rows(spoken: DataFrame) -> DataFrame:
    """One row per phoneme with the position of its word in the corpus."""
    return spoken.select(
        "global_pos", F.posexplode("phonemes").alias("_at", "phoneme")
    ).select("global_pos", (F.col("_at") + 1).cast("bigint").alias("phoneme_no"), "phoneme")


def verse_phonemes(spoken: DataFrame, per_word: float = 3.0) -> DataFrame:
    """Phonemes per verse and the word count they suggest."""
    return spoken.groupBy("sura_no", "aya_no").agg(
        F.sum("n_phonemes").alias("n_phonemes"), F.count(F.lit(1)).alias("n_words")
    ).withColumn("estimated_words", ph.estimate_word_count(F.col("n_phonemes"), per_word))


def _edits_allowed(length: Column, threshold: float) -> tuple[Column, Column]:
    """Longest partner of a word, and the edits any partner may need."""
    longest = F.floor(length / F.lit(threshold) + F.lit(1e-9)).cast("int")
    edits = F.floor(longest * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    return longest, edits


def word_pairs(asked: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(asked, word)`` that can reach ``threshold``: none is missed.

    A word that may differ by ``d`` edits is cut into ``d + 1`` pieces; one piece
    must survive in the partner, at most ``d`` places off. Pieces are join keys.
    """
    if threshold <= 0.5:
        raise ValueError("pieces need a threshold above one half")
    n = F.length("word")
    _, edits = _edits_allowed(n, threshold)
    words = vocabulary.select("word").distinct().filter(n > 0)
    pieces = words.select("word", n.alias("len"), edits.alias("d"), F.explode(F.sequence(F.lit(0), edits)).alias("i"))
    begin = F.floor(F.col("i") * F.col("len") / (F.col("d") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("len") / (F.col("d") + 1)).cast("int")
    pieces = pieces.select("word", "len", "i", F.substr("word", begin + 1, end - begin).alias("piece"))

    m = F.length("asked")
    longest, _ = _edits_allowed(m, threshold)
    shortest = F.ceil(m * F.lit(threshold) - F.lit(1e-9)).cast("int")
    partner = asked.select("asked").distinct().filter(m > 0).select(
        "asked", m.alias("m"), F.explode(F.sequence(F.greatest(shortest, F.lit(1)), longest)).alias("len")
    )
    _, d = _edits_allowed(F.col("len"), threshold)
    partner = partner.withColumn("d", d).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    partner = partner.select("asked", "m", "len", "i", "d", begin.alias("b"), (end - begin).alias("w"))
    low = F.greatest(F.col("b") - F.col("d"), F.lit(0))
    high = F.least(F.col("b") + F.col("d"), F.col("m") - F.col("w"))
    keys = partner.filter(low <= high).select(
        "asked", "len", "i", "w", F.explode(F.sequence(low, high)).alias("at")
    ).select("asked", "len", "i", F.substr("asked", F.col("at") + 1, F.col("w")).alias("piece")).distinct()
    return keys.join(pieces, ["len", "i", "piece"]).select("asked", "word")


def similar_words(asked: DataFrame, vocabulary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Vocabulary words at least ``threshold`` similar to each asked word, best marked."""
    near = word_pairs(asked, vocabulary, threshold).withColumn(
        "similarity", word_similarity(F.col("asked"), F.col("word"))
    ).filter(F.col("similarity") >= threshold).distinct()
    best = near.groupBy("asked").agg(
        F.min_by("word", F.struct(-F.col("similarity"), F.col("word"))).alias("_best")
    )
    return near.join(best, "asked").select(
        "asked", "word", "similarity", (F.col("word") == F.col("_best")).alias("is_best")
    )


def indel_words(asked: DataFrame, vocabulary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """As ``similar_words``, with the two indel ratios of each near pair in percent."""
    near = similar_words(asked, vocabulary, threshold)
    return near.select(
        "asked", "word",
        indel_ratio("asked", "word").alias("ratio"),
        partial_ratio("asked", "word").alias("partial"),
    )
