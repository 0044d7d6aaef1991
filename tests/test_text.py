"""Arabic text expressions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import phonemes as ph
from lectern.functions import text as tx

FATHA, SUKUN, MADDA, SMALL_HIGH = "َ", "ْ", "ٓ", "ۖ"


def value(spark, expr_of, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(expr_of(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("كتاب ١", "كتاب"),
        ("كتاب ٢٦", "كتاب"),
        ("كتاب ١٠٠", "كتاب"),
        ("۞ وقال", "وقال"),
        ("وقال ۞ ربك", "وقال ربك"),
        ("  وقال   ربك  ", "وقال ربك"),
        ("", ""),
        ("   ", ""),
    ],
)
def test_clean(spark, text, want):
    assert value(spark, tx.clean_text, text) == want


def test_clean_diacritics(spark):
    marked = "م" + FATHA + "لك" + SUKUN + " ٣"
    assert value(spark, tx.clean_text, marked) == "م" + FATHA + "لك" + SUKUN
    assert value(spark, lambda c: tx.clean_text(c, True), marked) == "ملك"


def test_word_count_and_tokens(spark):
    assert value(spark, tx.word_count, "قال ربك لهم ١٢") == 3
    assert value(spark, tx.tokenize, "قال ربك ١٢") == ["قال", "ربك"]
    assert value(spark, tx.first_word, " قال ربك ١") == "قال"
    assert value(spark, tx.first_word, "") == ""


def test_three_normal_forms(spark):
    raw = "أَلـۖ" + MADDA + "مِ"
    assert value(spark, tx.normalize_arabic, raw) == "الم"
    assert value(spark, tx.normalize_for_alignment, raw) == "ال" + SMALL_HIGH + MADDA + "م"
    assert value(spark, tx.normalize_segment, "أَ۞ ب\t ج") == "أ ب ج"


def test_verse_numbers(spark):
    assert value(spark, tx.strip_verse_number, "قال١٢ ") == "قال"
    assert value(spark, lambda c: tx.strip_verse_number(c, True), "قال١٢") == "قال١٢"
    assert value(spark, tx.extract_verse_number, "قال ١٢ ") == "١٢"
    assert value(spark, tx.extract_verse_number, "قال") is None
    assert value(spark, tx.arabic_indic_to_int, "٢٨٦") == 286


GROUPS = {"الم": 3, "المص": 4, "الر": 3, "المر": 4, "كهيعص": 5, "طه": 2, "طسم": 3, "طس": 2, "يس": 2, "ص": 1, "حم": 2, "عسق": 3, "ق": 1, "ن": 1}


@pytest.mark.parametrize("group, parts", GROUPS.items())
def test_expand_muqattaat(spark, group, parts):
    marked = "".join(ch + FATHA for ch in group) + SMALL_HIGH
    for text in (group, marked):
        spelled = value(spark, tx.expand_muqattaat, text)
        assert len(spelled.split()) == parts
        assert spelled.split() == [tx.LETTER_NAME_WORDS[ch] for ch in group]
    assert value(spark, tx.expand_muqattaat, marked + " ذلك الكتاب").endswith(" ذلك الكتاب")


@pytest.mark.parametrize("text", ["", "هذا الم نص", "الحمد", None])
def test_expand_leaves_other_text(spark, text):
    assert value(spark, tx.expand_muqattaat, text) == text


def test_elongated_names_hold_the_expected_runs():
    for letter, run in {"ا": "أالي", "ل": "لاااا", "م": "مييي", "ص": "صاااا", "ر": "رااا", "ك": "كااا", "ع": "عييي", "ط": "طااا", "ه": "هااا", "س": "سييي", "ي": "يااا", "ح": "حااا", "ق": "قاااا", "ن": "نوووو"}.items():
        assert run in tx.LETTER_NAME_WORDS[letter]


def test_phonemes(spark):
    assert value(spark, ph.word_to_phonemes, "جصب9") == ["dʒ", "sˤ", "b"]
    assert value(spark, ph.word_to_phonemes, "أب") == ["a", "b"]
    assert value(spark, ph.word_to_phonemes, "ن" + FATHA) == list("nuːn")
    assert value(spark, ph.word_to_phonemes, "") == []
    # a small high meem survives the alignment form as an empty phoneme
    assert value(spark, ph.word_to_phonemes, "بۤت") == ["b", "", "t"]
    assert value(spark, lambda c: ph.word_to_phonemes(c, True), "بۤت") == ["b", "t"]
    assert value(spark, ph.text_to_phonemes, "بت ن") == [["b", "t"], list("nuːn")]
    flat = value(spark, lambda c: ph.flatten_phonemes(ph.text_to_phonemes(c)), "بت د")
    assert [(r["phoneme"], r["word"]) for r in flat] == [("b", 0), ("t", 0), ("d", 1)]


def test_estimate_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (1000,)], "n bigint")
    assert [r[0] for r in df.select(ph.estimate_word_count(F.col("n"), 2.0)).collect()] == [1, 1, 4, 200]


def test_word_refs(spark):
    assert tuple(value(spark, tx.parse_word_ref, "2:255:1")) == (2, 255, 1)
    assert value(spark, tx.parse_word_ref, "2:255") is None
