"""Column expressions for Arabic text: normal forms, verse numbers, tokens.

All of them are built from ``pyspark.sql.functions`` and stay in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TATWEEL = "\u0640"
HAMZA_FORMS = "أإآٱ"
BARE_ALIF = "ا"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
WESTERN_DIGITS = "0123456789"
# every mark dropped by the search form
SEARCH_MARKS = (
    "[\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E4\u06E7-\u06E8\u06EA-\u06ED]"
)
# the sixteen marks dropped by the alignment form
ALIGNMENT_MARKS = (
    "\u064B\u064C\u064D\u064E\u064F\u0650\u0651\u0652"
    "\u0670\u0656\u0657\u0658\u0659\u065A\u065B\u065C"
)
# the nine marks and three signs dropped by the segment form
SEGMENT_MARKS = "[\u064B-\u0652\u0670]"
SEGMENT_SIGNS = "[\u06DD\u06DE\u06DF]"
HIZB_SIGN = "\u06DE"
SPACES = r"(?U)\s+"
EDGE_SPACES = r"(?U)^\s+|\s+$"

# disconnected opening letters and the drawn-out names they are read with
LETTER_NAME_WORDS = {
    "ا": "أالي",
    "ل": "لاااام",
    "م": "مييييم",
    "ص": "صااااد",
    "ر": "راااا",
    "ك": "كااااف",
    "ه": "هاااا",
    "ي": "يااااا",
    "ع": "عييييين",
    "ط": "طاااا",
    "س": "سيييين",
    "ح": "حاااا",
    "ق": "قااااف",
    "ن": "نوووون",
}
OPENING_GROUPS = (
    "كهيعص", "المص", "المر", "الم", "الر", "طسم", "عسق",
    "طه", "طس", "يس", "حم", "ص", "ق", "ن",
)
# ----------------------------------------------------------------------------


def trimmed(c: Column) -> Column:
    """Drop white space of any Unicode kind at both ends."""
    return F.regexp_replace(c, EDGE_SPACES, "")


def normalize_arabic(c: Column) -> Column:
    """Search form: no tatweel, bare alif, no marks of any kind."""
    bare = F.translate(c, HAMZA_FORMS + TATWEEL, BARE_ALIF * len(HAMZA_FORMS))
    return trimmed(F.regexp_replace(bare, SEARCH_MARKS, ""))


def normalize_for_alignment(c: Column) -> Column:
    """Alignment form: as the search form, but only sixteen marks are dropped."""
    bare = F.translate(
        c, HAMZA_FORMS + TATWEEL + ALIGNMENT_MARKS, BARE_ALIF * len(HAMZA_FORMS)
    )
    return trimmed(bare)


def normalize_segment(c: Column) -> Column:
    """Segment form: nine marks and three signs dropped, spaces collapsed."""
    plain = F.regexp_replace(F.regexp_replace(c, SEGMENT_MARKS, ""), SEGMENT_SIGNS, "")
    return trimmed(F.regexp_replace(plain, SPACES, " "))


def strip_verse_number(c: Column, need_space: bool = False) -> Column:
    """Drop the Arabic-Indic number a verse ends with.

    ``need_space`` keeps a number that is glued to the last word.
    """
    if need_space:
        return F.regexp_replace(trimmed(c), r"(?U)\s+[٠-٩]+$", "")
    return trimmed(F.regexp_replace(c, r"(?U)\s*[٠-٩]+\s*$", ""))


def extract_verse_number(c: Column) -> Column:
    """Trailing Arabic-Indic digits, null when there are none."""
    found = F.regexp_extract(c, r"(?U)([٠-٩]+)\s*$", 1)
    return F.when(found != "", found)


def arabic_indic_to_int(c: Column) -> Column:
    """Arabic-Indic digits to a number, null when other characters remain."""
    return F.translate(c, ARABIC_INDIC_DIGITS, WESTERN_DIGITS).try_cast("bigint")


def int_to_arabic_indic(c: Column) -> Column:
    return F.translate(c.cast("string"), WESTERN_DIGITS, ARABIC_INDIC_DIGITS)


def split_words(c: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def tokenize(c: Column, need_space: bool = False) -> Column:
    """Words of a verse without its number."""
    return split_words(strip_verse_number(c, need_space))


def first_word(c: Column) -> Column:
    """First word of a verse, the empty string when it has none."""
    return F.coalesce(F.try_element_at(tokenize(c, True), F.lit(1)), F.lit(""))


def clean_text(c: Column, remove_diacritics: bool = False) -> Column:
    """Verse text ready for alignment: no number, no section sign, single spaces."""
    plain = F.regexp_replace(strip_verse_number(c), HIZB_SIGN, " ")
    if remove_diacritics:
        plain = F.regexp_replace(plain, SEGMENT_MARKS, "")
    return trimmed(F.regexp_replace(plain, SPACES, " "))


def word_count(c: Column) -> Column:
    return F.size(split_words(clean_text(c))).cast("bigint")


def expand_muqattaat(c: Column) -> Column:
    """Spell out the disconnected letters a text opens with.

    The longest group wins, and only a group that fills the first word counts.
    """
    head = F.regexp_extract(c, r"(?U)^(\S+)", 1)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    bare = normalize_arabic(head)
    spelled = F.lit(None).cast("string")
    for group in reversed(OPENING_GROUPS):
        words = " ".join(LETTER_NAME_WORDS[letter] for letter in group)
        spelled = F.when(bare == group, F.lit(words)).otherwise(spelled)
    return F.coalesce(F.concat(spelled, rest), c)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def parse_word_ref(c: Column) -> Column:
    """``chapter:verse:word`` to a struct of numbers, null unless three parts."""
    parts = F.split(c, ":")

    def part(i):
        return F.try_element_at(parts, F.lit(i)).try_cast("bigint")

    return F.when(
        F.size(parts) == 3,
        F.struct(part(1).alias("sura_no"), part(2).alias("aya_no"), part(3).alias("word_no")),
    )


def word_ref(sura: Column, aya: Column, word: Column) -> Column:
    return F.concat_ws(":", sura.cast("string"), aya.cast("string"), word.cast("string"))
