"""Phoneme expressions: a word becomes an array of phoneme strings.

Normalising removes every mark that would lengthen a consonant, so a word is the
plain sequence of its letters' phonemes and no vowel rule is left to apply.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import ALIGNMENT_MARKS, BARE_ALIF, HAMZA_FORMS, SEARCH_MARKS, TATWEEL, normalize_arabic, normalize_for_alignment, split_words

# --- fixed values -----------------------------------------------------------
LETTER_PHONEMES = {
    "ا": "a", "أ": "ʔ", "إ": "ʔ", "ٱ": "a", "ء": "ʔ", "آ": "ʔaː",
    "ب": "b", "ت": "t", "ث": "θ", "ج": "dʒ", "ح": "ħ", "خ": "x",
    "د": "d", "ذ": "ð", "ر": "r", "ز": "z", "س": "s", "ش": "ʃ",
    "ص": "sˤ", "ض": "dˤ", "ط": "tˤ", "ظ": "ðˤ", "ع": "ʕ", "غ": "ɣ",
    "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n",
    "ه": "h", "و": "w", "ي": "j", "ة": "h",
    "\u06E5": "uː", "\u06E6": "iː", "\u06E4": "",
    "\u0653": "ʔ", "\u0654": "ʔ", "\u0655": "ʔ", "\u0656": "a", "\u0657": "uː",
    "\u0658": "iː", "\u0659": "a", "\u065A": "u", "\u065B": "ʃ", "\u065C": "aː",
}
DISCONNECTED_LETTER_NAMES = {
    "ك": "kaːf", "م": "miːm", "ع": "ʕaːjn", "س": "siːn", "ل": "laːm",
    "ن": "nuːn", "ق": "qaːf", "ص": "sˤaːd",
    "ا": "ʔalif", "ر": "raː", "ه": "haː", "ي": "jaː", "ط": "tˤaː", "ح": "ħaː",
}
# ----------------------------------------------------------------------------


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# phonemes by code point, so that a letter's phoneme is one array access
_FIRST = min(map(ord, LETTER_PHONEMES))
_BY_CODE = [LETTER_PHONEMES.get(chr(c)) for c in range(_FIRST, max(map(ord, LETTER_PHONEMES)) + 1)]


def _spoken(norm: Column) -> Column:
    """Phonemes of the known letters, in order."""
    table = F.array(*[F.lit(p).cast("string") for p in _BY_CODE])
    return F.array_compact(
        F.transform(F.split(norm, ""), lambda ch: F.get(table, F.ascii(ch) - _FIRST))
    )


def is_muqattaat(word: Column) -> Column:
    """At most two characters, the first a disconnected letter."""
    return (F.length(word) <= 2) & F.substring(word, 1, 1).isin(*DISCONNECTED_LETTER_NAMES)


def _letters(norm: Column) -> Column:
    return F.filter(F.split(norm, ""), lambda ch: ch != "")


def word_to_phonemes(word: Column, web_form: bool = False) -> Column:
    """Phonemes of one word; unknown characters are dropped.

    A lone disconnected letter is read by its name, one phoneme per character.
    """
    norm = normalize_arabic(word) if web_form else normalize_for_alignment(word)
    names = _literal_map(DISCONNECTED_LETTER_NAMES)
    name = F.try_element_at(names, norm)
    return F.when(
        is_muqattaat(word) & (F.length(norm) == 1) & name.isNotNull(), _letters(name)
    ).otherwise(_spoken(norm))


def _ranges_of(chars) -> str:
    """Letters as the ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def _silent(web_form: bool) -> str:
    """What has no phoneme, blanks excepted; hamza forms sound as the bare alif they become."""
    dropped = f"[{TATWEEL}{ALIGNMENT_MARKS}]" if not web_form else f"{TATWEEL}|{SEARCH_MARKS}"
    heard = {c for c in [*LETTER_PHONEMES, *HAMZA_FORMS] if not re.match(dropped, c)}
    return f"[^ {_ranges_of(heard)}]"


def phoneme_count(word: Column, web_form: bool = False, heard: Column | None = None) -> Column:
    """Size of ``word_to_phonemes`` without making the phonemes; ``heard`` is the word as ``heard_letters`` leaves it."""
    norm = normalize_arabic(word) if web_form else normalize_for_alignment(word)
    names = _literal_map({k: str(len(v)) for k, v in DISCONNECTED_LETTER_NAMES.items()})
    named = F.when(is_muqattaat(word) & (F.length(norm) == 1), F.try_element_at(names, norm).cast("int"))
    heard = heard_letters(word, web_form) if heard is None else heard
    return F.coalesce(named, F.length(heard)).cast("bigint")


def heard_letters(line: Column, web_form: bool = False) -> Column:
    """Words without the letters that have no phoneme; blanks stay."""
    return F.regexp_replace(line, _silent(web_form), "")


def text_to_phonemes(text: Column, web_form: bool = False) -> Column:
    """One phoneme array per word of a text."""
    return F.transform(split_words(text), lambda w: word_to_phonemes(w, web_form))


def flatten_phonemes(per_word: Column) -> Column:
    """Array of ``(phoneme, word)`` with the 0-based index of the owning word."""
    return F.flatten(
        F.transform(
            per_word,
            lambda ps, i: F.transform(
                ps, lambda p: F.struct(p.alias("phoneme"), i.cast("bigint").alias("word"))
            ),
        )
    )


def estimate_word_count(phonemes: Column, per_word: float = 3.0) -> Column:
    """Half-to-even rounded count, kept within 1 to 200."""
    est = F.bround(phonemes / F.lit(max(per_word, 0.001)), 0)
    return F.greatest(F.lit(1), F.least(est.cast("bigint"), F.lit(200))).cast("bigint")


# numbers of phonemes, for tasks that compare them: a letter's own, then those that letters are named by
_SOUNDS = sorted({*LETTER_PHONEMES.values(), *"".join(DISCONNECTED_LETTER_NAMES.values())})
_NUMBER = {p: k for k, p in enumerate(_SOUNDS)}
_DROPPED = {*TATWEEL, *ALIGNMENT_MARKS}
_NAMED = [[_NUMBER[c] for c in name] for name in DISCONNECTED_LETTER_NAMES.values()]
_READ = np.array([*range(len(_SOUNDS)), *chain.from_iterable(_NAMED)], dtype=np.int16)
#: letters beyond the table have no phoneme and are neither dropped nor named
_END = max(map(ord, [*LETTER_PHONEMES, *_DROPPED])) + 1


def _by_code(values: dict[str, int], default: int) -> np.ndarray:
    out = np.full(_END + 1, default, dtype=np.int64)
    for letter, value in values.items():
        out[ord(letter)] = value
    return out


_HEARD = _by_code(
    {c: _NUMBER[LETTER_PHONEMES[BARE_ALIF if c in HAMZA_FORMS else c]] for c in [*LETTER_PHONEMES, *HAMZA_FORMS] if c not in _DROPPED}, -1
)
_IS_DROPPED = _by_code(dict.fromkeys(_DROPPED, 1), 0) == 1
_NAME_SIZE = _by_code(dict(zip(DISCONNECTED_LETTER_NAMES, map(len, _NAMED))), 0)
_NAME_AT = _by_code({c: len(_SOUNDS) + sum(map(len, _NAMED[:k])) for k, c in enumerate(DISCONNECTED_LETTER_NAMES)}, 0)
_BLANK = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def phoneme_numbers(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``text_to_phonemes`` of many texts as numbers, all texts in one array, and where each begins there (and the last ends)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.minimum(codes, _END)
    number = _HEARD[place]
    count = (number >= 0).astype(np.int64)
    # lone letters that are read by name: a blank or nothing before, and one after or after a mark
    lone = np.flatnonzero(_NAME_SIZE[place])
    if lone.size:
        blank = np.concatenate([np.isin(codes, _BLANK), [True, True]])
        lone = lone[blank[lone - 1] & (blank[lone + 1] | (_IS_DROPPED[place[np.minimum(lone + 1, codes.size - 1)]] & blank[lone + 2]))]
        number[lone], count[lone] = _NAME_AT[place[lone]], _NAME_SIZE[place[lone]]
    upto = np.concatenate([[0], np.cumsum(count)])
    held = np.flatnonzero(count)
    many = count[held]
    spot = np.repeat(number[held] - upto[held], many) + np.arange(upto[-1])
    return _READ[spot], upto[np.concatenate([[0], np.cumsum(size + 1)])]
