"""Shared pieces of the check SQL: the table bindings as common table expressions."""

from __future__ import annotations

from lectern.sources.bindings import (
    ACCENTED, ARABIC, LATIN, PAGES_PER_PART, UNACCENTED, VERSES_PER_PAGE,
)

DIGITS = "'0123456789', '٠١٢٣٤٥٦٧٨٩'"


def fold(c: str) -> str:
    return f"regexp_replace(translate({c}, '{ACCENTED}', '{UNACCENTED}'), '[^ -~\\t\\r\\n]', '', 'g')"


def arabic(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{ARABIC}')"


def verses_cte(as_arabic: bool = False) -> str:
    text = arabic(fold("line")) if as_arabic else fold("line")
    return f"""
docs AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
raw_lines AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS aya_no FROM docs),
num_lines AS (SELECT *, row_number() OVER (ORDER BY doc_id, aya_no) AS id FROM raw_lines),
verses AS (SELECT id, CAST(((id - 1) // {VERSES_PER_PAGE}) // {PAGES_PER_PART} + 1 AS BIGINT) AS jozz,
  CAST((id - 1) // {VERSES_PER_PAGE} + 1 AS BIGINT) AS page, doc_id AS sura_no, source AS sura_name_en,
  'S' || doc_id AS sura_name_ar, CAST(aya_no AS BIGINT) AS aya_no,
  {text} || ' ' || translate(CAST(aya_no AS VARCHAR), {DIGITS}) AS aya_text FROM num_lines)"""


def strip_number(c: str, need_space: bool = False) -> str:
    if need_space:
        return f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+[٠-٩]+$', '')"
    return f"regexp_replace(regexp_replace({c}, '\\s*[٠-٩]+\\s*$', ''), '^\\s+|\\s+$', '', 'g')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


SEARCH_MARKS = "[\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E4}\\x{06E7}-\\x{06E8}\\x{06EA}-\\x{06ED}]"
ALIGN_MARKS = "[\\x{064B}-\\x{0652}\\x{0670}\\x{0656}-\\x{065C}]"
SEGMENT_MARKS = "[\\x{064B}-\\x{0652}\\x{0670}]"


def trim_all(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def norm_search(c: str) -> str:
    return trim_all(f"regexp_replace(replace(translate({c}, 'أإآٱ', 'اااا'), 'ـ', ''), '{SEARCH_MARKS}', '', 'g')")


def norm_align(c: str) -> str:
    return trim_all(f"regexp_replace(replace(translate({c}, 'أإآٱ', 'اااا'), 'ـ', ''), '{ALIGN_MARKS}', '', 'g')")


def norm_segment(c: str) -> str:
    return trim_all(
        f"regexp_replace(regexp_replace(regexp_replace({c}, '{SEGMENT_MARKS}', '', 'g'), '[\\x{{06DD}}\\x{{06DE}}\\x{{06DF}}]', '', 'g'), '\\s+', ' ', 'g')"
    )


def words_cte(need_space: bool = False) -> str:
    return f"""
toks AS (SELECT *, {tokens(strip_number('aya_text', need_space))} AS ws FROM verses),
flat AS (SELECT id, page, sura_no, aya_no, sura_name_en, unnest(ws) AS text, unnest(range(1, len(ws) + 1)) AS word_no FROM toks),
words AS (SELECT row_number() OVER (ORDER BY id, word_no) - 1 AS global_pos, id, page, sura_no, aya_no, sura_name_en,
  CAST(word_no AS BIGINT) AS word_no, text, {norm_search('text')} AS norm,
  row_number() OVER (PARTITION BY page ORDER BY id, word_no) - 1 AS flat_index,
  sura_no || ':' || aya_no || ':' || word_no AS word_ref FROM flat)"""


VERSES = verses_cte()
ARABIC_VERSES = verses_cte(True)
WORDS = VERSES + "," + words_cte()
ARABIC_WORDS = ARABIC_VERSES + "," + words_cte(True)


def sim(a: str, b: str) -> str:
    """Word similarity; both sides are ASCII, where bytes and characters agree."""
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE END"
    )


def letters(c: str) -> str:
    return f"list_transform(range(1, length({c}) + 1), lambda i: substr({c}, i, 1))"


def common_letters(form: str, chars: str) -> str:
    """Longest common subsequence of a form of at most 60 letters and a list of letters.

    One bit a letter of the form; a bit falls to 0 where the subsequence grows.
    """
    full = f"((1::BIGINT << length({form})) - 1)"
    masks = (
        f"list_transform({chars}, lambda c: list_sum(list_transform(range(0, length({form})), "
        f"lambda p: CASE WHEN substr({form}, p + 1, 1) = c THEN 1::BIGINT << p ELSE 0::BIGINT END))::BIGINT)"
    )
    return f"(length({form}) - bit_count(list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v & ({full} - m))) & {full}, {full})))"


def with_(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body}"
