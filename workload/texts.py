"""Text jobs and the positional index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import parse_word_ref, split_words
from lectern.operators import index, text_jobs
from lectern.plans.corpus_tables import arabic_corpus, arabic_words, corpus_lines, corpus_words, packed_arabic
from lectern.sources.bindings import fold_accents, table
from workload.base import (
    ARABIC_VERSES, ARABIC_WORDS, SEGMENT_MARKS, WORDS, common_letters, fold, letters, norm_align, norm_search, norm_segment, sim, strip_number, tokens, trim_all, with_,
)
from lectern.functions import phonemes as ph
from lectern.functions import text as tx


def phoneme_table(spark, sf_dir):
    t = arabic_words(spark, sf_dir)  # holds the phoneme table of the corpus
    return t.select("global_pos", "text", F.array_join("phonemes", " ").alias("phonemes"), "n_phonemes", "is_muqattaat")


def phoneme_table_web(spark, sf_dir):
    t = text_jobs.phoneme_table(arabic_words(spark, sf_dir), web_form=True)
    return t.select("global_pos", F.array_join("phonemes", " ").alias("phonemes"), "n_phonemes")


def flatten_phonemes(spark, sf_dir):
    return text_jobs.phoneme_rows(arabic_words(spark, sf_dir))


def verse_phonemes(spark, sf_dir):
    return text_jobs.verse_phonemes(arabic_words(spark, sf_dir))


def _asked_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(split_words(fold_accents(F.col("text")))).alias("asked"))


def _vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(split_words(fold_accents(F.col("text")))).alias("word"))


def similar_words(spark, sf_dir):
    return text_jobs.similar_words(_asked_words(spark, sf_dir), _vocabulary(spark, sf_dir))


def indel_words(spark, sf_dir):
    return text_jobs.indel_words(_asked_words(spark, sf_dir), _vocabulary(spark, sf_dir))


def parse_refs(spark, sf_dir):
    """Every event as a word reference, every ninth one a part short."""
    e = table(spark, sf_dir, "events")
    ref = F.when(F.col("event_id") % 9 == 0, F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 9).cast("string"))).otherwise(
        F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 12 + 1).cast("string"), (F.col("event_id") % 5 + 1).cast("string"))
    )
    p = parse_word_ref(ref)
    return e.select("event_id", p["sura_no"].alias("sura_no"), p["aya_no"].alias("aya_no"), p["word_no"].alias("word_no"))


def ref_to_range(spark, sf_dir):
    """References of four shapes: word, verse, span, malformed."""
    e = table(spark, sf_dir, "events")
    u, a = F.col("user_id").cast("string"), (F.col("event_id") % 12 + 1).cast("string")
    w = (F.col("event_id") % 5 + 1).cast("string")
    one = F.concat_ws(":", u, a, w)
    two = F.concat_ws("-", F.concat_ws(":", u, F.lit("1")), one)
    k = F.col("event_id") % 4
    ref = F.when(k == 0, one).when(k == 1, F.concat_ws(":", u, a)).when(k == 2, two).otherwise(F.concat(u, F.lit(":x")))
    ranges = index.verse_ranges(corpus_words(spark, sf_dir))
    return index.ref_to_range(e.select("event_id", ref.alias("ref")), ranges)


def _windows(spark, sf_dir):
    """Windows of 1 to 14 words anywhere in the corpus, some before its start, some empty."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") * 37 - 3
    return e.select(F.col("event_id").alias("window_id"), start.alias("start_pos"), (start + F.col("event_id") % 15 - 1).alias("end_pos"))


def text_window(spark, sf_dir):
    return index.text_window(_windows(spark, sf_dir), corpus_words(spark, sf_dir)).select("window_id", "window_text")


def phoneme_window(spark, sf_dir):
    w = index.phoneme_window(_windows(spark, sf_dir), packed_arabic(spark, sf_dir))
    return w.select(
        "window_id",
        F.coalesce(F.array_join("phonemes", " "), F.lit("")).alias("phonemes"),
        F.coalesce(F.array_join(F.col("owners").cast("array<string>"), " "), F.lit("")).alias("owners"),
    )


def word_at(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(((F.col("event_id") - 5) * 41).alias("position"))
    return index.word_at(asked, corpus_words(spark, sf_dir))


def posting_chunks(spark, sf_dir):
    r = index.posting_chunks(corpus_words(spark, sf_dir))
    return r.select("norm", "chunk_no", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


QUERIES = {
    "normalize_corpus": lambda s, d: text_jobs.normalize_corpus(arabic_corpus(s, d)),
    "token_table": lambda s, d: text_jobs.token_table(arabic_corpus(s, d)),
    "phoneme_table": phoneme_table,
    "phoneme_table_web": phoneme_table_web,
    "flatten_phonemes": flatten_phonemes,
    "estimate_word_count": verse_phonemes,
    "similar_words": similar_words,
    "indel_words": indel_words,
    "parse_word_ref": parse_refs,
    "ref_to_range": ref_to_range,
    "word_index": lambda s, d: corpus_words(s, d),
    "page_word_index": lambda s, d: index.page_word_index(corpus_words(s, d)),
    "postings": lambda s, d: index.postings(corpus_words(s, d)),
    "posting_chunks": posting_chunks,
    "chapter_ranges": lambda s, d: index.chapter_ranges(corpus_words(s, d)),
    "verse_ranges": lambda s, d: index.verse_ranges(corpus_words(s, d)),
    "chapter_verse_count": lambda s, d: corpus_lines(s, d).chapter_verse_count(),
    "text_window": text_window,
    "phoneme_window": phoneme_window,
    "word_at": word_at,
}

LETTERS = ", ".join(f"('{k}', '{v}')" for k, v in ph.LETTER_PHONEMES.items())
NAMES = ", ".join(f"('{k}', '{v}')" for k, v in ph.DISCONNECTED_LETTER_NAMES.items())
NAME_KEYS = ", ".join(f"'{k}'" for k in ph.DISCONNECTED_LETTER_NAMES)
SPELLED = ", ".join(
    f"('{g}', '{' '.join(tx.LETTER_NAME_WORDS[ch] for ch in g)}')" for g in tx.OPENING_GROUPS
)


def spoken_cte(norm) -> str:
    """Phonemes of each distinct word, then of each place it stands at."""
    return f"""letters(ch, ph) AS (VALUES {LETTERS}), names(ch, name) AS (VALUES {NAMES}),
forms AS (SELECT DISTINCT text, {norm('text')} AS nf FROM words),
chars AS (SELECT text, unnest(string_split(nf, '')) AS ch, unnest(range(1, length(nf) + 1)) AS k FROM forms WHERE nf <> ''),
plain AS (SELECT text, list(ph ORDER BY k) AS p FROM chars JOIN letters USING (ch) GROUP BY text),
per_form AS (SELECT f.text, CASE WHEN length(f.text) <= 2 AND substr(f.text, 1, 1) IN ({NAME_KEYS}) AND length(nf) = 1 AND n.name IS NOT NULL
    THEN string_split(n.name, '') ELSE coalesce(p.p, []) END AS p,
  length(f.text) <= 2 AND substr(f.text, 1, 1) IN ({NAME_KEYS}) AS is_muqattaat
  FROM forms f LEFT JOIN plain p USING (text) LEFT JOIN names n ON n.ch = f.nf),
spoken AS (SELECT w.*, p, is_muqattaat, len(p) AS n_phonemes FROM words w JOIN per_form USING (text))"""


SPOKEN = f"{ARABIC_WORDS}, {spoken_cte(norm_align)}"
SPOKEN_WEB = f"{ARABIC_WORDS}, {spoken_cte(norm_search)}"
CLEAN = trim_all(f"regexp_replace(replace({strip_number('aya_text')}, '۞', ' '), '\\s+', ' ', 'g')")
PLAIN = trim_all(f"regexp_replace(regexp_replace(replace({strip_number('aya_text')}, '۞', ' '), '{SEGMENT_MARKS}', '', 'g'), '\\s+', ' ', 'g')")
NUMBER = "nullif(regexp_extract(aya_text, '([٠-٩]+)\\s*$', 1), '')"
NEAR = f"""asked AS (SELECT DISTINCT unnest({tokens(fold('text'))}) AS asked FROM benchmark),
vocab AS (SELECT DISTINCT unnest({tokens(fold('text'))}) AS word FROM conversations),
near AS (SELECT asked, word, {sim('asked', 'word')} AS similarity FROM asked JOIN vocab
  ON abs(length(asked) - length(word)) <= 0.2 * greatest(length(asked), length(word)) + 1e-9 WHERE {sim('asked', 'word')} >= 0.8)"""
WINDOWS = "windows AS (SELECT event_id AS window_id, event_id * 37 - 3 AS start_pos, event_id * 37 - 3 + event_id % 15 - 1 AS end_pos FROM events)"

ORACLES = {
    "normalize_corpus": with_(
        f"{ARABIC_VERSES}, groups(g, spelled) AS (VALUES {SPELLED}), c AS (SELECT *, {CLEAN} AS clean FROM verses), "
        f"h AS (SELECT *, regexp_extract(clean, '^(\\S+)', 1) AS head FROM c)",
        f"""SELECT id, sura_no, aya_no, clean, {PLAIN} AS plain, len({tokens('clean')}) AS n_words,
{strip_number('aya_text')} AS unnumbered, {strip_number('aya_text', True)} AS unnumbered_strict,
{NUMBER} AS number_text, try_cast(translate({NUMBER}, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS BIGINT) AS number,
coalesce({tokens(strip_number('aya_text', True))}[1], '') AS first_word,
{norm_search('aya_text')} AS search_form, {norm_align('aya_text')} AS alignment_form, {norm_segment('aya_text')} AS segment_form,
coalesce(g.spelled || substr(clean, length(head) + 1), clean) AS spelled,
contains({norm_segment('aya_text')}, 'اعوذ') OR contains({norm_segment('aya_text')}, 'أعوذ') OR contains({norm_segment('aya_text')}, 'بسم') AS special_start
FROM h LEFT JOIN groups g ON g.g = {norm_search('head')}""",
    ),
    "token_table": with_(
        ARABIC_VERSES + f", toks AS (SELECT *, {tokens(strip_number('aya_text'))} AS ws FROM verses), flat AS (SELECT id, sura_no, aya_no, unnest(ws) AS text, unnest(range(1, len(ws) + 1)) AS word_no FROM toks)",
        "SELECT id, word_no, text, sura_no || ':' || aya_no || ':' || word_no AS word_ref FROM flat",
    ),
    "phoneme_table": with_(SPOKEN, "SELECT global_pos, text, array_to_string(p, ' ') AS phonemes, n_phonemes, is_muqattaat FROM spoken"),
    "phoneme_table_web": with_(SPOKEN_WEB, "SELECT global_pos, array_to_string(p, ' ') AS phonemes, n_phonemes FROM spoken"),
    "flatten_phonemes": with_(SPOKEN, "SELECT global_pos, unnest(range(1, len(p) + 1)) AS phoneme_no, unnest(p) AS phoneme FROM spoken"),
    "estimate_word_count": with_(
        SPOKEN,
        "SELECT sura_no, aya_no, CAST(sum(n_phonemes) AS BIGINT) AS n_phonemes, count(*) AS n_words, "
        "CAST(greatest(1, least(round_even(sum(n_phonemes) / 3.0::DOUBLE, 0), 200)) AS BIGINT) AS estimated_words FROM spoken GROUP BY ALL",
    ),
    "indel_words": with_(
        f"""{NEAR},
way AS (SELECT asked, word, asked AS short, word AS long FROM near WHERE length(asked) <= length(word) UNION ALL SELECT asked, word, word, asked FROM near WHERE length(asked) >= length(word)),
pieces AS (SELECT *, unnest(list_transform(range(1, length(short) + length(long)), lambda e: substr(long, greatest(1, e - length(short) + 1)::BIGINT, least(e, length(short), length(short) + length(long) - e)::BIGINT))) AS piece FROM way),
best AS (SELECT asked, word, max(200.0::DOUBLE * {common_letters('short', letters('piece'))} / (length(short) + length(piece))) AS partial FROM pieces GROUP BY ALL)""",
        f"SELECT asked, word, 200.0::DOUBLE * {common_letters('asked', letters('word'))} / (length(asked) + length(word)) AS ratio, partial FROM near JOIN best USING (asked, word)",
    ),
    "similar_words": with_(NEAR, "SELECT asked, word, similarity, row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, word) = 1 AS is_best FROM near"),
    "parse_word_ref": """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS sura_no, CASE WHEN event_id % 9 <> 0 THEN event_id % 12 + 1 END AS aya_no,
CASE WHEN event_id % 9 <> 0 THEN event_id % 5 + 1 END AS word_no FROM events""",
    "ref_to_range": with_(
        WORDS + ", starts AS (SELECT sura_no, aya_no, min(global_pos) AS p FROM words GROUP BY ALL)",
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || ':' || (event_id % 12 + 1) || ':' || (event_id % 5 + 1) WHEN 1 THEN user_id || ':' || (event_id % 12 + 1)
  WHEN 2 THEN user_id || ':1-' || user_id || ':' || (event_id % 12 + 1) || ':' || (event_id % 5 + 1) ELSE user_id || ':x' END AS ref,
CASE event_id % 4 WHEN 0 THEN b.p + event_id % 5 WHEN 1 THEN b.p WHEN 2 THEN CASE WHEN b.p IS NOT NULL THEN a.p END END AS start_pos,
CASE event_id % 4 WHEN 0 THEN b.p + event_id % 5 WHEN 1 THEN b.p WHEN 2 THEN CASE WHEN a.p IS NOT NULL THEN b.p + event_id % 5 END END AS end_pos
FROM events e LEFT JOIN starts a ON a.sura_no = user_id AND a.aya_no = 1 LEFT JOIN starts b ON b.sura_no = user_id AND b.aya_no = event_id % 12 + 1""",
    ),
    "word_index": with_(WORDS, "SELECT * FROM words"),
    "page_word_index": with_(WORDS, "SELECT page, flat_index, word_ref, text, norm FROM words"),
    "postings": with_(WORDS, "SELECT norm, global_pos, count(*) OVER (PARTITION BY norm) AS df FROM words"),
    "posting_chunks": with_(WORDS, "SELECT norm, global_pos // 65536 AS chunk_no, string_agg(global_pos, ',' ORDER BY global_pos) AS positions FROM words GROUP BY norm, global_pos // 65536"),
    "chapter_ranges": with_(WORDS, "SELECT sura_no, min(global_pos) AS start_pos, max(global_pos) AS end_pos FROM words GROUP BY ALL"),
    "verse_ranges": with_(WORDS, "SELECT sura_no, aya_no, min(global_pos) AS start_pos, max(global_pos) AS end_pos FROM words GROUP BY ALL"),
    "chapter_verse_count": with_(WORDS, "SELECT sura_no, count(DISTINCT aya_no) AS n_verses FROM words GROUP BY ALL"),
    "text_window": with_(
        f"{WORDS}, {WINDOWS}",
        "SELECT window_id, coalesce(string_agg(text, ' ' ORDER BY global_pos), '') AS window_text FROM windows LEFT JOIN words ON global_pos BETWEEN start_pos AND end_pos GROUP BY window_id",
    ),
    "phoneme_window": with_(
        f"{SPOKEN}, {WINDOWS}, places AS (SELECT window_id, unnest(range(greatest(start_pos, 0), end_pos + 1)) AS global_pos FROM windows), "
        "hit AS (SELECT window_id, spoken.global_pos, p FROM places JOIN spoken ON spoken.global_pos = places.global_pos WHERE len(p) > 0), "
        "packed AS (SELECT window_id, string_agg(array_to_string(p, ' '), ' ' ORDER BY global_pos) AS ph, "
        "string_agg(array_to_string(list_transform(p, lambda x: global_pos), ' '), ' ' ORDER BY global_pos) AS ow FROM hit GROUP BY window_id)",
        "SELECT window_id, coalesce(ph, '') AS phonemes, coalesce(ow, '') AS owners FROM windows LEFT JOIN packed USING (window_id)",
    ),
    "word_at": with_(WORDS, "SELECT (event_id - 5) * 41 AS position, text, word_ref FROM events LEFT JOIN words ON global_pos = (event_id - 5) * 41"),
}
