"""Matching, alignment and opening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.phonemes import phoneme_count
from lectern.functions.session import through_table
from lectern.functions.text import normalize_segment, split_words
from lectern.operators import align, locate, matching, openings, timing
from lectern.operators.text_jobs import OPENING_KEY, REFUGE_KEYS
from lectern.plans import alignment
from lectern.plans.corpus_tables import _once, arabic_corpus, arabic_words, corpus_words, packed_arabic, packed_corpus
from lectern.sources import bindings
from lectern.sources.bindings import fold_accents, table
from workload.base import ARABIC_WORDS, WORDS, common_letters, letters, norm_segment, sim, with_
from workload.timing import _segments, r3
from workload.texts import SPOKEN

REFUGE, OPENING = openings.REFUGE_FORMS[1], openings.OPENING_FORMS[2]


def chunks(spark, sf_dir):
    return _once(
        spark, sf_dir, "chunks_heard",
        lambda: bindings.recitations(packed_corpus(spark, sf_dir)).withColumnRenamed("sura_no", "session"),
    )


def segments(spark, sf_dir):
    return _once(spark, sf_dir, "segments", lambda: bindings.spoken_segments(packed_arabic(spark, sf_dir), REFUGE, OPENING))


def matches(spark, sf_dir):
    return _once(spark, sf_dir, "matches", lambda: matching.match_chunks(chunks(spark, sf_dir), packed_corpus(spark, sf_dir)))


def match_chunk(spark, sf_dir):
    return matches(spark, sf_dir).withColumn("errors", F.array_join(F.col("errors").cast("array<string>"), ","))


def match_interim(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("consumed", (F.col("chunk") % 3).cast("int"))
    return matching.match_interim(rows, packed_corpus(spark, sf_dir))


def match_word(spark, sf_dir):
    """Every word of every chunk, sought from the chunk's beginning."""
    asked = chunks(spark, sf_dir).select("session", "chunk", "page", "pointer", F.posexplode("words").alias("place", "word"))
    asked = asked.select(
        F.concat_ws(":", F.col("session").cast("string"), F.col("chunk").cast("string"), F.col("place").cast("string")).alias("ask_id"),
        "page", "pointer", "word",
    )
    return matching.match_words(asked, packed_corpus(spark, sf_dir))


def word_events(spark, sf_dir):
    return matching.word_events(matches(spark, sf_dir))


def _paged(df):
    return df.withColumn("session", F.concat_ws("/", F.col("session").cast("string"), F.col("page").cast("string")))


def recitation_result(spark, sf_dir):
    """A session is one document's recitation of one page."""
    events = _paged(word_events(spark, sf_dir)).withColumn("ts", F.col("chunk") * 1.5)
    pages = matching.page_starts(packed_corpus(spark, sf_dir)).select("page", F.col("page_words").alias("total_words"))
    totals = _paged(chunks(spark, sf_dir)).select("session", "page").distinct().join(pages, "page").select("session", "total_words")
    return matching.recitation_result(events, totals)


def reveal_state(spark, sf_dir):
    """State after each page's first chunk of its first document."""
    first = matches(spark, sf_dir).groupBy("page").agg(F.min_by(F.struct("session", "chunk", "matched_up_to", "errors"), F.struct("session", "chunk")).alias("m"))
    s = first.select(F.concat_ws("/", F.col("m.session").cast("string"), F.col("page").cast("string")).alias("session"), "page", F.col("m.matched_up_to").alias("pointer"), "m.errors", F.lit(None).cast("bigint").alias("paused_at"))
    errors = s.select("session", F.explode("errors").alias("flat_index"))
    return matching.reveal_state(s.drop("errors"), errors, packed_corpus(spark, sf_dir))


def reveal_states(spark, sf_dir):
    """State of every document's recitation of every page, after all its chunks."""
    heard = _paged(matches(spark, sf_dir))
    s = heard.groupBy("session", "page").agg(F.max("matched_up_to").alias("pointer")).withColumn("paused_at", F.lit(None).cast("bigint"))
    errors = heard.select("session", F.explode("errors").alias("flat_index"))
    return matching.reveal_state(s, errors, packed_corpus(spark, sf_dir))


def partial_basmala(spark, sf_dir):
    form = normalize_segment(F.col("text"))
    return segments(spark, sf_dir).select("recording", "segment_idx", openings.partial_basmala(form).alias("partial"))


def detect_special(spark, sf_dir):
    return openings.detect_special(segments(spark, sf_dir)).select("recording", "segment_idx", "special")


def classify(spark, sf_dir):
    return openings.classify_first_segments(segments(spark, sf_dir))


def classify_first_segments(spark, sf_dir):
    return classify(spark, sf_dir).select("recording", "segment_idx", "segment_type", "confidence")


def opening_structure(spark, sf_dir):
    return openings.opening_structure(classify(spark, sf_dir))


def muqattaat_segment(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("segment_form", normalize_segment(F.col("text")))
    return openings.muqattaat_segments(rows).select("recording", "segment_idx", "is_letters")


def insert_missing_basmala(spark, sf_dir):
    return openings.insert_missing_basmala(classify(spark, sf_dir))


def adjust_segment_times(spark, sf_dir):
    """Aligned segments, with up to two words before each taken as missing."""
    s = _segments(spark, sf_dir).withColumn("first_pos", F.greatest(F.col("start_pos") - F.col("segment_idx") % 3, F.lit(0)))
    met = packed_arabic(spark, sf_dir).slices(s.withColumnsRenamed({"start_pos": "matched_pos", "first_pos": "start_pos"}))
    at = met.withColumnRenamed("start_pos", "first_pos").withColumnRenamed("matched_pos", "start_pos").select(
        "recording", "segment_idx", "time_start", "time_end", "start_pos", "low", F.posexplode(F.split("line", " ")).alias("_pos", "_word")
    ).withColumn("global_pos", F.col("low") + F.col("_pos")).withColumn("n_phonemes", phoneme_count(F.col("_word")))
    before, n = F.col("global_pos") < F.col("start_pos"), F.col("n_phonemes")
    counted = at.groupBy("recording", "segment_idx", "time_start", "time_end").agg(
        F.coalesce(F.sum(F.when(before, n)), F.lit(0)).alias("missing_phonemes"),
        F.sum(F.when(~before, n)).alias("matched_phonemes"),
        F.max(F.when(F.col("global_pos") == F.col("start_pos"), n)).alias("first_phonemes"),
    )
    return timing.adjust_segment_times(counted).select("recording", "segment_idx", "new_start", "new_end")


def _lost(spark, sf_dir):
    """The segments no place was found for, with the pointer they were sought at."""
    failed = aligned(spark, sf_dir).filter("kind = 'failed'").select("recording", "segment_idx", "pointer")
    rows = failed.join(segments(spark, sf_dir), ["recording", "segment_idx"])
    return rows.select(
        F.concat_ws(":", F.col("recording").cast("string"), F.col("segment_idx").cast("string")).alias("ask_id"),
        "sura_no", "pointer", "text",
    )


def fuzzy_reanchor(spark, sf_dir):
    corpus = packed_arabic(spark, sf_dir)
    return align.fuzzy_reanchor(_lost(spark, sf_dir), corpus, corpus.chapter_ranges())


def match_segment(spark, sf_dir):
    """Every chunk sought six words from where it is."""
    corpus = packed_arabic(spark, sf_dir)
    ranges = corpus.chapter_ranges()
    rows = bindings.recitations(corpus).join(ranges.select("sura_no", "start_pos"), "sura_no").select(
        F.concat_ws(":", F.col("sura_no").cast("string"), F.col("chunk").cast("string")).alias("segment_id"), "sura_no",
        (F.col("start_pos") + F.col("chunk") * 8 + 6).alias("pointer"), F.array_join("words", " ").alias("text"),
    )
    return align.match_segments(rows, corpus, ranges)


def aligned(spark, sf_dir):
    return _once(spark, sf_dir, "aligned", lambda: align.align_recordings(segments(spark, sf_dir), packed_arabic(spark, sf_dir)))


def align_recording(spark, sf_dir):
    return align.with_refs(aligned(spark, sf_dir), packed_arabic(spark, sf_dir)).select(
        "recording", "segment_idx", "kind", "time_start", "time_end", "ref_start", "ref_end", "matched_text", "score", "error"
    )


def extended(spark, sf_dir):
    rows = aligned(spark, sf_dir).withColumn("sura_no", F.col("recording"))
    audio = rows.groupBy("recording").agg((F.max("time_end") + 1.5).alias("length"))
    return align.extend_trailing(rows, packed_arabic(spark, sf_dir).chapter_ranges(), audio)


def extend_trailing(spark, sf_dir):
    return extended(spark, sf_dir).select("recording", "segment_idx", "start_pos", "end_pos", "time_end", "trail_from")


def recording_verse_times(spark, sf_dir):
    """The whole way from transcript segments to verse times."""
    spans = through_table(align.aligned_verse_times(extended(spark, sf_dir), packed_arabic(spark, sf_dir)), "aligned_spans")
    return timing.repair_overlaps(timing.split_duplicate_spans(spans))


def recording_alignment(spark, sf_dir):
    """The whole way from transcript segments to alignment documents, by verse."""
    words = arabic_words(spark, sf_dir)
    rows = extended(spark, sf_dir).filter("kind = 'match'")
    timed = align.aligned_word_times(extended(spark, sf_dir), packed_arabic(spark, sf_dir))
    docs = alignment.recording_alignment(timed, rows.withColumn("sura_no", F.col("recording")), words, arabic_corpus(spark, sf_dir))
    verse = docs.select("recording", "ayah_count", F.explode("ayahs").alias("v"))
    return verse.select(
        "recording", "ayah_count", F.col("v.aya_no").alias("aya_no"), F.col("v.start_time").alias("start_time"),
        F.col("v.end_time").alias("end_time"), F.size("v.word_timings").cast("bigint").alias("n_words"),
    )


def locate_chapter(spark, sf_dir):
    """Documents sought among the benchmark passages, line by line."""
    heads = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(split_words(fold_accents(F.col("text")))).alias("pos", "text"))
    words = heads.select(F.col("item_id").alias("sura_no"), (F.col("item_id") * 100000 + F.col("pos")).alias("global_pos"), "text")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(bindings.lines_of(F.col("text"))).alias("pos", "line"))
    heard = lines.select(F.col("doc_id").alias("recording"), F.col("pos").alias("segment_idx"), fold_accents(F.col("line")).alias("text"))
    return locate.locate_chapter(heard, words)


QUERIES = {
    "match_chunk": match_chunk,
    "match_interim": match_interim,
    "match_word": match_word,
    "word_events": word_events,
    "recitation_result": recitation_result,
    "reveal_state": reveal_state,
    "reveal_states": reveal_states,
    "partial_basmala": partial_basmala,
    "detect_special": detect_special,
    "classify_first_segments": classify_first_segments,
    "opening_structure": opening_structure,
    "muqattaat_segment": muqattaat_segment,
    "insert_missing_basmala": insert_missing_basmala,
    "adjust_segment_times": adjust_segment_times,
    "match_segment": match_segment,
    "fuzzy_reanchor": fuzzy_reanchor,
    "align_recording": align_recording,
    "extend_trailing": extend_trailing,
    "recording_verse_times": recording_verse_times,
    "recording_alignment": recording_alignment,
    "locate_chapter": locate_chapter,
}


def heard_cte():
    return f"""fw AS (SELECT sura_no, min(global_pos) AS f FROM words GROUP BY sura_no),
iw AS (SELECT w.*, global_pos - f AS i FROM words w JOIN fw USING (sura_no)),
heard AS (SELECT sura_no AS session, i // 8 AS chunk, coalesce(list(CASE WHEN i % 5 = 4 THEN reverse(text) ELSE text END ORDER BY i) FILTER (i % 7 <> 6), []) AS ws,
  arg_min(page, i) AS page, arg_min(flat_index, i) AS pointer FROM iw GROUP BY ALL),
pages AS (SELECT page, count(*) AS page_words, min(global_pos) AS page_start FROM words GROUP BY page)"""


def walk_cte(window, least, skip="0"):
    """One step per spoken word; the best of the next words of the page, earliest first."""
    sims = ", ".join(
        f"CASE WHEN w.ptr + {k} < w.page_words THEN {sim('h.ws[w.step + 1]', f'a.nx[{k + 1}]')} ELSE -1.0 END" for k in range(window)
    )
    ahead = ", ".join(f"lead(norm, {k}) OVER (ORDER BY global_pos)" for k in range(window))
    return f"""ahead AS (SELECT page, flat_index, [{ahead}] AS nx FROM words),
walk(session, chunk, page, pointer, page_words, step, ptr, total, n, errors) AS (
  SELECT session, chunk, page, pointer, page_words, {skip}, pointer, 0.0::DOUBLE, 0::BIGINT, []::BIGINT[] FROM heard JOIN pages USING (page)
  UNION ALL
  SELECT session, chunk, page, pointer, page_words, step + 1,
    CASE WHEN best >= {least} THEN ptr + at_ ELSE ptr END, CASE WHEN best >= {least} THEN total + best ELSE total END, CASE WHEN best >= {least} THEN n + 1 ELSE n END,
    CASE WHEN best >= {least} THEN list_concat(errors, range(ptr, ptr + at_ - 1)) ELSE errors END
  FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS at_ FROM (
    SELECT w.*, [{sims}] AS sims FROM walk w JOIN heard h ON h.session = w.session AND h.chunk = w.chunk
    LEFT JOIN ahead a ON a.page = w.page AND a.flat_index = w.ptr WHERE w.step < len(h.ws)))),
done AS (SELECT w.* FROM walk w JOIN heard h ON h.session = w.session AND h.chunk = w.chunk WHERE w.step = greatest(len(h.ws), {skip.replace('chunk', 'h.chunk')}))"""


MATCHED = f"{WORDS}, {heard_cte()}, {walk_cte(8, 0.40)}, matched AS (SELECT *, total / n AS score FROM done WHERE n > 0)"
EVENTS = f"{MATCHED}, passed AS (SELECT session, chunk, page, errors, unnest(range(pointer, ptr)) AS flat_index FROM matched), wev AS (SELECT session, chunk, page, flat_index, CASE WHEN list_contains(errors, flat_index) THEN 'error-detected' ELSE 'word-revealed' END AS type FROM passed)"
SEGMENTS = f"""{ARABIC_WORDS}, {heard_cte()},
segs AS (SELECT session AS recording, chunk + 2 AS segment_idx, CASE WHEN chunk % 12 = 7 THEN reverse(array_to_string(ws, '')) ELSE array_to_string(ws, ' ') END AS text FROM heard
  UNION ALL SELECT DISTINCT sura_no, 0, '{REFUGE}' FROM words WHERE sura_no % 3 < 2
  UNION ALL SELECT DISTINCT sura_no, 1, CASE WHEN sura_no % 8 = 1 THEN '{' '.join(OPENING.split()[:2])}' ELSE '{OPENING}' END FROM words WHERE sura_no % 4 < 2)"""
FORM = norm_segment("text")


def _values(rows):
    return ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else f"'{c}'" for c in row) + ")" for row in rows)


_SPOKEN_FORMS = [(kind, f) for kind, forms in (("refuge", openings.REFUGE_FORMS), ("opening", openings.OPENING_FORMS)) for f in sorted({openings._plain(t) for t in forms})]
_LETTER_FORMS = [(c, f) for c, t in openings.LETTER_CHAPTERS.items() for f in sorted({openings._plain(t), *openings._plain(t).split()})]
OPENED = f"""{SEGMENTS},
formed AS (SELECT *, {FORM} AS f, segment_idx * 3.0::DOUBLE AS start, row_number() OVER (PARTITION BY recording ORDER BY segment_idx) - 1 AS position FROM segs),
forms(kind, form) AS (VALUES {_values(_SPOKEN_FORMS)}),
letter_forms(chapter, form) AS (VALUES {_values(_LETTER_FORMS)}),
tried AS (SELECT DISTINCT f, kind, form FROM formed JOIN forms ON CASE kind WHEN 'refuge' THEN {' OR '.join(f"contains(f, '{k}')" for k in REFUGE_KEYS)} ELSE contains(f, '{OPENING_KEY}') END
  UNION SELECT f, chapter || '', form FROM formed JOIN letter_forms ON chapter = recording WHERE length(f) > 0 AND length(f) <= 3 * length(form) + 5),
rated AS (SELECT f, kind, max(200.0::DOUBLE * {common_letters('form', letters('f'))} / (length(form) + length(f)) / 100.0::DOUBLE) AS r FROM tried GROUP BY ALL),
likened AS (SELECT s.*, a.r AS refuge, b.r AS opening, coalesce(c.r >= 0.5, FALSE) AS is_letters FROM formed s LEFT JOIN rated a ON a.f = s.f AND a.kind = 'refuge'
  LEFT JOIN rated b ON b.f = s.f AND b.kind = 'opening' LEFT JOIN rated c ON c.f = s.f AND c.kind = s.recording || ''),
kinds AS (SELECT *, CASE WHEN refuge >= 0.5 THEN 'isti''adha' WHEN opening >= 0.5 THEN 'basmala' END AS heard_as, {' + '.join(f"contains(f, '{w}')::INTEGER" for w in openings.OPENING_WORDS)} >= 2 AS partial FROM likened WHERE position < 4),
labelled AS (SELECT *, CASE WHEN position = 0 AND heard_as = 'isti''adha' THEN heard_as WHEN position <= 1 AND heard_as = 'basmala' THEN heard_as WHEN position <= 1 AND partial THEN 'basmala_partial'
  WHEN position <= 2 AND is_letters THEN 'muqattaat' ELSE 'ayah1' END AS t FROM kinds),
paused AS (SELECT recording, max(start + 2.5::DOUBLE) FILTER (t = 'isti''adha') AS after, min(start) FILTER (t = 'ayah1') AS before, count(*) FILTER (t IN ('basmala', 'basmala_partial')) AS n FROM labelled GROUP BY recording)"""
ADJUST = f"""{SPOKEN},
heads AS (SELECT sura_no, min(global_pos) AS first, max(global_pos) AS last FROM words GROUP BY sura_no),
seg0 AS (SELECT *, unnest(range(0, (last - first) // 9 + 1)) AS i FROM heads),
seg1 AS (SELECT sura_no AS recording, i AS segment_idx, last, first + i * 9 - CASE WHEN i % 13 = 5 THEN 9 ELSE 0 END AS start_pos, i * 4.0::DOUBLE + (i % 3) * 0.125::DOUBLE AS t0 FROM seg0),
seg AS (SELECT *, least(start_pos + 8, last) AS end_pos, t0 + 3.5::DOUBLE + (segment_idx % 5) * 0.25::DOUBLE AS t1 FROM seg1),
ph AS (SELECT recording, segment_idx, t0, t1, start_pos, unnest(range(greatest(start_pos - segment_idx % 3, 0), end_pos + 1)) AS global_pos FROM seg),
cnt AS (SELECT recording, segment_idx, t0, t1, coalesce(sum(n_phonemes) FILTER (ph.global_pos < start_pos), 0) AS miss, sum(n_phonemes) FILTER (ph.global_pos >= start_pos) AS hit,
  max(n_phonemes) FILTER (ph.global_pos = start_pos) AS fst FROM ph JOIN spoken s ON s.global_pos = ph.global_pos GROUP BY ALL),
adj AS (SELECT *, greatest(0.0::DOUBLE, t0 - CASE WHEN miss > 0 AND miss + hit > 0 THEN least(miss::DOUBLE / (miss + hit)::DOUBLE * (t1 - t0), 0.2::DOUBLE) ELSE 0.0::DOUBLE END
  - CASE WHEN fst >= 4 THEN least(0.05::DOUBLE, fst * 0.01::DOUBLE) ELSE 0.0::DOUBLE END) AS s FROM cnt)"""

ORACLES = {
    "match_chunk": with_(MATCHED, "SELECT session, chunk, page, pointer, ptr AS matched_up_to, score, coalesce(array_to_string(errors, ','), '') AS errors FROM matched", True),
    "match_interim": with_(f"{WORDS}, {heard_cte()}, {walk_cte(2, 0.45, 'chunk % 3')}", "SELECT session, chunk, page, ptr AS pointer FROM done", True),
    "match_word": with_(
        f"{WORDS}, {heard_cte()}, asked AS (SELECT session, chunk, page, pointer, page_start, page_words, unnest(ws) AS word, unnest(range(0, len(ws))) AS place FROM heard JOIN pages USING (page)), "
        f"near AS (SELECT session || ':' || chunk || ':' || place AS ask_id, w.flat_index, {sim('word', 'w.norm')} AS s FROM (SELECT *, unnest(range(pointer, least(pointer + 8, page_words))) AS fi FROM asked) a JOIN words w ON w.page = a.page AND w.flat_index = a.fi)",
        "SELECT ask_id, flat_index AS matched_index, s AS score FROM near WHERE s >= 0.40 QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY s DESC, flat_index) = 1",
    ),
    "word_events": with_(EVENTS, "SELECT * FROM wev", True),
    "recitation_result": with_(
        f"""{EVENTS}, once AS (SELECT session, page, flat_index, bool_or(type = 'error-detected') AS wrong, min(chunk) * 1.5::DOUBLE AS t0, max(chunk) * 1.5::DOUBLE AS t1 FROM wev GROUP BY ALL),
cnt AS (SELECT session, page, count(*) AS revealed, count(*) FILTER (wrong) AS ne, max(t1) - min(t0) AS duration, max(flat_index) AS lst FROM once GROUP BY ALL),
res AS (SELECT h.session || '/' || h.page AS session, page_words AS total_words, coalesce(ne, 0) AS n_errors, coalesce(lst + 1 >= page_words, FALSE) AS complete, coalesce(revealed, 0) AS revealed, coalesce(duration, 0.0) AS duration
  FROM (SELECT DISTINCT session, page FROM heard) h JOIN pages p ON p.page = h.page LEFT JOIN cnt c ON c.session = h.session AND c.page = h.page),
fin AS (SELECT *, CASE WHEN complete THEN total_words - n_errors ELSE greatest(revealed - n_errors, 0) END AS correct_words FROM res)""",
        "SELECT session, total_words, n_errors, correct_words, correct_words * 100.0::DOUBLE / total_words AS accuracy, complete, duration FROM fin", True,
    ),
    "reveal_state": with_(
        f"{MATCHED}, st AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY page ORDER BY session, chunk) = 1)",
        "SELECT session || '/' || st.page AS session, w.flat_index, word_ref, w.flat_index < ptr AS revealed, list_contains(errors, w.flat_index) AS is_error, w.flat_index = ptr AS is_current, ptr * 100.0::DOUBLE / page_words AS progress FROM st JOIN words w ON w.page = st.page", True,
    ),
    "reveal_states": with_(
        f"{MATCHED}, st AS (SELECT session, page, page_words, max(ptr) AS ptr, flatten(list(errors)) AS errors FROM matched GROUP BY session, page, page_words)",
        "SELECT session || '/' || st.page AS session, w.flat_index, word_ref, w.flat_index < ptr AS revealed, list_contains(errors, w.flat_index) AS is_error, w.flat_index = ptr AS is_current, ptr * 100.0::DOUBLE / page_words AS progress FROM st JOIN words w ON w.page = st.page", True,
    ),
    "partial_basmala": with_(SEGMENTS, "SELECT recording, segment_idx, " + " + ".join(f"contains({FORM}, '{w}')::INTEGER" for w in openings.OPENING_WORDS) + " >= 2 AS partial FROM segs"),
    "detect_special": with_(OPENED, "SELECT recording, segment_idx, CASE WHEN refuge >= 0.6 THEN 'isti''adha' WHEN opening >= 0.6 THEN 'basmala' END AS special FROM likened"),
    "muqattaat_segment": with_(OPENED, "SELECT recording, segment_idx, is_letters FROM likened"),
    "classify_first_segments": with_(
        OPENED, "SELECT recording, segment_idx, t AS segment_type, CASE t WHEN 'basmala_partial' THEN 0.7 WHEN 'muqattaat' THEN 0.85 WHEN 'ayah1' THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM labelled"
    ),
    "opening_structure": with_(
        OPENED, "SELECT recording, count(*) FILTER (t = 'isti''adha') AS n_refuge, count(*) FILTER (t IN ('basmala', 'basmala_partial')) AS n_opening, count(*) FILTER (t = 'muqattaat') AS n_letters FROM labelled GROUP BY recording"
    ),
    "insert_missing_basmala": with_(
        OPENED,
        f"""SELECT recording, recording AS sura_no, -1::BIGINT AS segment_idx, after + 0.1::DOUBLE AS start, after + 0.1::DOUBLE + least(3.0::DOUBLE, (before - after) * 0.5::DOUBLE) AS "end", '{openings.OPENING_TEXT}' AS text
FROM paused WHERE n = 0 AND recording <> 9 AND recording NOT IN ({', '.join(map(str, openings.LETTER_CHAPTERS))}) AND before - after > 2.0""",
    ),
    "adjust_segment_times": with_(ADJUST, f"SELECT recording, segment_idx, {r3('s')} AS new_start, {r3('greatest(s + 0.1::DOUBLE, t1)')} AS new_end FROM adj"),
}
