"""From aligned segments to word and verse timings, and their repair."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.folds import ordered_fold
from lectern.functions.ordering import with_neighbours
from lectern.functions.phonemes import heard_letters, phoneme_count
from lectern.functions.text import parse_word_ref, word_ref
from lectern.operators import part_words
from lectern.operators.packed import Corpus

# --- fixed values -----------------------------------------------------------
BOUNDARY_GAP = 0.3
CLOSE_GAP = 0.050
STEP = 0.001
STOLEN_SHARE = 0.30
MAX_NORMAL = 30.0
MIN_NORMAL = 2.0
SLOW_WORD = 2.0
WIDE_GAP, WIDE_RATIO = 1.0, 3.0
SHORT_NEXT, BRISK_WORDS, BRISK_WORD = 5.0, 3, 1.5
LARGE_GAP = 0.5
LONG_FIRST_WORD = 4
# ----------------------------------------------------------------------------


def round3(c: Column) -> Column:
    """Three decimals, half up, by plain double arithmetic."""
    return F.floor(c * 1000.0 + 0.5) / 1000.0


def _spoken_words(line: Column, known: Column) -> Column:
    """Words of a part and the phonemes each counts for; a place outside the corpus counts one."""
    heard = F.split(F.when(known, heard_letters(line)).otherwise(line), " ")
    one = F.lit(1).cast("bigint")
    return F.zip_with(F.split(line, " "), heard, lambda w, h: F.struct(w.alias("word"), F.when(known, phoneme_count(w, heard=h)).otherwise(one).alias("w")))


def timed_parts(segments: DataFrame, corpus: Corpus, keys: list[str]) -> DataFrame:
    """What each segment has of each verse, in a row: ``keys``, times, sura_no, aya_no, low,
    first_word_no, line, known, and the segment's words and phonemes, whole and before the part.

    Lines are shuffled, not words. A segment inside one verse is complete as it is: its phonemes
    (``total`` null) are counted with its words, and only parts of the other segments meet.
    Places outside the corpus are parts of their own.
    """
    asked = segments.filter("start_pos <= end_pos").select(*keys, "start_pos", "end_pos", "time_start", "time_end")
    inside = corpus.slices(asked).withColumn("known", F.lit(True))
    size = corpus.verses.agg(F.coalesce(F.max(F.col("start") + F.size("texts")), F.lit(0)).alias("_size"))
    nulls = {c: F.lit(None).cast("bigint") for c in ("sura_no", "aya_no", "first_word_no")}

    def outside(rows, low, high):
        rows = rows.withColumn("low", low).withColumn("n", high - F.col("low") + 1).filter("n > 0")
        return rows.withColumns(nulls | {"line": F.repeat(F.lit(" "), (F.col("n") - 1).cast("int")), "known": F.lit(False)}).select(inside.columns)

    under = outside(asked.filter("start_pos < 0"), F.col("start_pos"), F.least("end_pos", F.lit(-1)))
    over = outside(asked.join(F.broadcast(size), F.col("end_pos") >= F.col("_size")), F.greatest("start_pos", "_size"), F.col("end_pos"))
    alone = F.col("n") == F.col("end_pos") - F.col("start_pos") + 1
    parts = inside.filter(~alone).unionByName(under).unionByName(over)
    spoken = F.aggregate(_spoken_words(F.col("line"), F.col("known")), F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    parts = parts.repartition(*keys).withColumn("_w", spoken)
    whole = W.partitionBy(*keys)
    before = whole.orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({
        "total": F.sum("_w").over(whole), "words": F.sum("n").over(whole), "before": F.coalesce(F.sum("_w").over(before), F.lit(0)),
    }).drop("_w", "end_pos", "n")
    single = inside.filter(alone).withColumns({"total": F.lit(None).cast("bigint"), "words": F.col("n"), "before": F.lit(0).cast("bigint")})
    return single.select(parts.columns).unionByName(parts)


def _spoken(parts: DataFrame) -> DataFrame:
    return parts.withColumn("_ws", _spoken_words(F.col("line"), F.col("known"))).drop("line")


def _by(parts: DataFrame, *by: str) -> DataFrame:
    """Parts of a verse, or of a recording, in one place and in order; words are made there."""
    return _spoken(parts.repartition(*by).sortWithinPartitions("recording", "aya_no"))


def words_of_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A timed word in a row: a part has all that its words take, so nothing is shuffled."""
    fields = [*[(k, None) for k in keys], ("global_pos", T.LongType()), ("sura_no", T.LongType()), ("aya_no", T.LongType()), *[(f.name, f.dataType) for f in part_words.WORD]]
    return part_words.laid_out(_spoken(parts), partial(part_words.words, keys=keys), fields)


def kept_of_parts(parts: DataFrame) -> DataFrame:
    """``dedupe_word_refs`` of the words of parts of ``(recording, segment_idx)``; parts of a verse are met in one place."""
    fields = [("recording", None), ("aya_no", None), ("word_ref", T.StringType()), ("segment_idx", None), ("at", T.LongType()), ("sura_no", None)]
    return part_words.laid_out(_by(parts, "recording", "aya_no"), part_words.kept, [*fields, ("word", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType())])


def verses_of_parts(parts: DataFrame) -> DataFrame:
    """``verse_times`` of ``kept_of_parts``, with each verse's first ``word`` and its ``word_ref``; no word becomes a row."""
    fields = [("recording", None), ("aya_no", None), ("start", T.DoubleType()), ("end", T.DoubleType()), ("n_words", T.LongType())]
    return part_words.laid_out(_by(parts, "recording", "aya_no"), part_words.verses, [*fields, ("word", T.StringType()), ("word_ref", T.StringType())])


def documents_of_parts(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """``assemble_alignment`` of ``kept_of_parts`` and its verse times, without ``sura_no``.

    ``texts`` is (recording, aya_no, aya_text, sura_name_en, sura_name_ar). A document is as large as
    a chapter, so a recording's parts and texts meet in one place, and words become arrays there.
    """
    rows = parts.unionByName(texts, allowMissingColumns=True)
    fields = [("recording", None), ("sura_name_en", None), ("sura_name_ar", None), ("ayahs", T.ArrayType(part_words.VERSE)), ("ayah_count", T.LongType())]
    return part_words.laid_out(_by(rows, "recording"), part_words.documents, fields)


def _share(i: Column, w: Column, upto: Column, total: Column, n: Column) -> tuple[Column, Column]:
    """Start and end of a word that ``upto`` of its segment's ``total`` phonemes end with."""
    even = total == 0
    before = F.when(even, i).otherwise(upto - w).cast("double")
    after = F.when(even, i + 1).otherwise(upto).cast("double")
    whole = F.when(even, n).otherwise(total).cast("double")
    long = F.col("time_end") - F.col("time_start")
    return round3(F.col("time_start") + long * before / whole), round3(F.col("time_start") + long * after / whole)


def distribute_word_times(segments: DataFrame, words: Corpus | DataFrame, keys: list[str]) -> DataFrame:
    """Share a segment's time among its words by phoneme count.

    ``segments`` has ``keys``, ``start_pos``, ``end_pos``, ``time_start``, ``time_end``;
    positions outside the corpus count one phoneme; if no word has any, time is shared
    evenly. Times come from whole phoneme counts, so they do not depend on the order
    of summation. A packed corpus is met verse by verse, word rows word by word.
    """
    if isinstance(words, Corpus):
        return words_of_parts(timed_parts(segments, words, keys), keys)
    asked = segments.filter("start_pos <= end_pos").withColumn(
        "global_pos", F.explode(F.sequence("start_pos", "end_pos"))
    )
    known = words.select("global_pos", "text", "word_ref", "sura_no", "aya_no", "n_phonemes")
    hits = asked.join(known, "global_pos", "left").withColumn(
        "_w", F.coalesce(F.col("n_phonemes"), F.lit(1)).cast("bigint")
    )
    whole = W.partitionBy(*keys)
    so_far = whole.orderBy("global_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    shares = (
        hits.withColumn("_total", F.sum("_w").over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_upto", F.sum("_w").over(so_far))
    )
    start, end = _share(F.col("global_pos") - F.col("start_pos"), F.col("_w"), F.col("_upto"), F.col("_total"), F.col("_n"))
    return shares.select(
        *keys, "global_pos", "sura_no", "aya_no",
        F.coalesce("text", F.lit("")).alias("word"),
        F.coalesce("word_ref", F.lit("")).alias("word_ref"),
        start.alias("start"), end.alias("end"),
    )


def first_verses(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Verse that each segment begins in, by its first word; null outside the corpus."""
    at = words.select(F.col("global_pos").alias("start_pos"), F.col("aya_no").alias("first_aya"))
    return segments.join(at, "start_pos", "left").select("recording", "segment_idx", "time_start", "time_end", "first_aya")


def verse_of_words(word_times: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Timed words with the verse their reference names.

    A word without reference belongs to the first verse of its segment; one whose reference
    names no verse, and one of a segment that begins outside the corpus, is left out.
    """
    first = first_verses(segments, words).select("recording", "segment_idx", "first_aya")
    named = word_times.drop("aya_no").join(first, ["recording", "segment_idx"], "left")
    verse = F.when(F.col("word_ref") == "", F.col("first_aya")).otherwise(parse_word_ref(F.col("word_ref"))["aya_no"])
    return named.withColumn("aya_no", verse).filter("aya_no IS NOT NULL").drop("first_aya")


def bare_boundaries(segments: DataFrame, word_times: DataFrame, words: DataFrame) -> DataFrame:
    """Whole segments as spans of the verses at both ends of those with too few named words.

    Only segments of several verses with fewer than two words that carry a reference count;
    the longest such segment stands for a verse.
    """
    at = words.select(F.col("global_pos").alias("end_pos"), F.col("aya_no").alias("last_aya"))
    ends = segments.join(at, "end_pos", "left").select("recording", "segment_idx", "last_aya")
    several = first_verses(segments, words).join(ends, ["recording", "segment_idx"]).filter("last_aya > first_aya")
    named = word_times.filter("word_ref <> ''").groupBy("recording", "segment_idx").agg(F.count(F.lit(1)).alias("_n"))
    few = several.join(named, ["recording", "segment_idx"]).filter("_n < 2")
    sides = few.select("recording", "time_start", "time_end", F.explode(F.array("first_aya", "last_aya")).alias("aya_no"))
    longest = F.max_by(F.struct("time_start", "time_end"), F.struct(F.col("time_end") - F.col("time_start"), -F.col("time_start")))
    return sides.groupBy("recording", "aya_no").agg(longest.alias("s")).select(
        "recording", "aya_no", F.col("s.time_start").alias("start"), F.col("s.time_end").alias("end")
    )


def words_of_interpolated(spans: DataFrame, expected: DataFrame, words: DataFrame) -> DataFrame:
    """Word timings of interpolated verses: the verse's own words share its span.

    ``expected`` names each recording's ``sura_no``. Verses that the corpus lacks get none.
    """
    places = words.groupBy("sura_no", "aya_no").agg(F.min("global_pos").alias("start_pos"), F.max("global_pos").alias("end_pos"))
    asked = spans.filter("interpolated").join(expected.select("recording", "sura_no"), "recording").join(places, ["sura_no", "aya_no"])
    asked = asked.select(
        "recording", F.col("aya_no").alias("verse"), "start_pos", "end_pos",
        F.col("start").alias("time_start"), F.col("end").alias("time_end"),
    )
    timed = distribute_word_times(asked, words, ["recording", "verse"])
    return timed.select(
        "recording", F.col("verse").alias("aya_no"), F.lit(None).cast("bigint").alias("segment_idx"),
        F.col("global_pos").alias("at"), "word", "word_ref", "start", "end",
    )


def dedupe_word_refs(word_times: DataFrame) -> DataFrame:
    """Earliest timing of each word of a verse; words without reference all stay."""
    named = word_times.filter("word_ref <> ''")
    cols = [c for c in word_times.columns if c not in ("recording", "aya_no", "word_ref")]
    order = F.struct("start", "segment_idx", "at")
    kept = named.groupBy("recording", "aya_no", "word_ref").agg(
        F.min_by(F.struct(*cols), order).alias("w")
    ).select("recording", "aya_no", "word_ref", *[F.col("w")[c].alias(c) for c in cols])
    return kept.unionByName(word_times.filter("word_ref = ''").select(kept.columns))


def verse_times(word_times: DataFrame) -> DataFrame:
    """Start of a verse's first word and end of its last-starting word."""
    order = F.struct("start", "segment_idx", "at")
    return word_times.groupBy("recording", "aya_no").agg(
        F.min("start").alias("start"), F.max_by("end", order).alias("end"),
        F.count(F.lit(1)).alias("n_words"),
    )


def gap_boundaries(word_times: DataFrame, threshold: float = BOUNDARY_GAP) -> DataFrame:
    """Verse spans inside segments that hold several verses.

    A verse ends with its last word, or in the middle of the first pause longer than
    ``threshold`` that falls among its share of the words.
    """
    seg = ["recording", "segment_idx"]
    many = word_times.groupBy(*seg).agg(
        F.min("aya_no").alias("_a"), F.max("aya_no").alias("_b")
    ).filter("_a < _b")
    rows = word_times.join(many.select(*seg), seg)
    by_time = W.partitionBy(*seg).orderBy("start", "at")
    timed = rows.withColumn("_i", F.row_number().over(by_time) - 1).withColumn(
        "_gap", F.lead("start").over(by_time) - F.col("end")
    )
    verses = timed.groupBy(*seg, "aya_no").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("start", "_i").alias("start"),
        F.max_by("end", "_i").alias("_last"),
    )
    offset = F.sum("_n").over(
        W.partitionBy(*seg).orderBy("aya_no").rowsBetween(W.unboundedPreceding, -1)
    )
    verses = verses.withColumn("_from", F.coalesce(offset, F.lit(0)))
    pauses = timed.filter(F.col("_gap") > threshold).select(
        *seg, F.col("_i").alias("_p"), (F.col("end") + F.col("_gap") / 2).alias("_mid")
    )
    inside = verses.join(pauses, seg, "left").filter(
        "_p IS NULL OR (_p >= _from AND _p < _from + _n)"
    )
    ends = inside.groupBy(*seg, "aya_no").agg(F.min_by("_mid", "_p").alias("_cut"))
    return verses.join(ends, [*seg, "aya_no"], "left").select(
        *seg, "aya_no", "start", F.coalesce("_cut", "_last").alias("end")
    )


def split_duplicate_spans(spans: DataFrame) -> DataFrame:
    """Verses of a recording with one and the same span share it out.

    The earlier verse keeps the first half, the later one the second. Halves can
    coincide with yet another verse, so verses are taken in order; only spans that
    are, or can come to be, the same as another take part. Finding those runs a small
    job per round, so give it a table, not a long plan.
    """
    sig = F.struct(round3(F.col("start")).alias("s"), round3(F.col("end")).alias("e"))
    rows = spans.withColumn("_sig", sig)
    counted = rows.groupBy("recording", "_sig").agg(F.count(F.lit(1)).alias("_n"))
    present = counted.select("recording", "_sig")

    def halves(sigs: DataFrame) -> DataFrame:
        s, e = F.col("_sig.s"), F.col("_sig.e")
        mid = s + (e - s) / 2
        left = F.struct(s.alias("s"), round3(mid - STEP).alias("e"))
        right = F.struct(round3(mid).alias("s"), e.alias("e"))
        return sigs.select("recording", F.explode(F.array(left, right)).alias("_sig")).distinct()

    family = front = counted.filter("_n > 1").select("recording", "_sig")
    # each round halves the spans, so a few rounds reach the last coincidence
    while True:
        front = (
            halves(front).join(present, ["recording", "_sig"], "left_semi")
            .join(family, ["recording", "_sig"], "left_anti")
        )
        if front.isEmpty():
            break
        family = family.unionByName(front)

    taking_part = rows.join(family, ["recording", "_sig"], "left_semi").drop("_sig")

    def start():
        return {"owner": {}, "span": {}}

    def r3(x):
        return float(int((x * 1000.0 + 0.5) // 1)) / 1000.0

    def step(state, row):
        aya, span = row["aya_no"], [row["start"], row["end"]]
        key = (r3(span[0]), r3(span[1]))
        out = []
        if key in state["owner"]:
            other, other_start = state["owner"][key]
            mid = key[0] + (key[1] - key[0]) / 2
            out = [(other, None, mid - STEP, aya), (aya, mid, None, aya)]
            state["owner"][(r3(other_start), r3(mid - STEP))] = (other, other_start)
            state["owner"][(r3(mid), key[1])] = (aya, mid)
        else:
            state["owner"][key] = (aya, span[0])
        return out

    moves = ordered_fold(
        taking_part, ["recording"], ["aya_no"], start, step,
        "aya_no bigint, new_start double, new_end double, moved_at bigint",
    )
    last = moves.groupBy("recording", "aya_no").agg(
        F.max_by("new_start", F.when(F.col("new_start").isNotNull(), F.col("moved_at"))).alias("_s"),
        F.max_by("new_end", F.when(F.col("new_end").isNotNull(), F.col("moved_at"))).alias("_e"),
    )
    return spans.join(last, ["recording", "aya_no"], "left").withColumns(
        {"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end")}
    ).select(spans.columns)


def repair_overlaps(spans: DataFrame) -> DataFrame:
    """Make neighbouring verses meet: halve overlaps, close pauses.

    Each boundary depends on the end before it and the start after it as they were
    given, so all boundaries move at once.
    """
    near = with_neighbours(spans, ["recording"], "aya_no", ["start"])
    near = with_neighbours(near, ["recording"], "aya_no", ["end"], previous=True)
    end, after, start, before = (F.col(c) for c in ("end", "next_start", "start", "prev_end"))
    new_end = (
        F.when(after < end, (end + after) / 2 - STEP)
        .when(after > end + CLOSE_GAP, after - STEP)
        .otherwise(end)
    )
    new_start = (
        F.when(start < before, (before + start) / 2 + STEP)
        .when(start > before + CLOSE_GAP, start)
        .when(before.isNotNull(), before + STEP)
        .otherwise(start)
    )
    return near.withColumns({"start": new_start, "end": new_end}).select(spans.columns)


def missing_verses(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Verse numbers 1 to ``n_verses`` that a recording lacks."""
    wanted = expected.select("recording", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_verses")).alias("aya_no"))
    return wanted.join(spans, ["recording", "aya_no"], "left_anti")


def interpolate_missing(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Give missing verses a time: the pause they fall in, or a share of a neighbour.

    A run of missing verses depends only on the verses around it. The first takes the
    pause, or 30 % of the verse before (of the verse after, at the head); each further
    one takes 30 % of the one before. Verses before a run lose what was taken.
    """
    bounded = with_neighbours(spans, ["recording"], "aya_no", ["aya_no", "start"])
    bounded = bounded.join(expected.select("recording", "n_verses"), "recording", "left")
    last = F.least(F.col("next_aya_no"), F.greatest(F.col("n_verses") + 1, F.col("aya_no") + 1))
    heads = spans.groupBy("recording").agg(
        F.min_by(F.struct("aya_no", "start", "end"), "aya_no").alias("h")
    )
    # what a head run takes from the first verse present
    head = heads.select(
        "recording", F.col("h.aya_no").alias("_h"),
        F.col("h.start").alias("_hs"),
        (F.col("h.start") + (F.col("h.end") - F.col("h.start")) * STOLEN_SHARE).alias("_he"),
    )
    shifted = bounded.join(head, "recording").withColumn(
        "start", F.when((F.col("aya_no") == F.col("_h")) & (F.col("_h") > 1), F.col("_he")).otherwise(F.col("start"))
    )
    size = (last - F.col("aya_no") - 1).cast("int")
    pause = F.col("next_start").isNotNull() & (F.col("next_start") > F.col("end"))
    took = F.col("end") - (F.col("end") - F.col("start")) * STOLEN_SHARE
    runs = shifted.withColumns(
        {
            "_size": size,
            "_from": F.when(pause, F.col("end")).otherwise(took),
            "_to": F.when(pause, F.col("next_start")).otherwise(F.col("end")),
            "_keeps": F.when((size > 0) & ~pause, took).otherwise(F.col("end")),
        }
    )
    present = runs.select("recording", "aya_no", "start", F.col("_keeps").alias("end"), F.lit(False).alias("interpolated"))
    inner = runs.filter("_size > 0").select("recording", F.col("aya_no").alias("_base"), "_size", "_from", "_to", F.col("next_start").alias("_next"))
    front = head.filter("_h > 1").select(
        "recording", F.lit(0).cast("bigint").alias("_base"), (F.col("_h") - 1).cast("int").alias("_size"),
        F.col("_hs").alias("_from"), F.col("_he").alias("_to"), F.col("_he").alias("_next"),
    )

    def share(acc, _i):
        """Cut 30 % off the verse last placed, unless rounding left a pause after it."""
        s, e = acc["s"], acc["e"]
        rest = F.col("_next") > e
        cut = F.when(rest, e).otherwise(e - (e - s) * STOLEN_SHARE)
        return F.struct(
            round3(cut).alias("s"),
            F.when(rest, round3(F.col("_next"))).otherwise(e).alias("e"),
            F.array_append(acc["done"], F.struct(s.alias("s"), cut.alias("e"))).alias("done"),
        )

    zero = F.struct(
        round3(F.col("_from")).alias("s"), round3(F.col("_to")).alias("e"),
        F.array().cast("array<struct<s:double,e:double>>").alias("done"),
    )
    placed = inner.unionByName(front).withColumn(
        "_p",
        F.aggregate(
            F.when(F.col("_size") > 1, F.sequence(F.lit(2), F.col("_size"))).otherwise(F.array().cast("array<int>")),
            zero, share,
            lambda a: F.array_append(a["done"], F.struct(a["s"].alias("s"), a["e"].alias("e"))),
        ),
    )
    filled = placed.select("recording", "_base", F.posexplode("_p").alias("_k", "_v")).select(
        "recording", (F.col("_base") + F.col("_k") + 1).alias("aya_no"),
        F.col("_v.s").alias("start"), F.col("_v.e").alias("end"), F.lit(True).alias("interpolated"),
    )
    return present.unionByName(filled)


def flag_durations(spans: DataFrame) -> DataFrame:
    """Suspiciously long verses, and short ones right after a long one."""
    near = with_neighbours(spans, ["recording"], "aya_no", ["start", "end"], previous=True)
    length = F.col("end") - F.col("start")
    before = F.col("prev_end") - F.col("prev_start")
    flag = (
        F.when(F.col("n_words") == 0, F.lit(None))
        .when((length > MAX_NORMAL) & (length / F.col("n_words") > SLOW_WORD), "long")
        .when((length < MIN_NORMAL) & (before > MAX_NORMAL), "short-after-long")
    )
    return near.select("recording", "aya_no", flag.alias("flag")).filter("flag IS NOT NULL")


def word_gaps(word_times: DataFrame) -> DataFrame:
    """Per verse: words, verses named by them, and the widest pause with its middle."""
    by_time = W.partitionBy("recording", "aya_no").orderBy("start", "at")
    timed = word_times.withColumn("_i", F.row_number().over(by_time)).withColumn(
        "_next", F.lead("start").over(by_time)
    ).withColumn("_gap", F.col("_next") - F.col("end"))
    named = F.when(F.col("word_ref") != "", F.split_part("word_ref", F.lit(":"), F.lit(2)))
    return timed.groupBy("recording", "aya_no").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.count_distinct(named).alias("n_named"),
        F.max_by(
            F.struct(F.col("_gap").alias("gap"), ((F.col("end") + F.col("_next")) / 2).alias("mid")),
            F.when(F.col("_gap") > 0, F.struct("_gap", -F.col("_i"))),
        ).alias("widest"),
    ).select(
        "recording", "aya_no", "n_words", "n_named",
        F.col("widest.gap").alias("gap"), F.col("widest.mid").alias("mid"),
    )


def repair_durations(spans: DataFrame, word_times: DataFrame) -> DataFrame:
    """Move the end of overlong verses with foreign words into their widest pause.

    The verse after must be short; it then starts where this one ends. A verse's start
    may have moved by the one before, so candidates are taken in order.
    """
    gaps = word_gaps(word_times)
    rows = spans.select("recording", "aya_no", "start", "end").join(
        gaps, ["recording", "aya_no"], "left"
    ).withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    near = with_neighbours(rows, ["recording"], "aya_no", ["aya_no", "start", "end", "n_words"])
    able = near.filter("n_named > 1 AND gap IS NOT NULL AND next_aya_no IS NOT NULL")

    def start():
        return {}

    def step(state, row):
        begin = state.pop(row["aya_no"], row["start"])
        state.clear()
        length = row["end"] - begin
        pace = length / row["n_words"]
        if not (length > MAX_NORMAL and pace > SLOW_WORD):
            return []
        end, after = row["end"], row["next_start"]
        left = row["next_end"] - after
        short = left < SHORT_NEXT or (
            row["next_n_words"] > BRISK_WORDS and left / row["next_n_words"] < BRISK_WORD
        )
        moved = False
        if row["gap"] > WIDE_GAP and row["gap"] > pace * WIDE_RATIO and short and row["mid"] < end:
            end = after = row["mid"]
            moved = True
        if row["gap"] > LARGE_GAP and row["next_end"] - after < MIN_NORMAL:
            end = after = row["mid"]
            moved = True
        if not moved:
            return []
        nxt = row["next_aya_no"]
        state[nxt] = after
        return [(row["aya_no"], None, end), (nxt, after, None)]

    moves = ordered_fold(
        able, ["recording"], ["aya_no"], start, step, "aya_no bigint, new_start double, new_end double"
    )
    new = moves.groupBy("recording", "aya_no").agg(
        F.max("new_start").alias("_s"), F.max("new_end").alias("_e")
    )
    return spans.join(new, ["recording", "aya_no"], "left").withColumns(
        {"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end")}
    ).select(spans.columns)


def adjust_segment_times(matches: DataFrame) -> DataFrame:
    """Start a matched segment a little earlier when words are missing before it.

    Needs ``missing_phonemes``, ``matched_phonemes`` and ``first_phonemes``.
    """
    missing, total = F.col("missing_phonemes"), F.col("missing_phonemes") + F.col("matched_phonemes")
    long = F.col("time_end") - F.col("time_start")
    shift = F.when(
        (missing > 0) & (total > 0),
        F.least(missing.cast("double") / total.cast("double") * long, F.lit(0.2)),
    ).otherwise(0.0)
    onset = F.when(
        F.col("first_phonemes") >= LONG_FIRST_WORD, F.least(F.lit(0.05), F.col("first_phonemes") * 0.01)
    ).otherwise(0.0)
    start = F.greatest(F.lit(0.0), F.col("time_start") - shift - onset)
    end = F.greatest(start + 0.1, F.col("time_end"))
    return matches.withColumns({"new_start": round3(start), "new_end": round3(end)})


def assemble_alignment(
    spans: DataFrame, word_times: DataFrame, verses: DataFrame, specials: DataFrame | None = None
) -> DataFrame:
    """One nested document per recording, verses and words in order.

    ``spans`` is ``(recording, sura_no, aya_no, start, end)``; a document is the unit of
    output, as large as one chapter.
    """
    words = word_times.groupBy("recording", "aya_no").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "end", "word", "word_ref"))).alias("ws")
    )
    texts = verses.select("sura_no", "aya_no", "aya_text", "sura_name_en", "sura_name_ar")
    rows = spans.join(words, ["recording", "aya_no"], "left").join(texts, ["sura_no", "aya_no"], "left")
    word_structs = F.transform(
        F.coalesce("ws", F.array().cast("array<struct<start:double,at:bigint,end:double,word:string,word_ref:string>>")),
        lambda w: F.struct(w["word"].alias("word"), w["word_ref"].alias("word_ref"), w["start"].alias("start"), w["end"].alias("end")),
    )
    verse = F.struct(
        "aya_no", F.coalesce("aya_text", F.lit("")).alias("aya_text"),
        round3(F.col("start")).alias("start_time"), round3(F.col("end")).alias("end_time"),
        word_structs.alias("word_timings"),
    )
    docs = rows.groupBy("recording", "sura_no").agg(
        F.min("sura_name_en").alias("sura_name_en"), F.min("sura_name_ar").alias("sura_name_ar"),
        F.array_sort(F.collect_list(verse)).alias("ayahs"),
    ).withColumn("ayah_count", F.size("ayahs").cast("bigint"))
    if specials is None:
        return docs
    packed = specials.groupBy("recording").agg(
        F.array_sort(F.collect_list(F.struct("start_time", "end_time", "type", "text"))).alias("_sp")
    ).select(
        "recording",
        F.transform(
            "_sp", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start_time"].alias("start_time"), s["end_time"].alias("end_time"))
        ).alias("special_segments"),
    )
    return docs.join(packed, "recording", "left")


def verse_span_times(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """Start of one verse and end of another; nulls when either has no timing."""
    a = spans.select("recording", F.col("aya_no").alias("start_aya"), F.col("start").alias("_s"))
    b = spans.select("recording", F.col("aya_no").alias("end_aya"), F.col("end").alias("_e"))
    both = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    return asked.join(a, ["recording", "start_aya"], "left").join(b, ["recording", "end_aya"], "left").select(
        *asked.columns, F.when(both, F.col("_s")).alias("start_time"), F.when(both, F.col("_e")).alias("end_time")
    )


def word_times_of_verse(asked: DataFrame, word_times: DataFrame) -> DataFrame:
    return asked.join(word_times, ["recording", "aya_no"])


def word_time(asked: DataFrame, word_times: DataFrame) -> DataFrame:
    """First timing of each asked word reference, nulls when there is none."""
    first = word_times.filter("word_ref <> ''").groupBy("word_ref").agg(
        F.min_by(F.struct("word", "start", "end"), F.struct("start", "segment_idx", "at")).alias("w")
    ).select("word_ref", "w.*")
    return asked.join(first, "word_ref", "left")


def verse_at_time(asked: DataFrame, spans: DataFrame, width: float = 8.0) -> DataFrame:
    """Verse whose span ``[start, end)`` holds each asked time.

    Spans are listed under every ``width`` seconds they touch, which turns the range
    join into an equi-join.
    """
    cells = spans.filter("end > start").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    )
    hits = asked.withColumn("_cell", F.floor(F.col("t") / width)).join(
        cells.select("recording", "_cell", "aya_no", "start", "end"), ["recording", "_cell"]
    ).filter("t >= start AND t < end")
    first = hits.groupBy("ask_id").agg(F.min("aya_no").alias("aya_no"))
    return asked.join(first, "ask_id", "left")
