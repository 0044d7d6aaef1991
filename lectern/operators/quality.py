"""Checks of alignment documents against the corpus, and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.ordering import with_neighbours
from lectern.functions.text import first_word

# --- fixed values -----------------------------------------------------------
REFUGE, OPENING = "isti'adha", "basmala"
TOLERANCE = 0.5
LARGE_GAP, WIDE_GAP, VERY_WIDE_GAP = 2.0, 5.0, 10.0
FIRST_VERSE_BOUNDS = (5.0, 20.0)
PASS_MARK = 0.7
# ----------------------------------------------------------------------------


def check_coverage(spans: DataFrame, declared: DataFrame, verses: DataFrame) -> DataFrame:
    """Counts per recording, and its duplicate, missing and unexpected verses.

    ``spans`` is ``(recording, sura_no, aya_no, ...)``, ``declared`` is
    ``(recording, sura_no, ayah_count)``. Each finding is a row.
    """
    expected = verses.groupBy("sura_no").agg(F.count(F.lit(1)).alias("expected"))
    seen = spans.groupBy("recording", "sura_no", "aya_no").agg(F.count(F.lit(1)).alias("times"))
    actual = seen.groupBy("recording", "sura_no").agg(F.sum("times").alias("actual"))
    base = declared.join(expected, "sura_no", "left").join(actual, ["recording", "sura_no"], "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0))
    )
    known = base.filter("expected IS NOT NULL")

    def finding(rows, kind, number):
        return rows.select("recording", F.lit(kind).alias("issue"), number.cast("bigint").alias("aya_no"))

    none = F.lit(None)
    wanted = known.select("recording", "sura_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "expected")).alias("aya_no"))
    sized = seen.join(known.select("recording", "sura_no", "expected"), ["recording", "sura_no"])
    return reduce(
        DataFrame.unionByName,
        [
            finding(base.filter("expected IS NULL"), "unknown chapter", none),
            finding(known.filter("ayah_count <> expected"), "declared count differs", none),
            finding(known.filter("actual <> expected"), "actual count differs", none),
            finding(sized.filter("times > 1"), "duplicate", F.col("aya_no")),
            finding(wanted.join(seen, ["recording", "sura_no", "aya_no"], "left_anti"), "missing", F.col("aya_no")),
            finding(sized.filter("aya_no < 1 OR aya_no > expected"), "unexpected", F.col("aya_no")),
        ],
    )


def check_first_word(spans: DataFrame, first_words: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses without words, with another first word, or with a wrong first reference.

    ``first_words`` is ``(recording, aya_no, word, word_ref)``, each verse's first word.
    """
    truth = verses.select("sura_no", "aya_no", first_word(F.col("aya_text")).alias("_truth"))
    rows = spans.join(truth, ["sura_no", "aya_no"]).join(first_words, ["recording", "aya_no"], "left")
    ref = F.concat_ws(":", F.col("sura_no").cast("string"), F.col("aya_no").cast("string"), F.lit("1"))
    found = F.col("word").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(~found, F.lit("no words")),
            F.when(found & (F.col("word") != F.col("_truth")), F.lit("first word differs")),
            F.when(found & (F.coalesce("word_ref", F.lit("")) != ref), F.lit("reference differs")),
        )
    )
    return rows.select("recording", F.explode(issues).alias("issue"), "aya_no")


def check_specials(recordings: DataFrame, specials: DataFrame, spans: DataFrame) -> DataFrame:
    """Opening formulas each chapter must or must not have, and their place.

    ``recordings`` is ``(recording, sura_no)``.
    """
    packed = specials.groupBy("recording").agg(
        F.bool_or(F.col("type") == REFUGE).alias("refuge"),
        F.bool_or(F.col("type") == OPENING).alias("opening"),
        F.max_by("end_time", F.struct("start_time", "end_time")).alias("last_end"),
    )
    first = spans.groupBy("recording").agg(F.min_by("start", "aya_no").alias("first_start"))
    rows = recordings.join(packed, "recording", "left").join(first, "recording", "left")
    any_ = F.col("refuge").isNotNull()
    one, nine = F.col("sura_no") == 1, F.col("sura_no") == 9
    issues = F.array_compact(
        F.array(
            F.when(~any_, F.lit("no special segments")),
            F.when(any_ & (one | nine) & ~F.col("refuge"), F.lit("refuge formula missing")),
            F.when(any_ & ~nine & ~F.col("opening"), F.lit("opening formula missing")),
            F.when(any_ & nine & F.col("opening"), F.lit("opening formula not expected")),
            F.when(any_ & (F.col("last_end") >= F.col("first_start")), F.lit("special overlaps first verse")),
        )
    )
    return rows.select("recording", F.explode(issues).alias("issue"), F.lit(None).cast("bigint").alias("aya_no"))


def validation_report(recordings: DataFrame, issues: DataFrame) -> DataFrame:
    """PASS or FAIL per recording with its number of issues, and the totals.

    The row without a recording counts recordings that pass.
    """
    counted = issues.groupBy("recording").agg(F.count(F.lit(1)).alias("n_issues"))
    rows = recordings.select("recording").join(counted, "recording", "left").select(
        "recording", F.coalesce("n_issues", F.lit(0)).alias("n_issues")
    ).withColumn("ok", F.col("n_issues") == 0)
    return rows.rollup("recording").agg(
        F.sum("n_issues").alias("n_issues"), F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total")
    ).withColumn(
        "verdict", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL")
    )


def _gaps(spans: DataFrame) -> DataFrame:
    near = with_neighbours(spans.select("recording", "aya_no", "start", "end"), ["recording"], "aya_no", ["start"])
    return near.withColumn("gap", F.col("next_start") - F.col("end"))


def continuity_stats(spans: DataFrame, large: float = LARGE_GAP) -> DataFrame:
    """Pauses and overlaps between consecutive verses of each recording."""
    gap = F.col("gap")
    return _gaps(spans).groupBy("recording").agg(
        F.count_if(gap > 0).alias("n_gaps"),
        F.count_if(gap < 0).alias("n_overlaps"),
        F.coalesce(F.avg(F.when(gap > 0, gap)), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.max(F.when(gap > 0, gap)), F.lit(0.0)).alias("max_gap"),
        F.count_if(gap > large).alias("n_large"),
    )


def _first_verse(spans: DataFrame) -> DataFrame:
    return spans.groupBy("recording").agg(
        F.min_by(F.struct("start", "end"), "aya_no").alias("v")
    ).select("recording", F.col("v.start").alias("first_start"), F.col("v.end").alias("first_end"))


def _off(actual: Column, wanted: Column) -> Column:
    """Off by more than the tolerance; nothing wanted is never off."""
    return F.coalesce(F.abs(actual - wanted) > TOLERANCE, F.lit(False))


def alignment_quality(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Score of each recording out of 1, with its kinds of issue.

    ``expected`` is ``(recording, expected_start, expected_end)``, either may be null.
    """
    rows = continuity_stats(spans).join(_first_verse(spans), "recording").join(expected, "recording", "left")
    wrong = _off(F.col("first_start"), F.col("expected_start")) | _off(F.col("first_end"), F.col("expected_end"))
    large = F.col("n_large") > 0
    score = (
        1.0 - F.when(wrong, 0.3).otherwise(0.0) - F.when(large, 0.2).otherwise(0.0)
        - F.when(F.col("max_gap") > WIDE_GAP, 0.1).otherwise(0.0)
    )
    issues = F.array_compact(
        F.array(
            F.when(wrong, F.lit("first verse timing")),
            F.when(large, F.concat(F.lit("large gaps "), F.col("n_large").cast("string"))),
            F.when(F.col("max_gap") > VERY_WIDE_GAP, F.lit("very large gap")),
        )
    )
    return rows.select("recording", F.greatest(score, F.lit(0.0)).alias("score"), F.array_join(issues, "; ").alias("issues"))


def alignment_issues(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Number of issues of each recording and a score losing a tenth per issue."""
    lo, hi = FIRST_VERSE_BOUNDS
    first = _first_verse(spans).join(expected, "recording", "left")
    length = F.col("first_end") - F.col("first_start")
    own = first.select(
        "recording",
        _off(F.col("first_start"), F.col("expected_start")).cast("bigint").alias("start_off"),
        _off(F.col("first_end"), F.col("expected_end")).cast("bigint").alias("end_off"),
        ((length < lo) | (length > hi)).cast("bigint").alias("odd_length"),
    )
    rows = own.join(continuity_stats(spans), "recording")
    n = F.col("start_off") + F.col("end_off") + F.col("odd_length") + F.col("n_overlaps") + F.col("n_large")
    return rows.select(
        "recording", "start_off", "end_off", "odd_length", "n_overlaps", "n_large",
        n.alias("n_issues"), F.greatest(F.lit(0.0), F.lit(1.0) - n * 0.1).alias("score"),
    )


def quality_summary(scores: DataFrame, pass_mark: float = PASS_MARK) -> DataFrame:
    good = F.col("score") > pass_mark
    return scores.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("successful"),
        (F.count_if(good) * 100.0 / F.count(F.lit(1))).alias("share"),
        F.avg(F.when(good, F.col("score"))).alias("average"),
    )
