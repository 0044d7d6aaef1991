"""Rows of a speech dataset cut from aligned recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.timing import round3


def clip_spans(spans: DataFrame, audio: DataFrame) -> DataFrame:
    """Verse spans in whole milliseconds inside the audio, empty ones dropped.

    ``audio`` is ``(recording, length_ms)``; recordings without audio have no clips.
    """
    start = F.greatest(F.lit(0), (F.col("start") * 1000).cast("bigint"))
    end = F.least(F.col("length_ms"), (F.col("end") * 1000).cast("bigint"))
    return spans.join(audio.select("recording", "length_ms"), "recording").withColumns(
        {"start_ms": start, "end_ms": end}
    ).filter("end_ms > start_ms").drop("length_ms")


def missing_audio(spans: DataFrame, audio: DataFrame) -> DataFrame:
    return spans.select("recording").distinct().join(audio, "recording", "left_anti")


def relative_word_times(spans: DataFrame, word_times: DataFrame) -> DataFrame:
    """Word times of each verse from the verse's start, as JSON text in word order."""
    rows = word_times.select("recording", "aya_no", "at", "word", "word_ref", F.col("start").alias("_s"), F.col("end").alias("_e")).join(
        spans.select("recording", "aya_no", F.col("start").alias("_v")), ["recording", "aya_no"]
    )
    entry = F.struct(
        F.col("_s").alias("_o"), F.col("at"), F.col("word"), F.col("word_ref"),
        round3(F.col("_s") - F.col("_v")).alias("start"), round3(F.col("_e") - F.col("_v")).alias("end"),
    )
    return rows.groupBy("recording", "aya_no").agg(F.array_sort(F.collect_list(entry)).alias("ws")).select(
        "recording", "aya_no",
        F.to_json(
            F.transform(
                "ws",
                lambda w: F.struct(w["word"].alias("word"), w["word_ref"].alias("word_ref"), w["start"].alias("start"), w["end"].alias("end")),
            )
        ).alias("word_timings"),
    )


def build_asr_rows(
    spans: DataFrame, word_times: DataFrame, verses: DataFrame, audio: DataFrame, clips: DataFrame | None = None
) -> DataFrame:
    """One row per clip: chapter, verse, audio path (and bytes if given), text, words.

    ``spans`` is ``(recording, sura_no, aya_no, start, end)``. ``clips`` may bring
    ``(path, bytes)`` as read by the binary file source.
    """
    rows = (
        clip_spans(spans, audio)
        .join(verses.select("sura_no", "aya_no", "aya_text", "sura_name_en", "sura_name_ar"), ["sura_no", "aya_no"], "left")
        .join(relative_word_times(spans, word_times), ["recording", "aya_no"], "left")
        .withColumn("path", F.format_string("%03d_%03d.wav", "sura_no", "aya_no"))
    )
    if clips is not None:
        rows = rows.join(clips.select("path", "bytes"), "path", "left")
    else:
        rows = rows.withColumn("bytes", F.lit(None).cast("binary"))
    return rows.select(
        F.col("sura_no").cast("int").alias("surah"),
        F.col("aya_no").cast("int").alias("ayah"),
        F.struct("bytes", "path").alias("audio"),
        F.coalesce("aya_text", F.lit("")).alias("text"),
        F.coalesce("sura_name_en", F.lit("")).alias("surah_name_en"),
        F.coalesce("sura_name_ar", F.lit("")).alias("surah_name_ar"),
        F.coalesce("word_timings", F.lit("[]")).alias("word_timings"),
        "start_ms", "end_ms",
    )
