"""Words, verses and documents of parts equal those of word rows, however the batches fall."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import session
from lectern.operators import part_words, timing
from lectern.operators.text_jobs import phoneme_table
from tests.test_timed_parts import corpus

KEYS = ["recording", "segment_idx"]
RANGES = [(0, 12), (-2, 1), (2, 5), (7, 8), (3, 3), (11, 15), (-3, -2), (20, 21), (5, 4), (-1, 14), (0, 3), (0, 3), (4, 6), (4, 6), (10, 11)]


def rows_of(df, columns):
    return sorted(map(str, map(tuple, df.select(*columns).collect())))


@pytest.fixture(scope="module")
def timed(spark):
    packed = corpus(spark)
    segments = spark.createDataFrame(
        [(1 + i % 2, i, a, b, i * 3.0 % 7, i * 3.0 % 7 + 2.75) for i, (a, b) in enumerate(RANGES)],
        "recording bigint, segment_idx bigint, start_pos bigint, end_pos bigint, time_start double, time_end double",
    )
    parts = session.through_table(timing.timed_parts(segments, packed, KEYS), "parts")
    words = timing.distribute_word_times(segments, phoneme_table(packed.words()), KEYS).withColumnRenamed("global_pos", "at")
    return packed, segments, parts, session.through_table(words, "words")


def test_segments_inside_a_verse_are_not_summed_apart(timed):
    alone = timed[2].filter("total IS NULL")
    assert alone.filter("recording IS NOT NULL").count() > 3 and alone.filter("low <> start_pos OR before <> 0").count() == 0


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_kept_words_and_verses_equal_those_of_word_rows(spark, timed, batch):
    _, _, parts, words = timed
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        kept = timing.dedupe_word_refs(words)
        assert rows_of(timing.kept_of_parts(parts), kept.columns) == rows_of(kept, kept.columns)
        verses = timing.verse_times(kept)
        got = timing.verses_of_parts(parts)
        assert rows_of(got, verses.columns) == rows_of(verses, verses.columns)
        first = kept.groupBy("recording", "aya_no").agg(F.min_by(F.struct("word", "word_ref"), F.struct("start", "segment_idx", "at")).alias("w")).select("recording", "aya_no", "w.*")
        assert rows_of(got, first.columns) == rows_of(first, first.columns)
        texts = spark.createDataFrame(
            [(r, a, f"text {r} {a}", f"en {r}", f"ar {r}") for r in (1, 2, 3) for a in (1, 2, 4, 99, 1023)],
            "recording bigint, aya_no bigint, aya_text string, sura_name_en string, sura_name_ar string",
        )
        docs = timing.assemble_alignment(verses.withColumn("sura_no", F.col("recording")), kept, texts.withColumnRenamed("recording", "sura_no")).drop("sura_no")
        made = timing.documents_of_parts(parts, texts)
        assert made.count() == 2 and rows_of(made, docs.columns) == rows_of(docs, docs.columns)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_groups_are_never_parted(monkeypatch):
    rows = [(1, None), (1, None), (1, 2), (2, 2), (2, 2), (2, 2), (2, 3), (3, 3)]
    for size in range(1, 9):
        given = [pa.RecordBatch.from_pylist([{"recording": a, "aya_no": b} for a, b in rows[k : k + size]], pa.schema([("recording", pa.int64()), ("aya_no", pa.int64())])) for k in range(0, 8, size)]
        got = [[tuple(r.values()) for r in b.to_pylist()] for b in part_words.whole_groups(iter(given), part_words.VERSE_KEY)]
        assert [r for g in got for r in g] == rows and len({r for g in got for r in set(g)}) == sum(len(set(g)) for g in got)


def test_large_tables_are_small_on_disk_and_their_shuffles_go(spark, monkeypatch, tmp_path):
    import os

    monkeypatch.setattr(session, "LARGE_TABLE", 1 << 16)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    held = lambda: sum(f.startswith("shuffle_") and f.endswith(".data") for _, _, fs in os.walk(local) for f in fs)
    session.write_table(spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(4), str(tmp_path / "t"))
    assert held() == 0
    assert {f.split(".")[-2] for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")} == {"zstd"}
