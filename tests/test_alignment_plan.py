"""The composed timing pipeline and its steps."""

from pyspark.sql import functions as F

from lectern.operators import index, locate, timing
from lectern.plans.corpus_tables import arabic_words
from workload.matching import extended, recording_alignment


def test_every_expected_verse_once_with_words(spark, small_dir):
    got = recording_alignment(spark, small_dir)
    heard = extended(spark, small_dir).filter("kind = 'match'").select("recording").distinct()
    verses = arabic_words(spark, small_dir).select(F.col("sura_no").alias("recording"), "aya_no").distinct().join(heard, "recording")
    keys = got.select("recording", "aya_no")
    assert keys.exceptAll(verses).isEmpty() and verses.exceptAll(keys).isEmpty()
    assert got.filter("n_words = 0 OR start_time IS NULL OR end_time IS NULL").isEmpty()
    counts = got.groupBy("recording").agg(F.max("ayah_count").alias("a"), F.count("*").alias("n")).filter("a <> n")
    assert counts.isEmpty()


def _words(spark):
    rows = [(p, f"w{p}", f"1:{1 + p // 3}:{1 + p % 3}", 1, 1 + p // 3, 1) for p in range(12)]
    return spark.createDataFrame(rows, "global_pos long, text string, word_ref string, sura_no long, aya_no long, n_phonemes int")


def test_a_words_verse_comes_from_its_reference(spark):
    segments = spark.createDataFrame([(7, 0, 3, 8, 0.0, 6.0), (7, 1, 99, 99, 6.0, 7.0)], "recording long, segment_idx long, start_pos long, end_pos long, time_start double, time_end double")
    timed = spark.createDataFrame(
        [(7, 0, 1, "1:3:1", 9), (7, 0, 2, "", 9), (7, 0, 3, "bad", 9), (7, 0, 4, "1:x:2", 9), (7, 1, 5, "", 9)],
        "recording long, segment_idx long, at long, word_ref string, aya_no long",
    )
    got = {r.at: r.aya_no for r in timing.verse_of_words(timed, segments, _words(spark)).collect()}
    assert got == {1: 3, 2: 2}


def test_segments_with_too_few_named_words_bound_their_outer_verses(spark):
    segments = spark.createDataFrame(
        [(7, 0, 0, 8, 1.0, 6.0), (7, 1, 0, 2, 6.0, 7.0), (7, 2, 3, 8, 7.0, 9.0)],
        "recording long, segment_idx long, start_pos long, end_pos long, time_start double, time_end double",
    )
    timed = spark.createDataFrame(
        [(7, 0, "1:1:1"), (7, 0, ""), (7, 1, "1:1:1"), (7, 2, "1:2:1"), (7, 2, "1:2:2")], "recording long, segment_idx long, word_ref string"
    )
    got = {(r.aya_no, r.start, r.end) for r in timing.bare_boundaries(segments, timed, _words(spark)).collect()}
    assert got == {(1, 1.0, 6.0), (3, 1.0, 6.0)}


def test_interpolated_verses_get_their_own_words(spark):
    spans = spark.createDataFrame([(7, 1, 0.0, 1.0, False), (7, 2, 1.0, 4.0, True), (7, 9, 4.0, 5.0, True)], "recording long, aya_no long, start double, end double, interpolated boolean")
    expected = spark.createDataFrame([(7, 1, 9)], "recording long, sura_no long, n_verses long")
    got = timing.words_of_interpolated(spans, expected, _words(spark)).orderBy("at").collect()
    assert [(r.aya_no, r.word_ref, r.start, r.end) for r in got] == [(2, "1:2:1", 1.0, 2.0), (2, "1:2:2", 2.0, 3.0), (2, "1:2:3", 3.0, 4.0)]


def test_anchors_do_not_change_with_the_size_of_the_corpus(spark):
    """Ten copies of a corpus under other words' frequencies: the same words are rare."""
    text = [f"w{k % 40}" if k % 3 else f"rare{k}" for k in range(3000)]
    small = spark.createDataFrame(list(enumerate(text)), "global_pos long, norm string")
    big = spark.createDataFrame([(k, t if t.startswith("w") else f"{t}/{n}") for n in range(10) for k, t in enumerate(text, n * 3000)], "global_pos long, norm string")
    queries = spark.createDataFrame([(1, "w1 w2 w4 w5 w7".split()), (2, "w1 w2 rare3 w4 w5".split()), (3, ["none"] * 5)], "query_id long, q array<string>")
    pick = lambda words, **o: sorted((r.query_id, r.idx, r.rare) for r in locate.select_anchors(queries, words, **o).collect())
    fixed = pick(small, max_hits=0)
    assert len(fixed) == 2 and not any(rare for *_, rare in fixed)
    assert dict((q, i) for q, i, _ in fixed)[2] == 2  # the rarest word it has
    assert [x[:2] for x in pick(big.withColumn("norm", F.split("norm", "/")[0]), max_hits=0)] == [x[:2] for x in fixed]


def test_posting_chunks_lose_nothing(spark):
    words = spark.createDataFrame([(k, "a" if k % 4 else "b") for k in range(1000)], "global_pos long, norm string")
    chunks = index.posting_chunks(words, span=64)
    assert chunks.filter(F.size("positions") > 64).isEmpty()
    back = chunks.select(F.explode("positions").alias("global_pos"), "norm")
    assert back.exceptAll(words).isEmpty() and words.exceptAll(back).isEmpty()
