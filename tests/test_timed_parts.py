"""Word times over the packed corpus equal those over word rows; lines cross the network, not word rows."""

from pyspark.sql import functions as F

from lectern.operators import index, timing
from lectern.operators.packed import Corpus, packed_verses
from lectern.operators.text_jobs import phoneme_table
from lectern.plans.corpus_tables import arabic_words, packed_arabic

SCHEMA = "id bigint, page bigint, sura_no bigint, sura_name_en string, aya_no bigint, aya_text string"
#: verse 3 has no word, those of verse 5 no phoneme; verses 1023 to 1026 lie in two blocks of ids and on one page
TEXTS = {1: "بسم ن الله ١", 2: "كتب ١", 3: "", 4: "قلم ك دار ١", 5: "۞ ۞ ١", 1023: "بسم ١", 1024: "الله كتب ١", 1026: "ق ١"}


def corpus(spark):
    rows = [(i, 1 + i // 600, 1 if i < 4 else 2, "S", i, t) for i, t in TEXTS.items()]
    return Corpus(packed_verses(spark.createDataFrame(rows, SCHEMA), need_space=True))


def test_pages_reach_over_blocks_of_ids(spark):
    got = {r.id: (r.start, r.page_start) for r in corpus(spark).verses.collect()}
    assert got == {1: (0, 0), 2: (3, 0), 3: (4, 0), 4: (4, 0), 5: (7, 0), 1023: (9, 9), 1024: (10, 9), 1026: (12, 9)}


def test_times_of_parts_equal_those_of_word_rows(spark):
    packed = corpus(spark)
    ranges = [(0, 12), (-2, 1), (2, 5), (7, 8), (3, 3), (11, 15), (-3, -2), (20, 21), (5, 4), (-1, 14)]
    segments = spark.createDataFrame(
        [(1 + i % 2, i, a, b, i * 3.0, i * 3.0 + 2.75) for i, (a, b) in enumerate(ranges)],
        "recording bigint, segment_idx bigint, start_pos bigint, end_pos bigint, time_start double, time_end double",
    )
    keys = ["recording", "segment_idx"]
    fast = timing.distribute_word_times(segments, packed, keys)
    plain = timing.distribute_word_times(segments, phoneme_table(packed.words()), keys)
    assert sorted(map(tuple, fast.select(plain.columns).fillna(-1).collect())) == sorted(map(tuple, plain.fillna(-1).collect()))
    windows = segments.select(F.col("segment_idx").alias("window_id"), "start_pos", "end_pos")
    narrow = [index.phoneme_window(windows, w).orderBy("window_id").collect() for w in (packed, phoneme_table(packed.words()))]
    assert narrow[0] == narrow[1]


def test_phonemes_are_not_written(spark, small_dir):
    arabic_words(spark, small_dir)
    assert "phonemes" not in packed_arabic(spark, small_dir).verses.columns
    words = arabic_words(spark, small_dir)
    wrong = words.filter(F.size("phonemes") != F.col("n_phonemes"))
    assert wrong.count() == 0 and phoneme_table(words, True).filter(F.size("phonemes") != F.col("n_phonemes")).count() == 0
