"""Packed verses keep every word, empty verses and empty normal forms included."""

from lectern.operators.packed import Corpus, packed_verses

SCHEMA = "id bigint, jozz bigint, page bigint, sura_no bigint, sura_name_en string, sura_name_ar string, aya_no bigint, aya_text string"


def test_words_survive_packing(spark):
    texts = ["one two  three ١", "١", "ً ١", "a ً bً ٢", "", "four ٣"]
    verses = [(i, 1, (i + 1) // 2, 1, "S", "S", i, t) for i, t in enumerate(texts, 1)]
    packed = packed_verses(spark.createDataFrame(verses, SCHEMA)).orderBy("id").collect()
    assert [r.texts for r in packed] == [["one", "two", "three"], [], ["ً"], ["a", "ً", "bً"], [], ["four"]]
    assert [r.norms for r in packed] == [None, None, [""], ["a", "", "b"], None, None]
    assert [(r.start, r.page_start) for r in packed] == [(0, 0), (3, 0), (3, 3), (4, 3), (7, 7), (7, 7)]


def test_parts_hold_all_words_in_order(spark):
    verses = [(i, 1, (i + 1) // 2, 1 + i // 4, "S", "S", i, t) for i, t in enumerate(["a b ١", "cً ١", "١", "d ١", "e ١"], 1)]
    corpus = Corpus(packed_verses(spark.createDataFrame(verses, SCHEMA)))
    got = [tuple(r) for r in corpus.parts("sura_no", "page").orderBy("sura_no", "page").collect()]
    assert got == [(1, 1, 0, ["a", "b", "cً"], ["a", "b", "c"]), (2, 2, 0, ["d"], ["d"]), (2, 3, 0, ["e"], ["e"])]
