from lectern.llm import decontaminate as dc
from lectern.llm import queries
from pyspark.sql import functions as F
from workload.compare import compare, connect

from tests.llm.cases import alnum, count, empty, frame, table, texts_of


def test_query_equals_sql(spark, small_dir):
    ok, note = compare(spark, connect(small_dir), small_dir, "op2", queries.op2_decontamination, queries.ORACLES["op2_decontamination"])
    assert ok, note


def _brute(texts, items, window=10):
    out = []
    for doc_id, text in texts:
        words, hit, ids = alnum(text), set(), set()
        for item, body in items:
            own = alnum(body)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                part = own[k : k + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        ids.add(item)
        out.append((doc_id, len(words), len(hit), sorted(ids - {None})))
    return sorted(out, key=str)


def _items(spark):
    rows = [
        (1, "brown fox JUMPS over"),
        (2, None),
        (3, ""),
        (4, "a a a a a a a a a a a a"),
        (5, "one"),
        (None, "one"),
        (None, "over the lazy"),
        (None, "漢字 かな"),
        (6, "the quick brown fox jumps over the lazy dog and runs away from here and on"),
        (6, "lazy dog"),
        (7, "word5 tail5 word6 tail6 word7 tail7 word8 tail8 word9 tail9 word10"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_cases_against_brute_force_in_one_and_many_blocks(spark):
    docs, items = frame(spark).repartition(2), _items(spark)
    asked = [(r.item_id, r.text) for r in items.collect()]
    want = _brute(texts_of(docs), asked)
    index = dc.build_index(docs, keep=docs.columns)
    for size in (dc.BLOCK_BYTES, 20):
        got = dc.find(index, items, block_bytes=size)
        hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        rows = [(r.doc_id, r.n_words, r.h, list(r.items)) for r in got.select("doc.doc_id", "n_words", hit.alias("h"), "items").collect()]
        assert sorted(rows, key=str) == want


def test_an_item_without_id_still_contaminates(spark):
    items = spark.createDataFrame([(None, "lazy dog")], "item_id long, text string")
    got = dc.decontaminate(frame(spark), items).select("doc.doc_id", "n_hit", "n_items", "contaminated").collect()
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got if r.contaminated} == {(1, 2, 0), (7, 2, 0)}


def test_empty_tables(spark):
    docs, items = frame(spark), _items(spark)
    assert count(dc.decontaminate(empty(spark), items)) == 0
    clean = dc.decontaminate(docs, items.where("false"))
    assert count(clean) == count(docs) and count(clean.where("contaminated")) == 0


def test_proximity_is_any_order_within_a_span(spark):
    docs = spark.createDataFrame([(1, "a x b y c z"), (2, "c b a"), (3, "a q q q q q q b c"), (4, "a b"), (5, "c"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for span in (2, 3, 5, 9):
        want = set()
        for doc_id, text in texts_of(docs):
            words = alnum(text)
            for at, word in enumerate(words):
                if word in "abc" and {"a", "b", "c"} <= set(words[at : at + span]):
                    want.add((doc_id, at))
        got = dc.near(dc.build_index(docs), items, span).select("doc.doc_id", F.explode("starts").alias("at")).collect()
        assert {(r.doc_id, r.at) for r in got} == want
