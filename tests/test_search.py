import random

from lectern.operators import catalogue

VERSES = "id long, sura_no long, aya_no long, page long, aya_text string"


def test_search_equals_plain_containment(spark):
    rng = random.Random(5)
    words = ["نور", "نورا", "ab", "abc", "b", "cab", "x\ty", "12", "a", "ba  b"]
    rows = [(k, k // 7, k % 7, k // 15, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for k in range(400)]
    rows += [(400, 90, 1, 30, ""), (401, 90, 2, 30, "\t \t")]
    needles = ["ab", "a", "b c", "نور", "ور", "ab  b", "b  b", " abc ", "x\ty", "\t", "zz", "", "  ", "ba  b abc", "3:2", "3:99", "bab", "ab ab ab"]
    queries = spark.createDataFrame(list(enumerate(needles)), "query_id long, query string")
    verses = spark.createDataFrame(rows, VERSES)
    for limit in (1, 5, 1000):
        got = catalogue.search_verses(queries, verses, limit)
        want = []
        for q, needle in enumerate(needles):
            text = needle.strip(" ")
            if not text:
                continue
            if ":" in needle:
                s, a = map(int, needle.split(":"))
                hits = [r[0] for r in rows if r[1] == s and r[2] == a][:1]
            else:
                hits = [r[0] for r in rows if text in r[4]]
            want += [(q, i, k + 1) for k, i in enumerate(hits[:limit])]
        assert sorted((r.query_id, r.id, r.hit_no) for r in got.collect()) == sorted(want)
