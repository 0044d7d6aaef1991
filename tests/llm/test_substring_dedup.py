import hashlib
import random

from lectern.llm import queries
from lectern.llm import substring_dedup as sd
from workload.compare import compare, connect

from tests.llm.cases import SPACED, TEXTS, count, empty, frame


def test_query_equals_sql(spark, small_dir):
    ok, note = compare(spark, connect(small_dir), small_dir, "op6", queries.op6_substring_dedup, queries.ORACLES["op6_substring_dedup"])
    assert ok, note


def _brute(texts, window=50):
    far = float("inf")
    order = lambda i: far if i is None else i
    split = [(i, t, SPACED.findall(t or "")) for i, t in texts]
    least = {}
    for i, _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(order(i), least.get(key, far))
    for i, t, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else t


def _check(spark, texts, parts):
    docs = frame(spark, texts).repartition(parts)
    found = sd.deduplicate(docs, keep=docs.columns, with_text=True)
    got = [(r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found.collect()]
    assert sorted(got, key=str) == sorted(_brute(texts), key=str)


def test_cases(spark):
    long = TEXTS[5][1]
    more = [(11, long), (12, "x " + long[500:4000] + " y"), (13, "a " * 70), (14, "b " + "a " * 49), (15, "a " * 49), (None, long[:3000]), (12, long[500:4000])]
    _check(spark, TEXTS + more, 3)
    assert count(sd.deduplicate(empty(spark))) == 0


def test_random_repeats_of_every_alphabet_size(spark):
    """Passages of 45 to 90 words moved between texts, over alphabets from one word to many."""
    rng = random.Random(5)
    texts = []
    for n in range(120):
        size = rng.choice([1, 2, 3, 10, 500])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(0, 160))]
        if texts and rng.random() < 0.7:
            other = (texts[rng.randrange(len(texts))][1] or "").split(" ")
            at, length = rng.randrange(len(other)), rng.randrange(45, 90)
            place = rng.randrange(len(words) + 1)
            words[place:place] = other[at : at + length]
        texts.append((rng.randrange(100), " ".join(words)))
    _check(spark, texts, 4)
