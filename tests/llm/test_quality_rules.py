from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import quality_rules as qr
from lectern.llm import queries
from lectern.llm.text import SPACED as TABLE
from lectern.llm.text import Words

from tests.llm.cases import SPACED, TEXTS, count, empty, frame, held_out, labels, table, texts_of


def _brute(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(SPACED.search(line)) and line in seen
        seen.add(line)
    threes = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é漢#|\n\t ", max_size=60)), max_size=5))
def test_statistics_equal_plain_counting(texts):
    array = pa.array(texts, pa.string())
    made = qr.base_statistics(array, Words(array, TABLE))
    assert list(zip(*(made[k].tolist() for k in qr.STATISTICS))) == [_brute(t) for t in texts]


def test_query(spark, small_dir):
    texts = dict(texts_of(table(spark, small_dir, "documents")))
    known = {r.doc_id: r.quality for r in table(spark, small_dir, "labels").collect()}
    rows = queries.op9_quality_rules(spark, small_dir).collect()
    right = []
    for r in rows:
        stats = _brute(texts[r.doc_id])
        assert tuple(r[k] for k in qr.STATISTICS) == stats
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        assert r.base_failed == failed and r.kept == (not failed and r.score >= qr.THRESHOLD)
        if not failed and r.doc_id in known:
            right.append(r.kept == (known[r.doc_id] == 1))
    assert len(rows) == len(texts) and np.mean(right) >= 0.97


def test_verdict_on_labels_the_fit_did_not_see(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    told = table(spark, small_dir, "labels")
    model = qr.fit(docs, told.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"))
    known = {r.doc_id: r.quality for r in told.collect() if held_out(r.doc_id, 3)}
    rows = [r for r in qr.judge(docs, model).collect() if r.doc.doc_id in known and not r.base_failed]
    assert len(rows) > 20 and np.mean([r.kept == (known[r.doc.doc_id] == 1) for r in rows]) >= 0.95


def test_probability_is_the_mean_weight_of_words_and_grams():
    rng = np.random.default_rng(2)
    model = qr.Calibrated(rng.normal(size=2 << qr.BITS), 1.5, -0.2)
    texts = ["some words here", "", None, "abc", "é", "x y"]
    got = model.probability(Words(pa.array(texts, pa.string()), TABLE))
    for p, (slots, shares) in zip(got, qr.vector(pa.array(texts, pa.string()))):
        assert abs(p - 1 / (1 + np.exp(-(1.5 * (model.weights[slots] * shares).sum() - 0.2)))) < 1e-6


def test_cases(spark):
    docs = frame(spark)
    told = labels(spark, [(1, 1, 0), (6, 1, 0), (10, 0, 0), (5, 0, 0), (8, None, 0), (None, 1, 0), (7, 3, 0)])
    for model in (qr.fit(docs, told), qr.fit(docs, labels(spark, [(1, 1, 0)])), qr.fit(empty(spark), labels(spark))):
        rows = qr.judge(docs, model, keep=docs.columns).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            assert tuple(r[k] for k in qr.STATISTICS) == _brute(r.doc.text) and 0 <= r.score <= 1
            assert r.kept == (not r.base_failed and (model is None or r.score >= qr.THRESHOLD))
    assert count(qr.judge(empty(spark), None)) == 0
