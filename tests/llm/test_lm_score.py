import math
from collections import Counter

from lectern.llm import lm_score, queries
from pyspark.sql import functions as F

from tests.llm.cases import LOWER, SPACED, TEXTS, count, empty, frame, held_out, table, texts_of


def _brute(texts, learns, pull):
    docs = [(i, [*SPACED.findall((t or "").translate(LOWER)), None]) for i, t in texts]
    taught = [w for (i, w) in docs if learns(i)]
    c = Counter(t for w in taught for t in w)
    pairs = Counter(x for w in taught for x in zip(["<start>", *w], w))
    n, v = sum(c.values()), len(c)
    p = lambda t: (c[t] + 0.5) / (n + 0.5 * (v + 1))
    context = lambda u: len(taught) if u == "<start>" else c[u]
    for i, w in docs:
        base = sum(math.log10(p(t)) for t in w)
        full = sum(math.log10((pairs[(a, b)] + pull * p(b)) / (context(a) + pull)) for a, b in zip(["<start>", *w], w))
        yield i, len(w), sum(c[t] > 0 for t in w), n, base, full


def _same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-7) and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-7)


def _rows(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_query_equals_plain_counting(spark, small_dir):
    found = queries.op4_lm_score(spark, small_dir)
    texts = texts_of(table(spark, small_dir, "documents"))
    _same(_rows(found), _brute(texts, lambda i: not held_out(i, 5), lm_score.PULL))
    assert all(r.held_out == held_out(r.doc_id, 5) for r in found.collect())


def test_model_beats_the_unigrams_on_held_out_texts(spark, small_dir):
    base, full = queries.op4_lm_score(spark, small_dir).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert full > base


def test_cases_over_many_blocks(spark, monkeypatch):
    docs = frame(spark).repartition(3)
    found = lm_score.score(docs, keep=docs.columns, learn=F.col("doc_id") != 1)
    rows = _rows(found.select("doc.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    _same(rows, _brute(TEXTS, lambda i: i is not None and i != 1, lm_score.PULL))


def test_nothing_learnt_and_empty(spark):
    docs = frame(spark)
    rows = lm_score.score(docs, learn=F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.base_score, 0.0, abs_tol=1e-9) for r in rows)
    assert count(lm_score.score(empty(spark))) == 0
