from collections import Counter

from lectern.llm import language_id as li
from lectern.llm import queries
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, count, empty, frame, held_out, table


def _grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for word in words:
        edged = f" {word} "
        out.update(word)
        out.update(edged[k : k + 3] for k in range(len(edged) - 2))
    # a blank between words belongs to both
    if words:
        whole = " " + " ".join(words) + " "
        out.update(whole[k : k + 2] for k in range(len(whole) - 1))
    return out


def _code(gram):
    code = 0
    for c in gram:
        code = code << 21 | (0 if c == " " else ord(c))
    return code | {1: 0, 2: 1 << 62, 3: 1 << 63}[len(gram)]


def test_grams_equal_plain_counting():
    texts = [t for _, t in TEXTS]
    made = li.Grams(texts)
    for d, text in enumerate(texts):
        own = {int(g): int(t) for g, t, o in zip(made.gram, made.times, made.owner) if o == d}
        assert own == {_code(g): n for g, n in _grams(text).items()}


def test_query_equals_plain_profiles(spark, small_dir):
    docs = table(spark, small_dir, "documents").collect()
    totals = {}
    for r in docs:
        if r.lang is not None and not held_out(r.doc_id, 3):
            totals.setdefault(r.lang, Counter()).update(_grams(r.text))
    ranks = {}
    for lang, grams in totals.items():
        top = sorted(grams.items(), key=lambda x: (-x[1], _kind_order(x[0])))[: li.PROFILE]
        ranks[lang] = {g: k + 1 for k, (g, _) in enumerate(top)}
    got = {r.doc_id: r for r in queries.op1_language_id(spark, small_dir).collect()}
    for r in docs:
        own = sorted(_grams(r.text).items(), key=lambda x: (-x[1], _kind_order(x[0])))[: li.PROFILE]
        best = None
        for lang in sorted(ranks):
            apart = sum(min(abs(ranks[lang].get(g, 10**6) - k - 1), li.PROFILE) for k, (g, _) in enumerate(own))
            if own and (best is None or apart < best[0]):
                best = (apart, lang)
        g = got[r.doc_id]
        assert g.held_out == held_out(r.doc_id, 3) and 0 <= g.score <= 1
        assert g.lang_pred == (best[1] if best else "und")
        if best:
            assert abs(g.score - (1 - best[0] / (len(own) * li.PROFILE))) < 1e-9


def _kind_order(gram):
    """Order of equal counts: by length, then by code points."""
    return len(gram), _code(gram) & ((1 << 62) - 1)


def test_held_out_accuracy(spark, small_dir):
    docs = table(spark, small_dir, "documents").select("doc_id", "lang", "n_chars")
    found = queries.op1_language_id(spark, small_dir).where("held_out").join(docs, "doc_id").where("n_chars > 30")
    right, all_ = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * all_


def test_cases(spark):
    docs = frame(spark)
    model = li.learn(docs)
    rows = li.predict(docs, model, keep=docs.columns).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(c.isalpha() for c in r.doc.text or "")
        assert r.lang_pred == ("en" if letters else "und") and 0 <= r.score <= 1
    nothing = li.learn(frame(spark, lang=None))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    assert count(li.predict(empty(spark), li.learn(empty(spark)))) == 0
