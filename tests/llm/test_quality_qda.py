import math
from collections import Counter

import numpy as np
import pyarrow as pa
from lectern.llm import quality_qda as qq
from lectern.llm import queries

from tests.llm.cases import SPACED, TEXTS, count, empty, frame, held_out, labels, table


def test_held_out_accuracy_and_range(spark, small_dir):
    found = {r.doc_id: r for r in queries.op3_quality_classifier(spark, small_dir).collect()}
    assert len(found) == count(table(spark, small_dir, "documents"))
    known = {r.doc_id: r.quality for r in table(spark, small_dir, "labels").collect()}
    for doc_id, r in found.items():
        assert r.held_out == held_out(doc_id, 3) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    judged = [r.predicted == known[d] for d, r in found.items() if r.held_out and d in known]
    assert np.mean(judged) >= 0.95


def test_score_is_the_difference_of_two_log_densities():
    rng = np.random.default_rng(1)
    sets = {k: rng.normal(k, 1 + k, (200, qq.WIDTH)) for k in (0, 1)}
    model = qq.Discriminant({k: (len(x), x.sum(axis=0), x.T @ x) for k, x in sets.items()})
    x = rng.normal(0.5, 1.5, (5, qq.WIDTH))
    pooled = sum((x_k - x_k.mean(axis=0)).T @ (x_k - x_k.mean(axis=0)) for x_k in sets.values()) / 400
    scale = np.sqrt(np.diag(pooled))
    density = {}
    for k, own in sets.items():
        cov = np.cov(own.T, bias=True) / np.outer(scale, scale)
        cov = (1 - qq.SHRINK_TO_POOLED) * cov + qq.SHRINK_TO_POOLED * pooled / np.outer(scale, scale)
        cov = (1 - qq.SHRINK_TO_UNIT) * cov + qq.SHRINK_TO_UNIT * (np.trace(cov) / qq.WIDTH + 1e-6) * np.eye(qq.WIDTH)
        z = (x - own.mean(axis=0)) / scale
        density[k] = math.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


def _plain_statistics(text):
    """The eleven statistics of one text, counted one by one."""
    text = text or ""
    words, body = [w.encode() for w in SPACED.findall(text)], text.encode()
    n, size, prior = len(words), len(body), 20.0
    share = lambda x, of, usual: math.sqrt((x + usual * prior) / (of + prior))
    among = lambda marks: sum(b in marks for b in body)
    mean = (sum(map(len, words)) + 5.0 * prior) / (n + prior)
    squares = (sum(len(w) ** 2 for w in words) + 34.0 * prior) / (n + prior)
    times = Counter(words)
    return [
        math.log1p(mean),
        math.log1p(math.sqrt(max(squares - mean**2, 0))),
        share(among(b"#*$%&|<>~^{}\\"), size, 0.0),
        share(among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size, 0.02),
        share(among(b".,;:!?'\"()"), size, 0.03),
        share(sum(chr(b).isalnum() if b < 0x80 else True for b in body), size, 0.8),
        share(body.count(b"\n"), size, 0.0),
        share(len(times), n, 0.8),
        share(max(times.values(), default=0), n, 0.06),
        share(sum(a == b for a, b in zip(words, words[1:])), n, 0.0),
        share(sum(len(w) == 1 for w in words), n, 0.03),
    ]


def test_statistics_equal_plain_counting(spark, small_dir):
    texts = [t for _, t in TEXTS] + [r.text for r in table(spark, small_dir, "documents").select("text").collect()]
    made = qq.statistics(pa.array(texts, pa.string()))
    assert np.allclose(made, [_plain_statistics(t) for t in texts], rtol=0, atol=1e-9)


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = [t for _, t in TEXTS]
    together = qq.statistics(pa.array(texts, pa.string()))
    for n, t in enumerate(texts):
        assert np.allclose(together[n], qq.statistics(pa.array([t], pa.string()))[0])
    assert np.isfinite(together).all()


def test_cases(spark):
    docs = frame(spark)
    told = labels(spark, [(1, 1, 0), (1, 1, 0), (10, 0, 0), (6, 1, 1), (5, 0, 0), (3, None, 0), (8, 7, 0), (None, 1, 0), (99, 0, 0)])
    rows = qq.score(docs, qq.fit(docs, told), keep=docs.columns).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    again = {(r.doc.doc_id, r.doc.text): r.score for r in rows}
    assert again[(1, TEXTS[0][1])] == again[(7, TEXTS[0][1])]
    assert {r.score for r in qq.score(docs, qq.fit(docs, labels(spark))).collect()} == {0.5}
    assert {r.score for r in qq.score(docs, qq.fit(docs, labels(spark, [(1, 0, 0)]))).collect()} == {0.0}
    assert count(qq.classify(empty(spark), told)) == 0
