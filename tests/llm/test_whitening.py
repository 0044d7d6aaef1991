import math

import numpy as np

from lectern.llm import queries, whitening

CLASH = "vec_id long, embedding array<float>, label int, x string, w string, doc string, part string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, *("x",) * 4) for i, v in rows], CLASH)


def _plain(vectors):
    """x of usable vectors, fit list, covariance by the definition."""
    xs = [None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = np.array(sorted({x for x in xs if x is not None}), dtype=np.int64)
    centred = fit - fit.sum(axis=0) / len(fit)
    return xs, fit, centred.T @ centred / len(fit)


def _check(got, vectors, ids, components):
    xs, fit, cov = _plain(vectors)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    n, sums = len(fit), [int(s) for s in fit.astype(object).sum(axis=0)]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == components * sum(x is not None for x in xs)
    signs = {}
    for i, x in zip(ids, xs):
        if x is None:
            continue
        for k in range(components):
            r = by[i][k + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = float((np.array(x) - np.array(sums) / n) @ basis[:, k] / math.sqrt(values[k]))
            if abs(want) > 1e-3:
                sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
                assert abs(r.whitened * sign - want) < 1e-6 * max(1, abs(want))
            assert abs(r.explained - values[k] / values.sum()) < 1e-8 * r.explained
            assert r.identity_error < 1e-9


def test_query_equals_definition(spark, small_dir):
    got = queries.op13_whitening(spark, small_dir).collect()
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    _check(got, [r.embedding for r in rows], [r.vec_id for r in rows], 4)


def test_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [math.nan] * 6), (1004, [math.inf] + [0.0] * 5)]
    rows += [(2000 + k, rows[0][1]) for k in range(200)]  # repeated vectors count once in the fit list
    rows += [(3000, [-0.0] * 6)]
    got = whitening.whiten(_frame(spark, rows).repartition(5)).select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    _check(got, [v for _, v in rows], [i for i, _ in rows], 4)
    other = [*rows, (5000, [1.0]), (None, rows[1][1])]  # another length goes, a null id stays
    kept = whitening.whiten(_frame(spark, other)).select("doc.vec_id").collect()
    assert {r.vec_id for r in kept} == {r.vec_id for r in got} | {None}


def test_degenerate(spark):
    axis = [(2 * k + s, [(1.0 if s else -1.0) if j == k else 0.0 for j in range(8)]) for k in range(8) for s in range(2)]
    got = whitening.whiten(_frame(spark, axis)).collect()  # all directions equal
    assert len(got) == 64 and all(abs(r.explained - 1 / 8) < 1e-12 and r.identity_error < 1e-9 for r in got)
    line = [(k, [float(k), 2.0 * k, 0.0, 1.0, 0.0]) for k in range(50)]  # one direction varies
    got = whitening.whiten(_frame(spark, line)).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in got) and got[0].identity_error < 1e-9
    same = whitening.whiten(_frame(spark, [(k, [0.5, 0.5]) for k in range(9)])).collect()
    assert len(same) == 18 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.n == 1 for r in same)
    assert whitening.whiten(_frame(spark, [])).count() == 0
    huge = whitening.whiten(_frame(spark, [(k, [1e15 * k, 1.0]) for k in range(40)])).collect()
    assert all(r.deviation is None for r in huge if r.doc.vec_id == 39)


def test_solver_against_dense():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 30, 64):
        for kind in range(4):
            a = rng.normal(size=(d + 5, d))
            if kind == 1:
                a *= 10.0 ** -np.arange(d)
            if kind == 2:
                a[:, d // 2 :] = 0
            if kind == 3:
                a = a[: max(1, d // 2)]
            r = np.linalg.qr(a, mode="r")
            r = np.vstack([r, np.zeros((d - r.shape[0], d))])
            diagonal, off, right = whitening.bidiagonal(r)
            want = np.linalg.svd(r, compute_uv=False)
            got = whitening.dqds(diagonal, off)
            assert np.allclose(got, want, rtol=1e-10, atol=1e-12 * want[0])
            v = whitening.directions(diagonal, off, got[: min(4, d)], right)
            good = np.array(got[: v.shape[1]]) > 1e-9 * got[0]
            norms = np.linalg.norm(r @ v, axis=0)
            assert np.allclose(norms[good], np.array(got[: v.shape[1]])[good], rtol=1e-9)
            assert np.allclose((v.T @ v)[np.ix_(good, good)], np.eye(int(good.sum())), atol=1e-9)


def test_graded_values_keep_relative_accuracy():
    diagonal = 10.0 ** -np.arange(0, 24, 2.0)
    off = diagonal[1:] * 0.5
    got = whitening.dqds(diagonal, off)
    product = np.prod(diagonal)  # the determinant is known exactly
    assert abs(np.prod(np.array(got)) / product - 1) < 1e-12
