import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import manifest, queries
from tests.llm.cases import count, empty, frame
from workload.compare import compare, connect

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, add=0):
    chars = None if r[4] is None else r[4] + add
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], chars, r[1])])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _path(levels, at):
    out = []
    for row in levels[:-1]:
        run = row[at // 2 * 2 : at // 2 * 2 + 2]
        out.append((at % 2, [x for k, x in enumerate(run) if k != at % 2]))
        at //= 2
    return out


def _plain(rows):
    """All columns by the definition, one row at a time."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[g] = _levels([_leaf(r) for r in groups[g]])
    top = _levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            path = _path(trees[g], at) + _path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = _leaf(r, 1 if bad else 0)
            for side, others in path:
                node = _h(*(others + [node] if side else [node] + others))
            out.append((r[0], _leaf(r), trees[g][-1][0], root, _h(*[x for _, o in path for x in o]), node, node == root))
    return sorted(out, key=repr)


def _got(df, bits):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.build(df, tampered=tampered, bits=bits)
    return sorted(map(tuple, made.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_query_equals_sql(spark, small_dir):
    ok, note = compare(spark, connect(small_dir), small_dir, "op12", queries.op12_manifest, queries.ORACLES["op12_manifest"])
    assert ok, note


def test_query_equals_definition(spark, small_dir):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op12_manifest(spark, small_dir).collect()), key=repr)
    assert got == _plain(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def test_random_ids_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        lang = rng.choice(["a", "a", "a", "", None, "é", "zz"])
        spread = rng.choice([50, 1 << 20, 1 << 62])
        rows.append((rng.choice([None, rng.randrange(-spread, spread)]) if rng.random() < 0.3 else rng.randrange(-spread, spread), rng.choice(["x", "y", "", None]), lang, rng.choice(["s", None]), rng.choice([None, 3, 2**63 - 2])))
    rows += [rows[0]] * 30  # one row a few dozen times
    plain = spark.createDataFrame(rows, ROWS).repartition(7)
    plain = plain.withColumns({c: F.lit("x") for c in ("tree", "high", "low", "at", "node", "leaf", "key", "total", "slot", "first")})
    for bits in (1, 3, 10):
        assert _got(plain, bits) == _plain(rows)


def test_cases(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    assert _got(df, 10) == _plain(rows)
    assert count(manifest.build(empty(spark))) == 0
    one = [(7, "t", None, "s", 1)]
    assert _got(spark.createDataFrame(one, ROWS), 10) == _plain(one)


def test_dense_bitmaps_rank_without_sorting(spark):
    ids = [i for i in range(-70_000, 140_000) if i % 3]
    random.Random(1).shuffle(ids)
    placed = spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "'s' source", "cast(null as string) lang", "1L n_chars", "'t' text")
    placed = manifest.leaves(placed.repartition(5))
    found = manifest.directory(placed)
    assert found.where("words is not null").count() >= 3
    at = {r.key: r["at"] for r in manifest.ranked(placed, found).select("key", "at").collect()}
    assert [at[i] for i in sorted(ids)] == list(range(len(ids)))


def test_containers_round_trip():
    rng = np.random.default_rng(2)
    for size in (0, 1, 255, 256, 257, 5000, 65_536):
        lows = rng.choice(65_536, size=size, replace=False).astype(np.uint16)
        back, times = manifest.opened(*manifest.container(lows))
        assert back.tolist() == sorted(lows.tolist()) and (times == 1).all()
    back, times = manifest.opened(*manifest.container(np.array([5, 5, 9, 5], dtype=np.uint16)))
    assert back.tolist() == [5, 9] and times.tolist() == [3, 1]
