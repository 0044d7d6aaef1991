import math
import random
from collections import Counter, defaultdict

import numpy as np
from lectern.llm import near_dup as nd
from lectern.llm import queries
from lectern.llm.components import components

from tests.llm.cases import TEXTS, alnum, count, empty, frame, table, texts_of


def _weighted(texts):
    sets = []
    for _, text in texts:
        words = alnum(text)
        sets.append(Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter())
    df, n = Counter(k for s in sets for k in s), len(texts)
    idf = {k: nd.FLOOR + (1 - nd.FLOOR) * math.log1p(n / v) / math.log1p(n) for k, v in df.items()}
    return [{k: v * idf[k] for k, v in s.items()} for s in sets]


def _brute(texts):
    """Least doc_id of each text's class, over all pairs that share a shingle."""
    sets = _weighted(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for k in s:
            holders[k].append(n)
    for n, s in enumerate(sets):
        shared = defaultdict(float)
        for k, w in s.items():
            for m in holders[k]:
                if m < n:
                    shared[m] += min(w, sets[m][k])
        for m, common in shared.items():
            if common / (sum(s.values()) + sum(sets[m].values()) - common) >= nd.SIMILARITY:
                a, b = find(n), find(m)
                root[max(a, b)] = min(a, b)
    wordless = {}
    for n, (_, text) in enumerate(texts):
        if not sets[n] and (text or "").strip():
            root[n] = wordless.setdefault(text, n)
    order = lambda n: (texts[n][0] is None, texts[n][0] or 0)
    least = {}
    for n in range(len(texts)):
        r = find(n)
        least[r] = min(least.get(r, n), n, key=order)
    return [(texts[n][0], texts[least[find(n)]][0]) for n in range(len(texts))]


def _pairs(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def test_query_equals_the_exact_join(spark, small_dir):
    found = queries.op10_near_dup(spark, small_dir)
    assert _pairs(found) == sorted(_brute(texts_of(table(spark, small_dir, "documents"))), key=str)
    classes = found.select("class_id").distinct().count()
    assert count(found.where("kept")) == classes and count(found.where("kept and doc_id <> class_id")) == 0


def test_cases_and_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"base{k}" for k in range(300)]
    texts = list(TEXTS)
    for n in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(300)] = f"edit{rng.randrange(10**6)}"
        texts.append((100 + n, " ".join(words)))
    texts += [(300, " ".join(base)), (301, " ".join(base).upper()), (302, " ".join(base[:150])), (303, "short text"), (304, "Short, text"), (305, "###"), (306, "!!"), (307, " ")]
    docs = frame(spark, texts).repartition(3)
    found = nd.classes(docs, keep=[c for c in docs.columns if c != "text"])
    assert _pairs(found.members) == sorted(_brute(texts), key=str)
    kept = found.kept_documents().select("doc.doc_id", "text").collect()
    assert len(kept) == count(found.members.where("kept"))
    assert {(r.doc_id, r.text) for r in kept} <= set(texts)
    assert count(nd.classes(empty(spark)).members) == 0


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(9)
    digest = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    agree, true = [], []
    for _ in range(40):
        a = rng.uniform(0.7, 3, 400).astype(np.float32)
        b = np.where(rng.random(400) < 0.8, a, rng.uniform(0.7, 3, 400)).astype(np.float32)
        a_in, b_in = rng.random(400) < 0.95, rng.random(400) < 0.95
        draw = lambda w, m: nd.samples(digest[m], w[m], np.array([0, m.sum()]))[0]
        agree.append((draw(a, a_in) == draw(b, b_in)).mean())
        true.append(nd.similarity(digest[a_in], a[a_in], digest[b_in], b[b_in]))
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(100)]
    links = spark.createDataFrame([*chain, *star, (5000, 5000), (200, 0), (1, 0)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[1000 + k] for k in range(101)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots
    assert components(links.where("false")).count() == 0
