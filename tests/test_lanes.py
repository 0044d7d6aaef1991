import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import lanes
from lectern.functions.similarity import common_subsequence, indel_percent, indel_percents, partial_percent, partial_percents

WORD = st.text(alphabet="abcdeسبمż\U0001f600", max_size=12)


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return row[-1]


def _all(patterns, texts):
    i, j = np.meshgrid(np.arange(len(patterns)), np.arange(len(texts)), indexing="ij")
    return i.ravel(), j.ravel()


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=9, unique=True), st.lists(WORD, min_size=1, max_size=9, unique=True))
def test_edits_and_similarity(patterns, texts):
    pairing = lanes.Pairing(patterns, texts)
    i, j = _all(patterns, texts)
    want = [_plain(patterns[a], texts[b]) for a, b in zip(i, j)]
    assert pairing.edits(i, j).tolist() == want
    sims = [1.0 if patterns[a] == texts[b] and patterns[a] else 1.0 if patterns[a] == texts[b] else 0.0 if not patterns[a] or not texts[b] else 1.0 - d / max(len(patterns[a]), len(texts[b])) for a, b, d in zip(i, j, want)]
    assert pairing.similarity(i, j).tolist() == sims
    kept = pairing.similarity(i, j, 0.4)
    assert [s >= 0.4 for s in kept] == [s >= 0.4 for s in sims]


def test_long_words_and_many_lanes():
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 63, 64, 65, 130, 200, 7, 31, 32, 33)]
    words = list(dict.fromkeys(words + ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(300)]))
    pairing = lanes.Pairing(words, words)
    i, j = _all(words, words)
    pick = np.array(rng.sample(range(i.size), 30_000))
    pick = np.concatenate([pick, np.flatnonzero((i < 10) & (j < 10))])
    got = pairing.edits(i[pick], j[pick]).tolist()
    for k in list(range(0, pick.size, 97)) + list(range(pick.size - 100, pick.size)):
        assert got[k] == _plain(words[i[pick[k]]], words[j[pick[k]]])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abسż ", max_size=300), min_size=1, max_size=6), st.lists(st.text(alphabet="abسż ", max_size=300), min_size=1, max_size=6))
def test_common_subsequences(patterns, texts):
    i, j = _all(patterns, texts)
    got = lanes.common_subsequences(patterns, texts, i, j).tolist()
    assert got == [common_subsequence(patterns[a], texts[b]) for a, b in zip(i, j)]


def test_distinct():
    words, places = lanes.distinct(pa.array(["b", "a", "b", ""]))
    assert [words[p] for p in places] == ["b", "a", "b", ""] and len(words) == 3


TEXT = st.text(alphabet="abسż\U0001f600 ", max_size=30)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.none() | TEXT, st.none() | TEXT), max_size=12))
def test_ratios_of_columns(pairs):
    a, b = pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())
    plain = [(x or "", y or "") for x, y in pairs]
    assert indel_percents(a, b).tolist() == [indel_percent(x, y) for x, y in plain]
    assert partial_percents(a, b).tolist() == [partial_percent(x, y) for x, y in plain]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=25)), min_size=1, max_size=10))
def test_best_windows_equals_all_windows(pairs):
    pairs = [(p, p[::-1] + t) for p, t in pairs]
    at = np.arange(len(pairs))
    got = lanes.best_windows([p for p, _ in pairs], [t for _, t in pairs], at, at)
    assert got.tolist() == [max(indel_percent(p, t[max(0, k) : k + len(p)]) for k in range(1 - len(p), len(t))) for p, t in pairs]


def test_long_texts():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    pairs = [(make(n), make(m)) for n, m in ((511, 700), (513, 513), (2000, 30), (90, 3000), (1, 5000))]
    a, b = pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs])
    assert indel_percents(a, b).tolist() == [indel_percent(x, y) for x, y in pairs]
    assert partial_percents(a, b).tolist() == [partial_percent(x, y) for x, y in pairs]
