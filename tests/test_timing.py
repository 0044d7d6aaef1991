"""Timing folds against one-by-one walks."""

import random

import pytest

from lectern.operators import timing

SPAN = "recording bigint, aya_no bigint, start double, end double"


def walk_duplicates(spans):
    spans = {a: [s, e] for a, s, e in spans}
    seen = {}
    for aya in sorted(spans):
        key = tuple(round(x, 3) for x in spans[aya])
        if key not in seen:
            seen[key] = aya
            continue
        other, mid = seen[key], key[0] + (key[1] - key[0]) / 2
        spans[other][1] = mid - 0.001
        spans[aya][0] = mid
        for a in (other, aya):
            seen[tuple(round(x, 3) for x in spans[a])] = a
    return spans


@pytest.mark.parametrize("seed", range(3))
def test_split_duplicates(spark, seed):
    rng = random.Random(seed)
    # halves of whole spans come up again, so splits cascade
    pool = [(0.0, 8.0), (4.0, 8.0), (0.0, 3.999), (6.0, 8.0), (4.0, 5.999), (20.0, 24.0), (22.0, 24.0), (30.0, 31.0)]
    spans = [(a, *rng.choice(pool)) for a in range(1, 30)]
    got = timing.split_duplicate_spans(spark.createDataFrame([(1, *s) for s in spans], SPAN)).collect()
    want = walk_duplicates(spans)
    assert {r["aya_no"]: (round(r["start"], 6), round(r["end"], 6)) for r in got} == {a: (round(s, 6), round(e, 6)) for a, (s, e) in want.items()}


def walk_missing(spans, n):
    spans = {a: [s, e] for a, s, e in spans}
    present = sorted(spans)
    for aya in range(1, n + 1):
        if aya in spans:
            continue
        before = max((a for a in present if a < aya), default=None)
        after = min((a for a in present if a > aya), default=None)
        if before is not None and after is not None and spans[after][0] > spans[before][1]:
            s, e = spans[before][1], spans[after][0]
        elif before is not None:
            e = spans[before][1]
            s = e - (e - spans[before][0]) * 0.30
            spans[before][1] = s
        else:
            s = spans[after][0]
            e = s + (spans[after][1] - s) * 0.30
            spans[after][0] = e
        spans[aya] = [round(s, 3), round(e, 3)]
        present = sorted([*present, aya])
    return spans


@pytest.mark.parametrize("seed", range(4))
def test_interpolate(spark, seed):
    rng = random.Random(seed)
    t, spans = 0.0, []
    for aya in range(1, 41):
        length = rng.choice([1.0, 2.37, 4.125])
        if rng.random() < 0.5 and aya not in (6, 7):
            spans.append((aya, t, t + length))
        t += length + rng.choice([0.0, 0.0, 0.512, -0.25])
    frame = spark.createDataFrame([(3, *s) for s in spans], SPAN)
    n = spark.createDataFrame([(3, 40)], "recording bigint, n_verses bigint")
    got = {r["aya_no"]: (r["start"], r["end"]) for r in timing.interpolate_missing(frame, n).collect()}
    want = walk_missing(spans, 40)
    assert set(got) == set(want)
    for a, (s, e) in want.items():
        assert got[a] == pytest.approx((s, e), abs=2e-3), a


def test_repair_durations(spark):
    """A long verse with a foreign word and a wide pause gives its tail to a short next one."""
    words = []
    for at, (aya, named, s, e) in enumerate([(1, 1, 0.0, 2.0), (1, 1, 3.0, 5.0), (1, 2, 40.0, 42.0), (2, 2, 42.0, 43.0), (3, 3, 43.0, 80.0), (3, 3, 81.0, 90.0), (4, 4, 90.0, 91.0)]):
        words.append((1, 0, aya, at, "w", f"5:{named}:1", s, e))
    wt = spark.createDataFrame(words, "recording bigint, segment_idx bigint, aya_no bigint, at bigint, word string, word_ref string, start double, end double")
    spans = timing.verse_times(wt)
    got = {r["aya_no"]: (r["start"], r["end"]) for r in timing.repair_durations(spans, wt).collect()}
    # verse 1: 42 s, 14 s a word; the pause of 35 s is under three times that, the last rule applies
    assert got == {1: (0.0, 22.5), 2: (22.5, 43.0), 3: (43.0, 90.0), 4: (90.0, 91.0)}
    flags = {r["aya_no"]: r["flag"] for r in timing.flag_durations(spans).collect()}
    assert flags == {1: "long", 2: "short-after-long", 3: "long", 4: "short-after-long"}


def test_even_share_without_phonemes(spark):
    words = spark.createDataFrame([(0, "a", "1:1:1", 1, 1, 0), (1, "b", "1:1:2", 1, 1, 0)], "global_pos bigint, text string, word_ref string, sura_no bigint, aya_no bigint, n_phonemes bigint")
    seg = spark.createDataFrame([(1, 0, 0, 1, 2.0, 5.0)], "recording bigint, segment_idx bigint, start_pos bigint, end_pos bigint, time_start double, time_end double")
    got = timing.distribute_word_times(seg, words, ["recording", "segment_idx"]).orderBy("global_pos").collect()
    assert [(r["start"], r["end"]) for r in got] == [(2.0, 3.5), (3.5, 5.0)]
