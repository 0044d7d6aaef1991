"""Lanes that tasks ask: alignments of every width and letters told by places, against the forms for one pair."""

import random

import numpy as np

from lectern.functions import lanes
from lectern.operators import align


def test_alignments_of_every_width_equal_one_by_one():
    rng = np.random.default_rng(11)
    said, heard, ends = [], [], []
    for m in (1, 31, 32, 33, 63, 64, 65, 128, 129, 600):
        for k in range(lanes._FEW + 1):
            n, kinds = int(rng.integers(1, 90)), 3 if k % 2 else 25
            said.append(rng.integers(0, kinds, m))
            heard.append(rng.integers(0, kinds, n))
            heard[-1][: min(m, n)] = said[-1][: min(m, n)] if k % 3 else heard[-1][: min(m, n)]
            ends.append(np.append(rng.random(n - 1) < 0.3, True))
    wanted = [lanes.free_alignment(s, h, np.flatnonzero(e) + 1) for s, h, e in zip(said, heard, ends)]
    assert list(zip(*[x.tolist() for x in lanes.free_alignments(said, heard, ends)])) == wanted
    assert [lanes._free_alone(s, h, e) for s, h, e in zip(said, heard, ends)] == wanted


def test_window_subsequences_equal_written_out_windows():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdeقم \U0001f600", k=700))
    patterns = ["", "x", "abc", *["".join(rng.choices("abcdeقم ", k=k)) for k in (5, 63, 64, 65, 130, 520)]]
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    i = np.array([rng.randrange(len(patterns)) for _ in range(400)])
    begin, size = np.array([rng.randrange(600) for _ in i]), np.array([rng.randrange(100) for _ in i])
    wanted = [lanes.common_subsequence(patterns[k], text[b : b + s]) for k, b, s in zip(i, begin, size)]
    assert lanes.window_subsequences(patterns, codes, i, begin, size).tolist() == wanted
    assert lanes.window_subsequences(["", ""], codes, i % 2, begin, size).tolist() == [0] * i.size


def test_windows_of_many_rows_in_several_rounds_equal_one_round(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("bdfgklmn", k=rng.randint(1, 6))) for _ in range(300)]
    held = [align._Words(k * 100, words[k * 100 : k * 100 + 100], [], size=np.zeros(100, dtype=np.int64)) for k in range(3)]
    asked = [(" ".join(words[k : k + 11]), held[k // 100], k // 100 * 100, k // 100 * 100 + 99) for k in range(0, 290, 7)] + [(None, held[0], 0, 99)]
    whole = align._likest(asked)
    monkeypatch.setattr(align, "ANCHOR_WINDOWS", 20)
    assert align._likest(asked) == whole and sum(place is not None for place, _ in whole) > 20 and whole[-1] == (None, 0.0)
