"""The best of the next words is found as by comparing all of them."""

import random

from lectern.streaming import recitation


def plain(word, expected, pointer, window, least):
    best, at = 0.0, None
    for i in range(pointer, min(len(expected), pointer + window)):
        s = recitation.likeness(word, expected[i])
        if s > best:
            best, at = s, i
    return at if at is not None and best >= least else None


def test_best_ahead_is_the_plain_search():
    draw = random.Random(5)
    for _ in range(20_000):
        letters = draw.choice(["ab", "abcde", "abcdefghijklmnop"])
        words = ["".join(draw.choices(letters, k=draw.choice([0, 1, 3, 5, 8, 70]))) for _ in range(8)]
        asked = (words[0], words[1:], draw.randrange(8), draw.randrange(1, 8), draw.choice([0.4, 0.5, 0.6, 0.7, 1.0]))
        assert recitation.best_ahead(*asked) == plain(*asked)


def test_equal_and_hopeless_words_cost_no_edit_distance(monkeypatch):
    monkeypatch.setattr(recitation, "likeness", None)
    monkeypatch.setattr(recitation, "_edits", None)
    assert recitation.best_ahead("abc", ["xyz", "abd", "abc"], 0, 3, 0.6) == 2
    assert recitation.best_ahead("abc", ["xyz", "a", "abcdefgh"], 0, 3, 0.6) is None
