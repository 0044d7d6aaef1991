import re
import time

from lectern.llm import license_scan as ls
from lectern.llm import queries
from lectern.llm.license_rules import rules

from tests.llm.cases import TEXTS, alnum, count, empty, frame, table, texts_of

PHRASES = [(label, phrase.split()) for label, phrase in ls.BASE]


def _base(text):
    words, starts, found = alnum(text), [], set()
    for label, phrase in PHRASES:
        for k in range(len(words) - len(phrase) + 1):
            if words[k : k + len(phrase)] == phrase:
                starts.append(k)
                found.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def test_query_equals_plain_search(spark, small_dir):
    texts = dict(texts_of(table(spark, small_dir, "documents")))
    for r in queries.op5_license_scan(spark, small_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_every_rule_can_fire_only_with_its_keyword():
    table_ = rules()
    assert len(table_) >= 200
    for rule in table_:
        assert rule.keyword.strip() in rule.pattern and 0 <= rule.priority < ls._LEVELS
        assert re.compile(rule.pattern).match("") is None


def _standing(text):
    """Places of every rule, then containment by the plain definition."""
    norm = " " + " ".join(alnum(text)) + " "
    found = []
    for r in rules():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, r.priority, r.label))
    ranked = sorted(found, key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = []
    for k, d in enumerate(ranked):
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] for e in ranked[:k]):
            kept.append(d)
    return kept


def test_detections_and_suppression(spark):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0; see LICENSE. MIT license mit License."),
        (2, "SPDX-License-Identifier: GPL-2.0-or-later and the GNU General Public License version 3 or (at your option) any later version"),
        (3, "This work is licensed under CC BY-NC-SA 4.0, Creative Commons Attribution ShareAlike 3.0 Unported. All rights reserved."),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. gnu general public license " * 40),
        (5, "nothing here about beer or commercial cc things"),
    ]
    for r in ls.scan(frame(spark, texts)).collect():
        got = [(d.start, d.stop, d.priority, d.label) for d in r.standing]
        assert got == _standing(dict(texts)[r.doc.doc_id])


def test_cases(spark):
    docs = frame(spark)
    rows = ls.summarise(ls.scan(docs, keep=docs.columns)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(r.doc.text)
        if not r.n_words:
            assert (r.labels, r.score) == ("", 0.0)
    assert count(ls.summarise(ls.scan(empty(spark)))) == 0


def test_a_hundred_thousand_mentions_in_one_text(spark):
    lines = ["under the mit license and ", "gnu general public license version 3 or any later version ", "word "]
    text = "".join(lines[k % 3] for k in range(150_000))
    docs = frame(spark, [(1, text), (2, "mit license"), (3, lines[1] * 700)])
    begin = time.time()
    rows = {r.doc.doc_id: r for r in ls.summarise(ls.scan(docs)).collect()}
    assert time.time() - begin < 60
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == _base(text)
    standing = {r.doc.doc_id: r.standing for r in ls.scan(docs).where("doc.doc_id = 3").collect()}
    got = [(d.start, d.stop, d.priority, d.label) for d in standing[3]]
    assert got == _standing(lines[1] * 700)
