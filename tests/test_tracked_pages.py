"""Tracking reads all of a chapter: every page it has, wherever on the page it begins."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import normalize_arabic
from lectern.plans.corpus_tables import corpus_words
from lectern.streaming import recitation
from workload.streams import track_recitation, track_recitation_strict


@pytest.mark.parametrize("strict", [False, True])
def test_every_page_of_every_chapter_is_tracked(spark, small_dir, strict):
    words = corpus_words(spark, small_dir).select(
        "sura_no", "page", "flat_index", "norm", normalize_arabic(F.col("text")).alias("said"),
        normalize_arabic(F.reverse("text")).alias("back"),
    )
    parts = {}
    for w in words.orderBy("sura_no", "page", "flat_index").collect():
        parts.setdefault((w.sura_no, w.page), []).append(w)
    assert len({s for s, _ in parts}) < len(parts)  # chapters of several pages
    assert any(p[0].flat_index > 0 for p in parts.values())  # and some that begin within one
    step, want = recitation.tracking_step(strict), set()
    for (sura, page), part in parts.items():
        heard = [(i, w.back if i % 5 == 4 else w.said) for i, w in enumerate(part) if i % 7 != 6]
        state, last = recitation.start_tracking(), (len(part) - 1) // 8
        for chunk in range(last + 1):
            text = [w for i, w in heard if chunk // 3 * 24 <= i < chunk * 8 + 8]
            final = chunk % 3 == 2 or chunk == last
            rows = [{"seq": chunk * 2, "kind": "asr", "words": text, "is_final": final}]
            if final:
                rows.append({"seq": chunk * 2 + 1, "kind": "correct", "words": [], "is_final": False})
            for row in rows:
                row |= {"expected": [w.norm for w in part], "seconds": float(chunk * 3)}
                for seq, kind, at, *rest in step(state, row):
                    want.add((f"{sura}/{page}", seq, kind, None if at is None else at + part[0].flat_index, *rest))
    query = track_recitation_strict if strict else track_recitation
    rows = [tuple(r) for r in query(spark, small_dir).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[0] for r in rows} == {f"{s}/{p}" for s, p in parts}
