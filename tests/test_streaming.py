"""Streams give what their tables give, trigger by trigger."""

from pyspark.sql import functions as F

from lectern.functions.session import fresh_path
from lectern.plans.corpus_tables import corpus_words, packed_corpus
from lectern.sources import bindings
from lectern.streaming import follow, recitation
from lectern.streaming.folds import run_to_table
from workload.streams import _heard, detect_position, follow_position


def test_tracking_equals_its_table(spark, small_dir):
    words = corpus_words(spark, small_dir)
    said = bindings.recitation_stream(packed_corpus(spark, small_dir).parts("sura_no", "page"))
    # one trigger per file; a session's rows arrive in order within and across triggers
    path = fresh_path(spark, "said")
    top = said.agg(F.max("seq")).first()[0]
    for low, high in ((-1, 3), (3, 9), (9, top)):
        said.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(path)
    for strict in (False, True):
        stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = run_to_table(recitation.track_recitation(stream, words, strict), "tracked")
        want = recitation.track_recitation(said, words, strict)
        assert got.count() > 0
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_out_of_order_rows_give_the_tables_events(spark):
    corpus = spark.createDataFrame([(1, k, w) for k, w in enumerate("one two three four five six".split())], "page long, flat_index long, norm string")
    said = [
        ("a", 1, 1, 1.0, "one"), ("a", 1, 3, 3.0, "three"), ("b", 1, 1, 1.5, "two"), ("a", 1, 2, 2.0, "two"),
        ("b", 1, 2, 4.0, "four"), ("a", 1, 4, 4.5, "five six"), ("c", 9, 1, 3.0, "lost"),
    ]
    last = [("z", 1, 1, 1000.0, "one"), ("z", 1, 2, 2000.0, "two")]  # moves the watermark past all others
    schema = "session string, page long, seq long, ts double, kind string, text string, is_final boolean"
    table = lambda rows: spark.createDataFrame([(s, p, n, t, "asr", w, True) for s, p, n, t, w in rows], schema)
    want = recitation.track_recitation(table(said), corpus)
    seen = []
    for deal in ([said[:2], said[2:5], said[5:]], [said[1::2], said[0::2]], [said[::-1]]):
        path = fresh_path(spark, "late")
        for rows in [*deal, last[:1], last[1:]]:
            table(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = run_to_table(recitation.track_recitation(stream, corpus, lateness="30 seconds"), "late")
        got = got.filter("session <> 'z'")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        seen.append(got.count())
    assert len(set(seen)) == 1 and seen[0] > 4
    assert not want.filter("session = 'c'").isEmpty()


def step_through(rows, strict):
    state, out = recitation.start_tracking(), []
    step = recitation.tracking_step(strict)
    for seq, kind, words, final in rows:
        row = {"seq": seq, "kind": kind, "words": words.split(), "is_final": final, "expected": "one two three four five six".split(), "seconds": float(seq)}
        out.extend((t[1], t[2]) for t in step(state, row))
    return state, out


def test_strict_pauses_until_corrected():
    state, out = step_through(
        [(1, "asr", "one three", True), (2, "asr", "four", True), (3, "correct", "", False), (4, "asr", "three four five six", True)], True
    )
    assert out == [
        ("word-revealed", 0), ("error-detected", 1), ("error-corrected", 1),
        ("word-revealed", 2), ("word-revealed", 3), ("word-revealed", 4), ("word-revealed", 5), ("tracking-complete", None),
    ]
    assert state["n_errors"] == 1


def test_forgiving_and_interim():
    _, out = step_through([(1, "asr", "one", False), (2, "asr", "one two", False), (3, "asr", "four", True)], False)
    assert out == [("word-revealed", 0), ("word-revealed", 1), ("error-detected", 2), ("word-revealed", 3)]


def test_late_rows_are_dropped_and_locking_rules():
    def run(rows):
        state, phases = follow.start_detecting(), []
        for seq, score, matches, second, n_post, aya in rows:
            row = {"seq": seq, "n_words": 20, "n_post": n_post, "score": score, "match_count": matches, "page": 1, "sura_no": 1, "aya_no": aya, "page_word_offset": 0, "global_pos": 0, "runner_up": second}
            phases.extend(t[1] for t in follow.detect_step(state, row))
        return phases

    assert run([(1, 0.7, 6, 0.69, 8, 1)]) == ["locked"]
    assert run([(1, 0.7, 6, 0.69, 7, 1)]) == ["detecting"]
    assert run([(1, 0.55, 5, 0.5, 8, 1)] * 3) == ["detecting", "detecting", "locked"]
    assert run([(1, 0.55, 5, 0.5, 8, 1), (2, 0.55, 5, 0.5, 8, 2), (3, 0.55, 5, 0.5, 8, 1)]) == ["detecting"] * 3
    assert run([(1, 0.5, 4, 0.25, 8, 1)]) == ["locked"] and run([(1, 0.5, 4, None, 8, 1)]) == ["locked"]
    assert run([(1, 0.49, 4, None, 8, 1)]) == ["detecting"]


def test_following_equals_a_walk(spark, small_dir):
    words = corpus_words(spark, small_dir).orderBy("global_pos").collect()
    norm, page = [w["norm"] for w in words], [w["page"] for w in words]
    locks = {r["session"]: r for r in detect_position(spark, small_dir).filter("phase = 'locked'").collect()}
    heard = {}
    for r in _heard(spark, small_dir).orderBy("session", "seq").collect():
        heard.setdefault(r["session"], []).append(r)
    want = set()
    for session, lock in locks.items():
        at, known = lock["global_pos"], 0
        for r in heard[session]:
            if r["seq"] <= lock["seq"]:
                continue
            said = r["text"].split()
            for w in said[known:]:
                if at >= len(norm):
                    break
                end = at
                while end < len(norm) and page[end] == page[at] and end < at + 2:
                    end += 1
                found = recitation.best_ahead(w, norm[:end], at, 2, 0.45)
                if found is not None:
                    want.update((session, i) for i in range(at, found + 1))
                    at = found + 1
            known = 0 if r["is_final"] else max(known, len(said))
    got = {(r["session"], r["global_pos"]) for r in follow_position(spark, small_dir).collect()}
    assert got == want and got
