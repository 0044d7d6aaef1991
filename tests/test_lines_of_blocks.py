"""Blocks and spoken words cross the network as lines; verses, not words, meet sessions."""

import pyarrow as pa

from lectern.operators import locate, matching, packed
from lectern.operators.packed import Corpus
from lectern.plans.corpus_tables import packed_corpus
from lectern.sources import bindings
from tests.test_timed_parts import corpus

SCHEMA = "start bigint, texts array<string>, norms array<string>"


def test_lines_of_a_block_hold_its_words(spark, monkeypatch):
    rows = [(0, ["a", "b"], ["", "b"]), (2, ["c"], [""]), (3, [], None), (3, ["d", "e", "f", "g"], None), (7, ["h"], ["i"])]
    plain = Corpus(spark.createDataFrame(rows, SCHEMA))
    for word in ("norm", "text"):
        for width, overlap in ((3, 0), (3, 2), (4, 1), (100, 0)):
            want = {r.block: (r.base, r.words) for r in plain.blocks(width, overlap, word=word).collect()}
            asked = spark.createDataFrame([(b,) for b in range(5)], "block bigint")
            got = {}
            for r in sorted(plain.block_lines(asked, width, overlap, word).collect(), key=lambda r: r.low):
                got.setdefault(r.block, (r.base, []))[1].extend(r.line.split(" "))
            assert got == want
    met = []
    monkeypatch.setattr(packed, "BLOCK_WORDS", 4)
    given = spark.createDataFrame([(0, 0, 2), (1, 6, 2)], "who bigint, _at bigint, _reach bigint")
    keep = lambda left, base, words: pa.table({"who": left.column("who"), "got": pa.array([f"{base}:" + "/".join(words.to_pylist())] * left.num_rows, pa.string())})
    met = {r.who: r.got for r in packed.over_blocks(given, plain, keep, "who bigint, got string").collect()}
    assert met == {0: "0:/b//d/e/f/g/i", 1: "0:/b//d/e/f/g/i"}


def test_rows_that_say_nothing_keep_their_place(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, 0, ["بسم", "الله"]), (2, 0, 1, 0, []), (3, 0, 1, 1, ["ن"]), (4, 0, 1, 0, ["زززز"])],
        "session bigint, chunk bigint, page bigint, pointer bigint, words array<string>",
    )
    got = {r.session: (r.matched_up_to, r.errors) for r in matching.match_chunks(rows, corpus(spark)).collect()}
    assert got[1] == (3, [1]) and got[3] == (2, []) and 2 not in got


def test_states_are_joined_by_verse(spark):
    held = corpus(spark)
    sessions = spark.createDataFrame([("a", 1, 4, None), ("b", 1, 0, 2), ("c", 2, 3, None), ("d", 9, 0, None)], "session string, page bigint, pointer bigint, paused_at bigint")
    errors = spark.createDataFrame([("a", 1), ("a", 1), ("a", 6), ("c", 0), ("c", 99), ("z", 1)], "session string, flat_index bigint")
    rows = matching.reveal_state(sessions, errors, held)
    words = {(r.page, r.flat_index): r.word_ref for r in held.words().collect()}
    got = {(r.session, r.flat_index): (r.word_ref, r.revealed, r.is_error, r.is_current) for r in rows.collect()}
    told = {"a": (1, 4, None), "b": (1, 0, 2), "c": (2, 3, None)}
    bad = {("a", 1), ("a", 6), ("c", 0)}
    assert got == {
        (s, i): (ref, i < at, (s, i) in bad, i == (at if paused is None else paused))
        for s, (page, at, paused) in told.items() for (p, i), ref in words.items() if p == page
    }
    above = rows._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "Generate explode" in above and "BroadcastHashJoin" not in above.split("Generate explode")[0]  # no word is shuffled or joined


def test_scores_are_the_same_without_where_starts_were_found(spark, small_dir):
    held, prepared = packed_corpus(spark, small_dir), locate.prepared_queries(bindings.passage_queries(spark, small_dir))
    starts = locate.candidate_starts(locate.select_anchors(prepared, held), held.words())
    told = [locate.score_candidates(starts, prepared, held, with_found=f) for f in (True, False)]
    columns = ["query_id", "start", "n_words", "matched", "first_match"]
    rows = [sorted(map(str, t.select(columns).collect())) for t in told]
    assert rows[0] == rows[1] and rows[0] and told[1].columns == columns
