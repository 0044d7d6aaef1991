"""States of all sessions: no session, page or chunk that was matched is left out."""

from lectern.plans.corpus_tables import corpus_words
from workload.matching import matches, reveal_states


def test_states_of_all_sessions_after_all_chunks(spark, small_dir):
    pages = {}
    for w in corpus_words(spark, small_dir).select("page", "flat_index").collect():
        pages.setdefault(w.page, set()).add(w.flat_index)
    pointer, wrong, chunks = {}, {}, 0
    for m in matches(spark, small_dir).collect():
        key = (m.session, m.page)
        pointer[key] = max(pointer.get(key, 0), m.matched_up_to)
        wrong.setdefault(key, set()).update(m.errors)
        chunks += 1
    assert len({p for _, p in pointer}) < len(pointer) < chunks  # several sessions a page, several chunks each
    rows = reveal_states(spark, small_dir).select("session", "flat_index", "revealed", "is_error", "is_current").collect()
    want = {(f"{s}/{p}", i, i < at, i in wrong[s, p], i == at) for (s, p), at in pointer.items() for i in pages[p]}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
