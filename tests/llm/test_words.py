import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import text as tx

from tests.llm.cases import ALNUM, LOWER, SPACED

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\r\x0b.,-_é漢\x00\x7f", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_equal_the_regular_expressions(texts):
    for table, pattern, lower in ((tx.SPACED, SPACED, False), (tx.ALNUM, ALNUM, True)):
        words = tx.Words(pa.array(texts, pa.string()), table, lower=lower)
        want = [pattern.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        assert [w.decode() for w in words.strings().to_pylist()] == [w for ws in want for w in ws]
        assert words.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        named = dict(zip(flat, words.digests().tolist()))
        assert [named[w] for w in flat] == words.digests().tolist()
        assert len(set(named.values())) == len(named)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=150), st.sampled_from([1, 2, 5, 8, 9, 31, 50]))
def test_windows_are_equal_exactly_where_the_words_are(words, width):
    digests = tx.mix(np.array(words, dtype=np.uint64) + np.uint64(1))
    found = tx.windows(digests, width)
    want = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    assert len(found) == len(want)
    assert len(set(found.tolist())) == len(set(want))
    assert len(set(zip(found.tolist(), want))) == len(set(want))


def test_slices_and_pieces_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa bb", None, "c" * 50, "", "d"])], names=["text"]).slice(1)
    parts = list(tx.pieces(batch, target=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [None, "c" * 50, "", "d"]
    assert tx.Words(batch.column("text"), tx.SPACED).counts.tolist() == [0, 1, 0, 1]
