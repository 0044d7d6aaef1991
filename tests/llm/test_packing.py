import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from lectern.llm import packing, queries
from tokenizers import Tokenizer

from tests.llm.cases import TEXTS, count, empty, frame, table, texts_of


def _tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def _check(rows, texts, size=packing.SEQUENCE):
    """Every document's ids once and in order, sequences without gaps."""
    tokenizer = _tokenizer()
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        head = ids.size % size or size
        bounds = [0, ids.size] if ids.size <= size else [0, *range(head, ids.size + 1, size)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(n * k[3] for k, n in want.items()), len(sequences)


def test_query_is_a_round_trip_and_nearly_full(spark, small_dir):
    rows = queries.op8_packing(spark, small_dir).collect()
    total, used = _check(rows, texts_of(table(spark, small_dir, "documents")))
    assert dict(queries.op8_packing(spark, small_dir).dtypes)["piece"] == "int"
    assert used <= 1.02 * -(-total // packing.SEQUENCE) + 2


def test_cases_ids_and_special_strings(spark):
    texts = [*TEXTS, (20, "<|endoftext|> is text here"), (21, "԰ა 中文 \U0001f9d1‍\U0001f680 x"), (22, "it's  we'll   1234 café")]
    docs = frame(spark, texts).repartition(2)
    found = packing.pack(docs, keep=docs.columns, with_ids=True, added_tokens=False)
    _check(found.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), texts)
    tokenizer = _tokenizer()
    parts = defaultdict(list)
    for r in found.collect():
        parts[(r.doc.doc_id, r.doc.text)].append((r.start, r.ids))
    for (_, text), pieces in parts.items():
        ids = [i for _, p in sorted(pieces) for i in p]
        one = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        assert ids == one * (len(ids) // len(one)) or sorted(ids) == sorted(one * (len(ids) // len(one)))
    assert count(packing.pack(empty(spark))) == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, open_bins=2)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # fills sequence 0, which leaves the open ones
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # two are open: the fullest, 2, closes
    assert bins.place(2) == (1, 5)
    assert bins.place(1) == (3, 9)
    assert bins.open == 1


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]
