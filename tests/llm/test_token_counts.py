import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lectern.llm import queries, token_counts
from tests.llm.cases import count, empty, frame, texts_of

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def _n(text):
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


def _check(got, docs):
    want = sorted((i, len((t or "").encode()), _n(t), _n(t) > 1024) for i, t in docs)
    assert sorted(got) == want


def test_query_equals_tokenizer(spark, small_dir):
    docs = texts_of(spark.read.parquet(f"{small_dir}/documents.parquet"))
    _check(map(tuple, queries.op11_token_counts(spark, small_dir).collect()), docs)


def _hard():
    rng = random.Random(11)
    words = ["don't", "we'll", "naïve", "żółć", "123", "4,567.89", "--", "\n\n", "  ", "\t", "<|endoftext|>", "漢字", "かな。", "\U0001f600", "'", "ΣΑΣ", "x" * 40, "<|endof", "text|>"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(n)) for n in (50, 400, 3000)]
    texts += ["ab" * 60_000, " " * 50_000, "word " * 20_000, "漢字かな" * 5000, "<|endoftext|>" * 3000, "a" * 3000 + " " + "b1" * 4000, "\U0001f600" * 4000, "'s" * 9000]
    return texts


def test_small_chunks_of_hard_texts(spark):
    docs = [*enumerate(_hard()), (50, None), (51, ""), (52, "x"), (52, "x"), (None, "y " * 900)]
    got = token_counts.count(frame(spark, docs).repartition(3), chunk_bytes=512, overlap_bytes=128).select("doc.doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, len((t or "").encode()), _n(t), _n(t) > 1024) for i, t in docs]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_cases(spark):
    df = frame(spark)
    docs = texts_of(df)
    got = [tuple(r) for r in token_counts.count(df, chunk_bytes=4096, overlap_bytes=256).select("doc.doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(((i, len((t or "").encode()), _n(t), _n(t) > 1024) for i, t in docs), key=key)
    assert count(token_counts.count(empty(spark))) == 0


def test_stable_places_are_boundaries_of_the_whole_text():
    offsets = token_counts.Offsets(*MODEL)
    for text in _hard()[:3]:
        body = text.encode()
        whole = set(offsets.ends(body).tolist())
        spans = token_counts.chunk_spans(np.frombuffer(body, dtype=np.uint8), 300, 100)
        for a, b in spans:
            part = body[a:b]
            last = b == len(body)
            places, n = token_counts.stable(part, offsets.ends(part), offsets.margin, len(part) - (0 if last else offsets.margin))
            assert {a + p for p in places.tolist()} <= whole
            assert all(offsets.ends(part[:p]).size == k for p, k in zip(places.tolist()[:5], n.tolist()[:5]))


def test_chunks_cover_and_overlap():
    for text in ("ż" * 1000, "a" * 1001, "漢" * 700):
        body = np.frombuffer(text.encode(), dtype=np.uint8)
        spans = token_counts.chunk_spans(body, 100, 30)
        assert spans[0][0] == 0 and spans[-1][1] == body.size
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c < b < d and b - c >= 26
            body[a:b].tobytes().decode("utf-8")


def test_counts_of_a_batch():
    offsets = token_counts.Offsets(*MODEL)
    texts = ["a b", None, "", "<|endoftext|> x"]
    assert offsets.counts(pa.array(texts)) == [_n(t) for t in texts]
