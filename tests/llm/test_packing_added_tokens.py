import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from lectern.llm import packing, queries
from tokenizers import Tokenizer

from tests.llm.cases import LONG, TEXTS, frame

HOLDING = [
    (20, "end <|endoftext|> next"), (21, "<|endoftext|>"), (22, "a  <|endoftext|><|endoftext|>\n\nb <|endoftext|"),
    (23, "漢字 <|endoftext|> x"), (24, LONG + "  <|endoftext|> " + LONG), (25, "<|endoftext |> <|ENDOFTEXT|>"),
]


def _want(texts):
    """Pieces by the contract's call: the plain tokenizer, no tokens put around the text."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in texts:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        for k, (a, n) in enumerate(packing.cuts(ids.size, packing.SEQUENCE)):
            want.append((str(doc_id), k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
    return sorted(want)


@pytest.mark.parametrize("of", ["query", "pipeline"])
def test_string_of_an_added_token_is_that_token(spark, tmp_path, of):
    texts = [*TEXTS, *HOLDING]
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op8_packing(spark, str(tmp_path)) if of == "query" else cp.pack(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()) == _want(texts)


def test_ids_of_the_named_example():
    import pyarrow as pa

    (ids,) = packing.Encoder(added_tokens=True).encode(pa.array(["end <|endoftext|> next"]))
    assert ids.tolist() == [437, 220, 50256, 1306]
