"""Token packing by bounded-space online best-fit.

Documents are tokenised, ended by an end id and, where longer than a sequence, cut into
pieces of full length (the first piece takes the rest). Pieces are then placed one by one:
a piece goes to the open sequence that it fills best. The open sequences, at most
``open_bins``, are kept in a bitset keyed by free space, so best fit is one bit search; when
there is no room for another open one, the fullest closes first.

Every Spark partition packs what it reads, with its own open sequences: nothing is shuffled
and memory is bounded by one look-ahead of documents. Within a look-ahead the longer pieces
arrive first, which leaves the short ones to fill gaps.

Ids equal those of ``tokenizers`` with the named vocabulary. Text of the scripts below
U+0530 is encoded by ``tiktoken`` from the same ranks, several times faster; all other text
by ``tokenizers`` itself. The string of an added token of the vocabulary (``<|endoftext|>``)
stands for that token, as in a plain call of ``tokenizers``, which then encodes the texts that
hold one; without ``added_tokens`` the string is text like any other.

Cases: a null or empty text gives one piece, the end id alone; an exact multiple of the
sequence length gives full pieces only; repeated rows are packed each for itself; an empty
table gives no rows. Other columns are carried in the struct ``doc`` where asked for.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.text import pieces, text_bytes

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 4096
#: first byte of UTF-8 characters from about U+0540 on
_BEYOND = 0xD5


class Encoder:
    """Byte-level BPE of a public vocabulary, given as file names of ``public_tokenizers``."""

    def __init__(self, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", added_tokens: bool = True) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(model))
        self.slow.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()] if added_tokens else []
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = text_bytes(texts)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            body = data[a:b]
            text = body.tobytes().decode("utf-8")
            if not text:
                ids = []
            elif int(body.max()) < _BEYOND and not any(a in text for a in self.added):
                ids = self.fast.encode_ordinary(text)
            else:
                ids = self.slow.encode(text, add_special_tokens=False).ids
            yield np.array(ids, dtype="<u4")


class BestFit:
    """Online placement into sequences of ``size``, with a bounded number of open ones."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS, first: int = 0) -> None:
        self.size, self.open_bins, self.next = size, open_bins, first
        self.free_spaces = 0  # bit f is set where an open sequence has f places free
        self.held: dict[int, list[int]] = {}
        self.open = 0

    def _take(self, free: int) -> int:
        bins = self.held[free]
        number = bins.pop()
        if not bins:
            del self.held[free]
            self.free_spaces &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``length``."""
        fitting = self.free_spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.next
            self.next += 1
            if self.open >= self.open_bins and length < self.size:
                fullest = (self.free_spaces & -self.free_spaces).bit_length() - 1
                self._take(fullest)
        left = free - length
        if left:
            self.held.setdefault(left, []).append(number)
            self.free_spaces |= 1 << left
            self.open += 1
        return number, self.size - free


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``total`` ids."""
    head = total % size or size
    if total <= size:
        return [(0, total)]
    return [(0, head), *((at, size) for at in range(head, total, size))]


def pack(
    docs: DataFrame,
    keep: Iterable[str] = ("doc_id",),
    size: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    with_ids: bool = False,
    model: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    added_tokens: bool = True,
) -> DataFrame:
    """One row per piece: ``doc`` (struct of ``keep``), piece, start, length, ids_crc32,
    sequence_id, offset, and the ids themselves if asked for."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"))
    names = ("start", "length", "ids_crc32", "sequence_id", "offset")
    fields = [T.StructField("doc", rows.schema["doc"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in names]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, ranks, added_tokens)
        bins = BestFit(size, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in pieces(batch, target=8 << 20):
                found = []
                for n, ids in enumerate(encoder.encode(part.column("text"))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(ids.size, size)):
                        body = ids[start : start + length]
                        found.append((length, n, k, start, zlib.crc32(body.tobytes()), body if with_ids else None))
                found.sort(key=lambda x: -x[0])
                placed = [bins.place(x[0]) for x in found]
                columns = [
                    [x[3] for x in found],
                    [x[0] for x in found],
                    [x[4] for x in found],
                    [p[0] for p in placed],
                    [p[1] for p in placed],
                ]
                arrays = [part.column("doc").take(pa.array([x[1] for x in found], pa.int64())), pa.array([x[2] for x in found], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array([x[5].astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return rows.mapInArrow(packed, T.StructType(fields))
