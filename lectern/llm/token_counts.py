"""Token counts of whole texts; huge ones by overlapping chunks that are spliced.

A text of up to one chunk is encoded where it is read. A longer one is cut into chunks that
overlap; its chunks are dealt over all tasks and encoded each for itself, with the byte offset
of every token. Two neighbours are spliced where **both** have a token boundary at the same
place of the overlap and the place is proven stable:

* the characters around it cannot stand in one piece of the pattern that splits text before
  the merges, whatever comes before or after (a letter and a non-letter, a digit and a
  non-digit, or a sign before a blank or a digit);
* it lies far enough from the end of the first chunk that no added token can reach across.

Before such a place the first chunk's tokens are those of the whole text, after it the second
chunk's; so the text has the last chunk's tokens and, for every seam, the first chunk's tokens
before the place less the second's. Those are sums, whatever the number of chunks. Where a
seam has no such place (one unbroken run longer than the overlap), the text goes through
another round with an overlap four times as wide, until all seams hold or one chunk is left.

Byte-level vocabularies give every token a fixed number of bytes, so offsets are running sums;
that they end with the text is checked for every chunk.

Cases: a null or empty text has no tokens and no bytes; the string of an added token is that
token, as in a plain call of ``tokenizers``; repeated rows are counted each for itself; an
empty table gives no rows. Other columns are carried in the struct ``doc`` where asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.session import through_table
from lectern.llm.packing import Encoder
from lectern.llm.text import pieces, text_bytes

CHUNK_BYTES = 32 << 10
OVERLAP_BYTES = 1 << 10
WIDER = 4
LIMIT = 1024
_STABLE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}\p{C}\p{Z}])(?=[ \t\n]|\p{N})")


class Offsets:
    """An encoder that knows how many bytes each of its ids stands for."""

    def __init__(self, model: str, ranks: str) -> None:
        self.encoder = Encoder(model, ranks, added_tokens=True)
        added = {i: len(t.content.encode()) for i, t in self.encoder.slow.get_added_tokens_decoder().items()}
        fast = self.encoder.fast
        self.sizes = np.zeros(max(fast.n_vocab, max(added, default=-1) + 1), dtype=np.int64)
        self.sizes[: fast.n_vocab] = [len(fast.decode_single_token_bytes(i)) for i in range(fast.n_vocab)]
        for i, size in added.items():
            self.sizes[i] = size
        #: bytes at a chunk's end that an added token, or the pattern's look-ahead, may change
        self.margin = max([16, *(2 * size for size in added.values())])

    def counts(self, texts: pa.Array) -> list[int]:
        return [ids.size for ids in self.encoder.encode(texts)]

    def ends(self, body: bytes) -> np.ndarray:
        """Byte offset after each token."""
        ids = next(self.encoder.encode(pa.array([body.decode("utf-8")], pa.large_string())))
        ends = np.cumsum(self.sizes[ids])
        if (ends[-1] if ends.size else 0) != len(body):
            raise ValueError("tokens do not cover the text: the vocabulary is not byte-level")
        return ends


def char_start(body: np.ndarray, at: int) -> int:
    """The start of the character that holds byte ``at``."""
    while 0 < at < body.size and (body[at] & 0xC0) == 0x80:
        at -= 1
    return at


def chunk_spans(body: np.ndarray, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Extents of overlapping chunks: each begins ``overlap`` bytes before the one before ends."""
    count = max(1, -(-(body.size - overlap) // chunk))
    starts = [char_start(body, k * chunk) for k in range(count)]
    stops = [char_start(body, (k + 1) * chunk + overlap) for k in range(count - 1)]
    return list(zip(starts, [*stops, body.size]))


def stable(body: bytes, ends: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Proven boundaries of a chunk in ``low < place < high``, and the tokens before each."""
    view = np.frombuffer(body, dtype=np.uint8)
    low, high = char_start(view, low), char_start(view, high)
    text = body[low:high].decode("utf-8")
    found = np.array([m.start() for m in _STABLE.finditer(text)], dtype=np.int64)
    part = view[low:high]
    places = low + np.flatnonzero((part & 0xC0) != 0x80)[found] if found.size else found
    spot = np.searchsorted(ends, places)
    kept = ends[np.minimum(spot, ends.size - 1)] == places if places.size else np.zeros(0, dtype=bool)
    return places[kept], spot[kept] + 1


SEAMS = "row long, seam long, tokens long, before struct<at: array<long>, n: array<long>>, after struct<at: array<long>, n: array<long>>"
_SIDE = pa.struct([("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_SEAMS_ARROW = pa.schema([("row", pa.int64()), ("seam", pa.int64()), ("tokens", pa.int64()), ("before", _SIDE), ("after", _SIDE)])


def seam_rows(offsets: Offsets, row: int, number: int, at: int, last: bool, body: bytes, overlap: int) -> Iterator[dict]:
    """What a chunk knows of the seams at its two ends; the last chunk also gives its tokens."""
    ends = offsets.ends(body)

    def side(low: int, high: int) -> dict:
        places, n = stable(body, ends, max(0, low), max(0, high))
        return {"at": (places + at).tolist(), "n": n.tolist()}

    if number:
        yield {"row": row, "seam": number - 1, "tokens": 0, "before": None, "after": side(0, overlap)}
    if last:
        yield {"row": row, "seam": number, "tokens": int(ends.size), "before": None, "after": None}
    else:
        yield {"row": row, "seam": number, "tokens": 0, "before": side(len(body) - overlap, len(body) - offsets.margin), "after": None}


def spliced(seams: DataFrame) -> DataFrame:
    """row, n_tokens, and whether a seam is still ``open``."""
    met = seams.groupBy("row", "seam").agg(
        F.sum("tokens").alias("tokens"), F.first("before", ignorenulls=True).alias("before"), F.first("after", ignorenulls=True).alias("after")
    )
    place = F.array_min(F.array_intersect("before.at", "after.at"))
    tokens = lambda side: F.element_at(f"{side}.n", F.array_position(f"{side}.at", F.col("place")).cast("int"))
    met = met.withColumn("place", place).withColumn("moved", F.when(F.col("place").isNotNull(), tokens("before") - tokens("after")))
    inner = F.col("before").isNotNull() | F.col("after").isNotNull()
    return met.groupBy("row").agg(
        (F.sum("tokens") + F.sum(F.coalesce("moved", F.lit(0)))).cast("long").alias("n_tokens"),
        F.max(inner & F.col("place").isNull()).alias("open"),
    )


def _huge(rows: DataFrame, chunk: int, overlap: int, model: str, ranks: str) -> DataFrame:
    """row and n_tokens of a table (row, text), by overlapping chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for n, row in enumerate(batch.column(0).to_pylist()):
                body = data[offsets[n] : offsets[n + 1]]
                spans = chunk_spans(body, chunk, overlap)
                for k in range(0, len(spans), 64):
                    some = spans[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int64()),
                            pa.array(range(k, k + len(some)), pa.int64()),
                            pa.array([a for a, _ in some], pa.int64()),
                            pa.array([k + i == len(spans) - 1 for i in range(len(some))]),
                            pa.array([body[a:b].tobytes() for a, b in some], pa.binary()),
                        ],
                        names=["row", "chunk", "at", "last", "body"],
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets(model, ranks)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "chunk", "at", "last")]
            for row, number, at, last, body in zip(*columns, batch.column("body")):
                yield pa.RecordBatch.from_pylist(list(seam_rows(offsets, row, number, at, last, body.as_py(), overlap)), schema=_SEAMS_ARROW)

    chunks = rows.mapInArrow(cut, "row long, chunk long, at long, last boolean, body binary").repartition("row", "chunk")
    return spliced(chunks.mapInArrow(encoded, SEAMS))


def count(
    docs: DataFrame,
    keep: Iterable[str] = ("doc_id",),
    model: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    chunk_bytes: int = CHUNK_BYTES,
    overlap_bytes: int = OVERLAP_BYTES,
    limit: int = LIMIT,
) -> DataFrame:
    """A row per document: ``doc`` (struct of ``keep``), n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    alone = chunk_bytes + overlap_bytes
    schema = T.StructType([rows.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets(model, ranks)
        for batch in batches:
            for part in pieces(batch):
                n = pa.array(offsets.counts(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("n_bytes"), n], names=schema.names)

    found = rows.where(F.col("n_bytes") <= alone).select("doc", "text", "n_bytes").mapInArrow(counted, schema)
    huge = through_table(rows.where(F.col("n_bytes") > alone).withColumn("row", F.monotonically_increasing_id()), "huge")
    left = huge
    while not left.isEmpty():
        made = through_table(_huge(left.select("row", "text"), chunk_bytes, overlap_bytes, model, ranks), "spliced")
        found = found.unionByName(huge.drop("text").join(made.where("not open"), "row").select("doc", "n_bytes", "n_tokens"))
        left = huge.join(made.where("open").select("row"), "row", "left_semi")
        overlap_bytes *= WIDER
        chunk_bytes = max(chunk_bytes, WIDER * overlap_bytes)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
