"""Texts as numpy arrays: words of many documents at once, their digests and their runs.

Texts are taken as UTF-8 bytes. Both word alphabets used here are decided by single bytes
(every byte of a character beyond ASCII counts as a letter), so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

_BYTES = np.arange(256)
#: words ``[^\x20\x09-\x0D]+``
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z lower-cased
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)
#: by number of bytes kept of a little-endian eight
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word. Works in cache-sized steps."""
    out = np.array(x, dtype=np.uint64)
    room = np.empty(min(out.size, 1 << 14), dtype=np.uint64)
    for a in range(0, out.size, 1 << 14):
        v = out[a : a + (1 << 14)]
        t = room[: v.size]
        for shift, factor in ((_S30, _MIX1), (_S27, _MIX2), (_S31, None)):
            np.right_shift(v, shift, out=t)
            np.bitwise_xor(v, t, out=v)
            if factor is not None:
                np.multiply(v, factor, out=v)
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digest of an ordered pair of digests."""
    return mix(a * _ODD + (b ^ np.uint64(0xD6E8FEB86659FD93)))


class Words:
    """Words of a run of documents: bytes, extents, and the document each belongs to.

    ``first[d]:first[d + 1]`` are the words of document ``d``. A null text has no words.
    """

    def __init__(self, texts: pa.Array, alphabet: np.ndarray, lower: bool = False) -> None:
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = alphabet[self.data]
        edge = np.empty(inside.size + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = (inside[0], inside[-1]) if inside.size else (False, False)
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < inside.size)]
        cut = cut[np.diff(cut, prepend=-1) > 0]
        joined = cut[inside[cut] & inside[cut - 1]]
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[0::2], bounds[1::2]
        if joined.size:  # a word ends where its document ends
            starts = np.sort(np.concatenate([starts, joined]))
            ends = np.sort(np.concatenate([ends, joined]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, self.offsets).astype(np.int64)

    def __len__(self) -> int:
        return self.starts.size

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """Document of every word."""
        return np.repeat(np.arange(self.first.size - 1), self.counts)

    def strings(self) -> pa.Array:
        """Words as an Arrow array."""
        lengths = self.ends - self.starts
        out = np.zeros(lengths.size + 1, dtype=np.int64)
        np.cumsum(lengths, out=out[1:])
        take = np.ones(out[-1], dtype=np.int64)
        if lengths.size:
            take[0] = self.starts[0]
            take[out[1:-1]] = self.starts[1:] - self.ends[:-1] + 1
        body = self.data[np.cumsum(take)] if take.size else np.zeros(0, dtype=np.uint8)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), lengths.size, [None, pa.py_buffer(out), pa.py_buffer(body)])

    def digests(self) -> np.ndarray:
        """64-bit digest of every word's bytes and length, eight bytes at a time."""
        lengths = self.ends - self.starts
        out = lengths.astype(np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray((self.data.size + 1,), dtype="<u8", buffer=padded, strides=(1,))
        done, left = 0, np.arange(lengths.size)
        while left.size:
            kept = _KEEP[np.minimum(lengths[left] - done, 8)]
            value = eights[self.starts[left] + done] & kept
            if left.size == out.size:
                out = pair(out, value)
            else:
                out[left] = pair(out[left], value)
            done += 8
            left = left[lengths[left] > done]
        return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", target: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about ``target`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    part = offsets[:-1] // target
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not sorted_values.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return start, np.diff(np.append(start, sorted_values.size))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's slice ``first[d]:first[d + 1]``; 0 for an empty one."""
    total = np.zeros(values.size + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def windows(digests: np.ndarray, width: int) -> np.ndarray:
    """Digest of ``width`` consecutive words from every word on; only as many as fit.

    Polynomial over prefix sums: any two equal windows agree, wherever they stand.
    """
    if digests.size < width:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(digests.size - width + 1, dtype=np.uint64)
    for k in range(width) if width <= 8 else ():
        out = out * _ODD + digests[k : k + out.size]
    if width > 8:  # by doubling
        power, done, block, n = _ODD, 0, digests, 1
        left, bits = width, []
        while left:
            bits.append((block, n, power) if left & 1 else None)
            left >>= 1
            if left:
                block = block[:-n] * power + block[n:] if block.size > n else block[:0]
                n, power = 2 * n, np.uint64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
        for part in bits:
            if part is not None:
                block, n, power = part
                out = out * power + block[done : done + out.size]
                done += n
    return mix(out)
