"""Removal of long passages that already stand in a document of smaller doc_id, by recompression.

Recompression rewrites a text in rounds: runs of one symbol become a symbol, then pairs of
neighbours whose symbols fall in the left and in the right half of the alphabet become one.
Names and halves depend on the symbols alone, so equal passages get equal symbols inside,
wherever they stand; only at their edges the surroundings show. The rounds are done on whole
blocks of documents; a name is the digest of what it stands for, the same in every block,
which makes it global without a shuffle per round.

For every symbol the words are tracked that its making has looked at. A symbol whose such
words all lie inside a window of ``WINDOW`` words must therefore occur wherever the window
does. So, in two exchanges of packed keys over the whole corpus:

1. high-level symbols: in how many documents each occurs. A window is still a candidate if
   each symbol it determines occurs in another document too (a window that determines none,
   as in very regular text, stays a candidate).
2. candidate windows, by digest: the least doc_id in which each starts. This verifies them.

A passage in a third of all documents is one key per block of documents in either exchange.

Cases: a null or empty text has no words; repeated rows with one doc_id remove nothing from
each other; a null doc_id counts as larger than any; texts shorter than a window lose
nothing; an empty table gives no rows; columns of any name are carried in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm import exchange
from lectern.llm.text import SPACED, Words, mix, pair, windows

WINDOW = 50
ROUNDS = 5
#: words that a symbol must span to be exchanged
LEAST = 3
_SIGN = np.uint64(1 << 63)


class Symbols:
    """Symbols of a block after the rounds: names, extents in words, and the words looked at."""

    def __init__(self, digests: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> None:
        document = np.repeat(np.arange(first.size - 1), np.diff(first))
        self.name, self.document = digests, document
        self.start = np.arange(digests.size)
        self.end = self.start + 1
        self.low, self.high = self.start, self.end
        self.edges = first
        for r in range(rounds):
            if self.name.size:
                self._runs()
                self._pairs(r)

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words looked at for the left and for the right neighbour of every symbol; beyond
        the document's edge that is the place outside it."""
        inner = self.document[1:] == self.document[:-1]
        begin, stop = self.edges[self.document], self.edges[self.document + 1]
        left_low, left_high = begin - 1, begin.copy()
        left_low[1:][inner], left_high[1:][inner] = self.low[:-1][inner], self.high[:-1][inner]
        right_low, right_high = stop.copy(), stop + 1
        right_low[:-1][inner], right_high[:-1][inner] = self.low[1:][inner], self.high[1:][inner]
        return left_low, left_high, right_low, right_high

    def _runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & (self.document[1:] == self.document[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        tail = np.append(head[1:], self.name.size) - 1
        left_low, left_high, right_low, right_high = self._beside()
        low, high = np.minimum.reduceat(self.low, head), np.maximum.reduceat(self.high, head)
        low = np.minimum(np.minimum(low, left_low[head]), right_low[tail])
        high = np.maximum(np.maximum(high, left_high[head]), right_high[tail])
        name = self.name[head]
        long = np.flatnonzero(tail > head)
        name[long] = pair(name[long], (tail - head)[long].astype(np.uint64))
        self.low, self.high, self.name = low, high, name
        self.start, self.end, self.document = self.start[head], self.end[tail], self.document[head]

    def _pairs(self, r: int) -> None:
        right = (mix(self.name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        joined = np.zeros(right.size, dtype=bool)
        joined[:-1] = ~right[:-1] & right[1:] & (self.document[1:] == self.document[:-1])
        gone = np.concatenate([[False], joined[:-1]])
        left_low, left_high, right_low, right_high = self._beside()
        alone_left, alone_right = right & ~gone, ~right & ~joined
        low, high = self.low.copy(), self.high.copy()
        low[alone_left] = np.minimum(low, left_low)[alone_left]
        high[alone_left] = np.maximum(high, left_high)[alone_left]
        low[alone_right] = np.minimum(low, right_low)[alone_right]
        high[alone_right] = np.maximum(high, right_high)[alone_right]
        at = np.flatnonzero(joined)
        low[at] = np.minimum(self.low[at], self.low[at + 1])
        high[at] = np.maximum(self.high[at], self.high[at + 1])
        name, end = self.name.copy(), self.end.copy()
        name[at] = pair(self.name[at], self.name[at + 1])
        end[at] = self.end[at + 1]
        kept = np.flatnonzero(~gone)
        self.low, self.high, self.name = low[kept], high[kept], name[kept]
        self.start, self.end, self.document = self.start[kept], end[kept], self.document[kept]


def _ranked(ids: pa.Array) -> np.ndarray:
    """doc_ids as unsigned numbers in the same order, null last."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    out = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN
    return np.where(known, out, np.uint64(0xFFFFFFFFFFFFFFFF))


def _by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the least and the largest id of each."""
    order = np.argsort(keys)
    ranked, ids = keys[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if ranked.size else order
    if not start.size:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none
    return ranked[start], np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)


class _Block:
    def __init__(self, block: pa.Table, rounds: int = 0) -> None:
        self.words = Words(block.column("text"), SPACED)
        self.digests = self.words.digests()
        self.ids = _ranked(block.column("id").combine_chunks() if isinstance(block.column("id"), pa.ChunkedArray) else block.column("id"))
        if rounds:
            symbols = Symbols(self.digests, self.words.first, rounds)
            long = symbols.end - symbols.start >= LEAST
            self.name, self.low, self.high = symbols.name[long], symbols.low[long], symbols.high[long]
            self.owner = symbols.document[long]

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct symbols, and 1 or 2 as one or more documents of the block hold each."""
        keys, least, largest = _by_key(self.name, self.ids[self.owner])
        return keys, 1 + (least != largest).astype(np.uint64)

    def window_digests(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Digest of the window at every word, and whether it lies in one document."""
        found = windows(self.digests, window)
        document = self.words.documents()
        return found, document[: found.size] == document[window - 1 :][: found.size]


def _cover(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the spans."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps)[:-1] > 0


def _kept_text(words: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words, each followed by one blank, and where each document's begin."""
    starts, ends = words.starts[kept], words.ends[kept]
    at = np.zeros(starts.size + 1, dtype=np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    take = np.ones(at[-1], dtype=np.int64)
    if starts.size:
        take[0] = starts[0]
        take[at[1:-1]] = starts[1:] - ends[:-1]
    body = np.append(words.data, np.uint8(0x20))[np.cumsum(take)] if take.size else np.zeros(0, dtype=np.uint8)
    body[at[1:] - 1] = 0x20
    before = np.zeros(kept.size + 1, dtype=np.int64)
    np.cumsum(kept, out=before[1:])
    return body.tobytes(), at[before[words.first]]


def deduplicate(docs: DataFrame, keep: Iterable[str] = ("doc_id",), window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """``doc`` (a struct of ``keep``), n_words, n_removed, kept_sha256 and, if asked for,
    ``kept_text``: the text as it was where nothing is removed, else the kept words."""
    table = exchange.blocks(docs, keep, "passage_blocks", {"id": docs["doc_id"].cast("long")})
    buckets = exchange.bucket_count(table, 0.05)

    def symbols(block: pa.Table) -> tuple:
        own = _Block(block, rounds)
        return *own.holders(), None

    first = exchange.answer(exchange.send(table, symbols, buckets), "symbol_holders")

    def candidates(block: pa.Table, told: pa.Table) -> pa.Table:
        own = _Block(block, rounds)
        keys, holders = own.holders()
        shared = exchange.settle(keys, holders, told)[np.searchsorted(keys, own.name)] > 1
        digests, whole = own.window_digests(window)
        # a symbol of one document only rules out the windows that determine it
        new = ~shared & (own.high - own.low <= window)
        from_, to = np.maximum(own.high[new] - window, 0), np.minimum(own.low[new] + 1, digests.size)
        good = from_ < to
        whole &= ~_cover(digests.size, from_[good], to[good])
        at = np.flatnonzero(whole)
        keys, ids, largest = _by_key(digests[at], own.ids[own.words.documents()[at]])
        return exchange.sent_rows(block.column("block")[0].as_py(), keys, ids, largest, buckets)

    second = exchange.answer(exchange.meet(table, first, candidates, exchange.SENT), "window_owners", least=True)
    fields = [T.StructField("doc", table.schema["doc"].dataType), T.StructField("n_words", T.LongType())]
    fields += [T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))

    def removed(block: pa.Table, told: pa.Table) -> pa.Table:
        own = _Block(block)
        words = own.words
        known, least = exchange.heard(told)
        gone = np.zeros(len(words), dtype=bool)
        if known.size:
            digests, whole = own.window_digests(window)
            document = words.documents()[: digests.size]
            hit = np.flatnonzero(whole & (exchange.look_up(known, least, digests, 0xFFFFFFFFFFFFFFFF) < own.ids[document]))
            gone = _cover(len(words), hit, hit + window)
        body, at = _kept_text(words, ~gone)
        parts = [body[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        counts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(gone, out=counts[1:])
        lost = counts[words.first[1:]] - counts[words.first[:-1]]
        columns = [block.column("doc"), pa.array(words.counts), pa.array(lost), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        if with_text:
            texts = block.column("text").to_pylist()
            columns.append(pa.array([p.decode() if n else t for p, n, t in zip(parts, lost.tolist(), texts)], pa.string()))
        return pa.table(columns, names=[f.name for f in fields])

    return exchange.meet(table, second, removed, T.StructType(fields))
