"""Many word pairs at once: edit distances and common subsequences in NumPy lanes.

A lane is a pair of words, and its state one 64-bit number (several for a long pattern of a
subsequence), so a whole batch takes one step per letter. Results equal the pair-by-pair forms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

BITS = 64
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: cells of a chunk's match table
_CELLS = 4 << 20
#: strands of a chunk of window searches
_STRANDS = 1 << 18
#: letters of a pair of texts that is not told apart by both lengths
_SHORT = 256
#: numbers of a pattern up to which many lanes beat one wide number
_WIDE = 8
#: lanes of a chunk: their states fit the processor's cache
_LANES = 4096
#: alignments that are worth lanes
_FEW = 32


def distinct(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words of an array, and the number of each place; a null counts as empty."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _letters(words: Sequence[str], width: int) -> np.ndarray:
    """Code points of each word's first ``width`` letters, zero beyond."""
    if not len(words):
        return np.zeros((0, width), dtype=np.uint32)
    clipped = np.array([w[:width] for w in words], dtype=f"<U{width}")
    return clipped.view(np.uint32).reshape(len(words), width)


def _edits(a: str, b: str) -> int:
    """Edit distance of one pair, for words longer than a lane."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, c in enumerate(a):
        best = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - steps) + steps
    return int(row[-1])


def _bag(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the letters that a word has once at least, and twice at least, and what it has of them beyond."""
    once, twice = np.zeros(len(coded), dtype=np.uint64), np.zeros(len(coded), dtype=np.uint64)
    more = np.zeros(len(coded), dtype=np.int64)
    for k in range(coded.shape[1]):
        letter = coded[:, k]
        bit = np.where(letter > 0, _ONE << (letter % BITS).astype(np.uint64), np.uint64(0))
        more += (twice & bit) != 0
        twice |= once & bit
        once |= bit
    return once, twice, more


class Pairing:
    """Pattern words against text words, both distinct, pairs given by their numbers."""

    def __init__(self, patterns: Sequence[str], texts: Sequence[str]) -> None:
        self.patterns, self.texts = patterns, texts
        self.a = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
        self.b = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        width = int(min(BITS, max(self.a.max(initial=1), 1)))
        raw = _letters(patterns, width)
        inside = np.arange(width) < self.a[:, None]
        alphabet = np.unique(raw[inside])
        self.letters = alphabet.size + 1
        self._pattern = np.where(inside, np.searchsorted(alphabet, raw) + 1, 0)
        text = _letters(texts, int(min(BITS, max(self.b.max(initial=1), 1))))
        spot = np.minimum(np.searchsorted(alphabet, text), max(alphabet.size - 1, 0))
        known = alphabet[spot] == text if alphabet.size else np.zeros(text.shape, dtype=bool)
        self._text = np.where(known, spot + 1, 0).astype(np.int64)
        self._bags = _bag(self._pattern), _bag(self._text)
        place = {w: k for k, w in enumerate(texts)}
        self.same = np.fromiter((place.get(w, -1) for w in patterns), dtype=np.int64, count=len(patterns))

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distance of every pair (pattern ``i``, text ``j``)."""
        out = np.maximum(self.a[i], self.b[j])
        short = (self.a[i] <= BITS) & (self.b[j] <= BITS)
        some = np.flatnonzero(short & (self.a[i] > 0) & (self.b[j] > 0))
        chunk = int(np.clip(_CELLS // self.letters, 64, _LANES))
        if some.size > chunk:
            some = some[np.argsort(i[some], kind="stable")]
        for at in range(0, some.size, chunk):
            part = some[at : at + chunk]
            out[part] = self._lanes(i[part], j[part])
        for k in np.flatnonzero(~short).tolist():
            out[k] = _edits(self.patterns[i[k]], self.texts[j[k]])
        return out

    def _lanes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        used, slot = np.unique(i, return_inverse=True)
        match = np.zeros((used.size, self.letters), dtype=np.uint64)
        rows, width = np.arange(used.size), int(self.a[used].max())
        for k in range(width):
            match[rows, self._pattern[used, k]] |= _ONE << np.uint64(k)
        match[:, 0] = 0
        length = self.b[j]
        order = np.argsort(-length, kind="stable")
        slot, length = slot[order], length[order]
        text = self._text[j[order]]
        size = self.a[i[order]]
        top = _ONE << (size - 1).astype(np.uint64)
        score = size.copy()
        up, down = np.full(order.size, _ALL), np.zeros(order.size, dtype=np.uint64)
        left = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # lanes with a letter at each step
        match, base, text = match.ravel(), slot * self.letters, np.ascontiguousarray(text.T)
        rooms = [np.empty(order.size, dtype=np.uint64) for _ in range(3)]
        for step, n in enumerate(left.tolist()):
            vp, vn, high = up[:n], down[:n], top[:n]
            diagonal, plus, minus = (room[:n] for room in rooms)
            eq = match[base[:n] + text[step, :n]]
            eq |= vn
            np.bitwise_and(eq, vp, out=diagonal)
            diagonal += vp
            diagonal ^= vp
            diagonal |= eq
            np.bitwise_and(vp, diagonal, out=minus)
            np.bitwise_or(vp, diagonal, out=plus)
            np.invert(plus, out=plus)
            plus |= vn
            score[:n] += (plus & high) != 0
            score[:n] -= (minus & high) != 0
            plus <<= _ONE
            plus |= _ONE
            np.bitwise_and(plus, diagonal, out=vn)
            np.bitwise_or(plus, diagonal, out=vp)
            np.invert(vp, out=vp)
            minus <<= _ONE
            vp |= minus
        out = np.empty_like(score)
        out[order] = score
        return out

    def similarity(self, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
        """``1 - edits / longest`` of every pair; pairs whose lengths or letters rule ``least`` out give 0."""
        longest = np.maximum(self.a[i], self.b[j])
        out = np.zeros(i.size)
        out[self.same[i] == j] = 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = 1.0 - np.abs(self.a[i] - self.b[j]) / longest
        some = np.flatnonzero((out == 0) & (self.a[i] > 0) & (self.b[j] > 0) & (bound >= least))
        if least > 0 and some.size:  # no more letters can be kept than the two words share
            (a1, a2, a3), (b1, b2, b3) = self._bags
            p, t = i[some], j[some]
            shared = np.bitwise_count(a1[p] & b1[t]).astype(np.int64) + np.bitwise_count(a2[p] & b2[t]) + np.minimum(a3[p], b3[t])
            lane = (self.a[p] > BITS) | (self.b[t] > BITS)
            some = some[lane | (1.0 - (longest[some] - shared) / longest[some] >= least)]
        if some.size:
            out[some] = 1.0 - self.edits(i[some], j[some]) / longest[some]
        return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row of bits."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_subsequences(patterns: Sequence[str], texts: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequence of every pair (pattern ``i``, text ``j``), of any length.

    A pattern takes as many 64-bit numbers as it needs, or one wide number beyond ``_WIDE`` of
    them; pairs go in classes of about equal length, so a long one does not widen the others.
    """
    a = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
    b = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros(i.size, dtype=np.int64)
    blocks = -(-a[i] // BITS)
    kind = np.ceil(np.log2(np.maximum(blocks, 1))).astype(np.int64) * 64 + np.ceil(np.log2(np.maximum(b[j], 1))).astype(np.int64)
    live = (a[i] > 0) & (b[j] > 0) & (blocks <= _WIDE)
    for k in np.flatnonzero(blocks > _WIDE).tolist():
        out[k] = common_subsequence(patterns[i[k]], texts[j[k]])
    for k in np.unique(kind[live]).tolist():
        some = np.flatnonzero(live & (kind == k))
        some = some[np.argsort(i[some], kind="stable")]
        width = int(blocks[some].max())
        step = int(np.clip((1 << 16) // (width * max(1, int(b[j[some]].max()) >> 6)), 16, 4096))
        for at in range(0, some.size, step):
            part = some[at : at + step]
            out[part] = _subsequence_lanes(patterns, texts, i[part], j[part], a, b, width)
    return out


def _subsequence_lanes(patterns, texts, i, j, a, b, width) -> np.ndarray:
    used, slot = np.unique(i, return_inverse=True)
    wanted, where = np.unique(j, return_inverse=True)
    raw = _letters([patterns[k] for k in used], int(a[used].max()))
    inside = np.arange(raw.shape[1]) < a[used][:, None]
    alphabet = np.unique(raw[inside])
    coded = np.where(inside, np.searchsorted(alphabet, raw) + 1, 0)
    match = np.zeros((width, used.size, alphabet.size + 1), dtype=np.uint64)
    rows = np.arange(used.size)
    for k in range(raw.shape[1]):
        match[k // BITS, rows, coded[:, k]] |= _ONE << np.uint64(k % BITS)
    match[:, :, 0] = 0
    text = _letters([texts[k] for k in wanted], int(b[wanted].max()))
    spot = np.minimum(np.searchsorted(alphabet, text), alphabet.size - 1)
    text = np.where(alphabet[spot] == text, spot + 1, 0)
    length = b[j]
    order = np.argsort(-length, kind="stable")
    slot, where, length = slot[order], where[order], length[order]
    state = np.full((width, order.size), _ALL)
    left = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for step, n in enumerate(left.tolist()):
        letter = text[where[:n], step]
        carry = np.zeros(n, dtype=np.uint64)
        for w in range(width):
            v = state[w, :n]
            hit = v & match[w, slot[:n], letter]
            total = v + hit
            over = total < v
            total += carry
            over |= total < carry
            state[w, :n] = total | (v & ~hit)
            carry = over.astype(np.uint64)
    size = a[i[order]]
    found = np.zeros(order.size, dtype=np.int64)
    for w in range(width):
        inside = np.clip(size - w * BITS, 0, BITS)
        mask = np.where(inside == BITS, _ALL, (_ONE << np.minimum(inside, BITS - 1).astype(np.uint64)) - _ONE)
        found += np.bitwise_count(~state[w] & mask)
    out = np.empty_like(found)
    out[order] = found
    return out


def best_windows(patterns: Sequence[str], texts: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Best indel percent of pattern ``i`` against windows of its length in text ``j``, for every pair.

    Windows may hang over either end; the text must be as long as the pattern, which must not be
    empty. One pass per pair over pattern x text serves all windows: strands enter at the letters
    of both, two that meet cross where letters are equal or they have not crossed before, and a
    window lacks one common letter for each strand that enters and leaves the text inside it.
    """
    a = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
    b = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros(i.size)
    # short pairs share a class: there the steps cost more than the room beyond a text's end
    both = a[i] + b[j]
    kind = np.where(both <= _SHORT, np.ceil(np.log2(both)), (np.ceil(np.log2(a[i])) + 1) * 64 + np.ceil(np.log2(b[j]))).astype(np.int64)
    for k in np.unique(kind).tolist():
        some = np.flatnonzero(kind == k)
        step = int(np.clip(_STRANDS // int(a[i[some]].max() + b[j[some]].max()), 1, _LANES))
        for at in range(0, some.size, step):
            part = some[at : at + step]
            out[part] = _combed([patterns[x] for x in i[part]], [texts[x] for x in j[part]], a[i[part]], b[j[part]])
    return out


def _combed(patterns, texts, a, b) -> np.ndarray:
    n, m, lanes = int(a.max()), int(b.max()), a.size
    rows, columns = _letters(patterns, n), _letters(texts, m)
    narrow = n + m < 1 << 15 and max(int(rows.max()), int(columns.max())) < 1 << 15
    kind = np.int16 if narrow else np.int32
    # the last letter first: a diagonal is two plain slices, a strand a row of lanes
    rows, columns = np.ascontiguousarray(rows.astype(kind)[:, ::-1].T), np.ascontiguousarray(columns.astype(kind).T)
    used, there = np.arange(n - 1, -1, -1)[:, None] < a, np.arange(m)[:, None] < b
    # strands beyond a pattern or text never cross
    rows[~used], columns[~there] = -1, -2
    across = np.where(used, np.arange(n, dtype=kind)[:, None], kind(-1))
    along = np.where(there, np.arange(n, n + m, dtype=kind)[:, None], kind(n + m))
    like = np.empty((min(n, m), lanes), dtype=bool)
    turn, swap = (np.empty((min(n, m), lanes), dtype=kind) for _ in range(2))
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        side, down = slice(n - 1 - high, n - low), slice(d - high, d - low + 1)
        left, top = across[side], along[down]
        cross, mask, both = like[: high - low + 1], turn[: high - low + 1], swap[: high - low + 1]
        # where they cross, left and top change places: both bits of what differs are turned
        np.greater(left, top, out=cross)
        cross |= rows[side] == columns[down]
        np.copyto(mask, cross)
        np.negative(mask, out=mask)
        np.bitwise_xor(left, top, out=both)
        both &= mask
        left ^= both
        top ^= both
    # windows begin from n - 1 letters before the text to its last letter
    inside = np.zeros((lanes, n + m + 1), dtype=np.int32)
    along = along.T
    lane, leave = np.nonzero((along >= n) & there.T)
    enter = along[lane, leave].astype(np.int64) - n
    held = leave - enter < a[lane]
    lane, leave, enter = lane[held], leave[held], enter[held]
    # a place takes one strand at most
    inside[lane, leave - a[lane] + n] += 1
    inside[lane, enter + n] -= 1
    inside = np.cumsum(inside, axis=1)[:, : n + m - 1]
    begin = np.arange(1 - n, m)
    width = np.minimum(begin + a[:, None], b[:, None]) - np.maximum(begin, 0)
    percent = 200.0 * (width - inside) / (a[:, None] + np.maximum(width, 0))
    return np.where(width > 0, percent, 0.0).max(axis=1)


def free_alignment(pattern: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[int, int, int]:
    """Best place of one pattern inside a text: edits, first place, end (exclusive).

    The start is free and the end one of ``ends``; of equal steps a replacement goes before a
    dropped and that before an extra symbol. The running minimum of the costs less their column
    numbers carries the extra-symbol steps along a row.
    """
    m, n = len(pattern), len(text)
    columns = np.arange(n + 1, dtype=np.int32)
    unlike = {p: (text != p).astype(np.int32) for p in set(pattern.tolist())}
    cost = np.zeros((m + 1, n + 1), np.int32)
    drop = np.empty(n, np.int32)
    for i, symbol in enumerate(pattern.tolist(), 1):
        above, row = cost[i - 1], cost[i]
        np.add(above[:-1], unlike[symbol], out=row[1:])
        np.add(above[1:], 1, out=drop)
        np.minimum(row[1:], drop, out=row[1:])
        row[0] = i
        row -= columns
        np.minimum.accumulate(row, out=row)
        row += columns
    row = cost[m]
    last = int(ends[np.argmin(row[ends])])
    # the costs tell which step led to a cell, so only the path is looked at
    i, j, first = m, last, last
    while i > 0 and j > 0:
        here = cost[i, j]
        if cost[i - 1, j - 1] + (pattern[i - 1] != text[j - 1]) == here:
            i, j = i - 1, j - 1
            first = j
        elif cost[i - 1, j] + 1 == here:
            i -= 1
        else:
            j -= 1
    return int(row[last]), min(first, n - 1), last


def free_alignments(patterns: Sequence[np.ndarray], texts: Sequence[np.ndarray], is_end: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``free_alignment`` of many pairs of symbol numbers, all edits -1 where one of them is empty.

    ``is_end`` tells of each symbol of a text whether a place may end after it; the last one may.
    """
    m, n = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (patterns, texts))
    out = np.full((3, m.size), -1, dtype=np.int64)
    live, words = (m > 0) & (n > 0), -(-m // BITS)
    alone = live & (words > _WIDE)
    short = m <= BITS // 2
    for width, half in {(w, h) for w, h in zip(words[live & ~alone].tolist(), short[live & ~alone].tolist())}:
        some = np.flatnonzero(live & (words == width) & (short == half))
        if some.size < _FEW:
            alone[some] = True
            continue
        some = some[np.argsort(-n[some], kind="stable")]
        at = 0
        while at < some.size:
            step = int(np.clip(_CELLS // (width * int(n[some[at]])), 16, _LANES))
            part = some[at : at + step]
            out[:, part] = _free_lanes([patterns[k] for k in part], [texts[k] for k in part], [is_end[k] for k in part], m[part], n[part], width, np.uint32 if half else np.uint64)
            at += step
    for k in np.flatnonzero(alone).tolist():
        out[:, k] = _free_alone(patterns[k], texts[k], is_end[k])
    return out[0], out[1], out[2]


def _flat(parts: Sequence[np.ndarray], size: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one behind the other, with some places ``beyond``, and where each begins."""
    return np.concatenate([*parts, np.zeros(beyond, dtype=parts[0].dtype)]), np.cumsum(size) - size


def _free_lanes(patterns, texts, is_end, m, n, width, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes in the order of falling text length; of each column it is kept which steps lead there.

    A pattern ends at the highest bit of its last number; the bits before it are alike with every
    symbol, so a place still begins anywhere for nothing.
    """
    lanes, long, bits = m.size, int(n[0]), 8 * np.dtype(kind).itemsize
    signed = np.int32 if kind is np.uint32 else np.int64
    one, top = kind(1), kind(bits - 1)
    (said, said_at), (heard, heard_at), (ends, _) = _flat(patterns, m, 0), _flat(texts, n, long), _flat(is_end, n, long)
    said, heard = said.astype(np.int64), heard.astype(np.int64)
    symbols = int(max(said.max(), heard.max())) + 1
    row, pad = np.arange(lanes), width * bits - m
    match, up = np.zeros((width, lanes, symbols), dtype=kind), np.zeros((width, lanes), dtype=kind)
    for w in range(width):
        below = np.clip(pad - w * bits, 0, bits)
        free = np.where(below == bits, ~kind(0), (one << np.minimum(below, bits - 1).astype(kind)) - one)
        match[w], up[w] = free[:, None], ~free
    match = match.reshape(width, lanes * symbols)
    for k in range(int(m.max())):
        held = row[m > k]
        at = pad[held] + k
        match[at // bits, held * symbols + said[said_at[held] + k]] |= one << (at % bits).astype(kind)
    # each column is written where it is kept: what is alike along diagonals, and what rises
    alike, rises = np.empty((long, width, lanes), dtype=kind), np.empty((long + 1, width, lanes), dtype=kind)
    rises[0] = up
    down, score, base, place = np.zeros((width, lanes), dtype=kind), m.astype(signed), row * symbols, heard_at.copy()
    best, last = np.full(lanes, np.iinfo(signed).max), np.zeros(lanes, dtype=np.int64)
    rooms = [np.empty(lanes, dtype=kind) for _ in range(4)]
    for step, c in enumerate(np.searchsorted(-n, -np.arange(long), side="left").tolist()):
        work, plus, minus, other = (room[:c] for room in rooms)
        now, symbol = score[:c], heard[place[:c]]
        symbol += base[:c]
        for w in range(width):
            vp, vn, diagonal = rises[step, w, :c], down[w, :c], alike[step, w, :c]
            equal = match[w][symbol]
            np.bitwise_and(equal, vp, out=work)
            work += vp
            if width > 1:
                over = work < vp
                if w:
                    work += carry
                    over |= work < carry
                carry = over.astype(kind)
            work ^= vp
            work |= equal
            np.bitwise_or(work, vn, out=diagonal)
            np.bitwise_or(diagonal, vp, out=plus)
            np.invert(plus, out=plus)
            plus |= vn
            np.bitwise_and(vp, diagonal, out=minus)
            if w == width - 1:  # the highest bit is the sign
                now -= plus.view(signed) >> signed(bits - 1)
                now += minus.view(signed) >> signed(bits - 1)
            np.add(plus, plus, out=work)
            np.add(minus, minus, out=other)
            if width > 1:
                if w:
                    work |= plus_in
                    other |= minus_in
                plus_in, minus_in = plus >> top, minus >> top
            np.bitwise_and(work, diagonal, out=vn)
            work |= diagonal
            np.invert(work, out=work)
            np.bitwise_or(other, work, out=rises[step + 1, w, :c])
        better = now < best[:c]
        better &= ends[place[:c]]
        np.copyto(best[:c], now, where=better)
        np.copyto(last[:c], step + 1, where=better)
        place += 1
    alike, rises = alike.ravel(), rises.ravel()
    first, who, i, j, off = last.copy(), row, m, last.copy(), pad
    while who.size:
        at = i + off - 1
        if width > 1:
            word, bit = at // bits, (at % bits).astype(kind)
            spot = ((j - 1) * width + word) * lanes + who
        else:
            bit, spot = at.astype(kind), (j - 1) * lanes + who
        same = said[said_at[who] + i - 1] == heard[heard_at[who] + j - 1]
        across = same | ((alike[spot] >> bit) & one == 0)
        dropped = ~across & ((rises[spot + width * lanes] >> bit) & one == 1)
        i = i - (across | dropped)
        j = j - ~dropped
        first[who[across]] = j[across]
        live = (i > 0) & (j > 0)
        if not live.all():
            who, i, j, off = who[live], i[live], j[live], off[live]
    return best.astype(np.int64), np.minimum(first, n - 1), last


def _free_alone(pattern: np.ndarray, text: np.ndarray, is_end: np.ndarray) -> tuple[int, int, int]:
    """``free_alignment`` of one pair, all rows of a column in one wide number."""
    said, heard, ends = pattern.tolist(), text.tolist(), is_end.tolist()
    m, match = len(said), {}
    for i, symbol in enumerate(said):
        match[symbol] = match.get(symbol, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, last = full, 0, m, None, 0
    alike, rises = [], []
    ends[-1] = True
    for j, symbol in enumerate(heard):
        equal = match.get(symbol, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        plus, minus = down | ((diagonal | up) ^ full), up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus <<= 1
        down = plus & diagonal
        up = ((minus << 1) | ~(diagonal | plus)) & full
        alike.append(diagonal)
        rises.append(up)
        if ends[j] and (best is None or score < best):
            best, last = score, j + 1
    i, j, first = m, last, last
    while i > 0 and j > 0:
        if said[i - 1] == heard[j - 1] or not alike[j - 1] >> (i - 1) & 1:
            i, j = i - 1, j - 1
            first = j
        elif rises[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return best, min(first, len(heard) - 1), last


def window_subsequences(patterns: Sequence[str], codes: np.ndarray, i: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Longest common subsequence of pattern ``i`` and ``size`` letters of ``codes`` from ``begin`` on, for every window."""
    a = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
    out = np.zeros(i.size, dtype=np.int64)
    flat = np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alphabet = np.unique(flat)
    if not alphabet.size or not codes.size:
        return out
    known = np.minimum(np.searchsorted(alphabet, codes), alphabet.size - 1)
    coded = np.where(alphabet[known] == codes, known + 1, 0)
    said = np.searchsorted(alphabet, flat) + 1
    first, width = np.cumsum(a) - a, -(-a // BITS)
    live = (a[i] > 0) & (size > 0)
    for k in np.flatnonzero(live & (width[i] > _WIDE)).tolist():
        out[k] = common_subsequence(patterns[i[k]], codes[begin[k] : begin[k] + size[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
    for w in np.unique(width[i[live]]).tolist():
        if w > _WIDE:
            continue
        some = np.flatnonzero(live & (width[i] == w))
        some = some[np.argsort(i[some], kind="stable")]
        for at in range(0, some.size, _LANES):
            part = some[at : at + _LANES]
            part = part[np.argsort(-size[part], kind="stable")]
            out[part] = _window_lanes(said, first, a, coded, alphabet.size + 1, i[part], begin[part], size[part], w)
    return out


def _window_lanes(said, first, a, coded, letters, i, begin, size, width) -> np.ndarray:
    """Lanes in the order of falling window length."""
    used, slot = np.unique(i, return_inverse=True)
    match, rows = np.zeros((width, used.size, letters), dtype=np.uint64), np.arange(used.size)
    for k in range(int(a[used].max())):
        held = rows[a[used] > k]
        match[k // BITS, held, said[first[used[held]] + k]] |= _ONE << np.uint64(k % BITS)
    match = match.reshape(width, used.size * letters)
    base, at = slot * letters, begin.astype(np.int64)
    state = np.full((width, i.size), _ALL)
    letter, hit, total = np.empty(i.size, dtype=np.int64), np.empty(i.size, dtype=np.uint64), np.empty(i.size, dtype=np.uint64)
    for step, n in enumerate(np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()):
        np.take(coded, at[:n], out=letter[:n], mode="clip")
        letter[:n] += base[:n]
        at[:n] += 1
        for w in range(width):
            v = state[w, :n]
            h, t = hit[:n], total[:n]
            np.take(match[w], letter[:n], out=h, mode="clip")
            h &= v
            np.add(v, h, out=t)
            if width > 1:
                over = t < v
                if w:
                    t += carry[:n]
                    over |= t < carry[:n]
                carry = over.astype(np.uint64)
            h ^= v
            np.bitwise_or(t, h, out=v)
    found = np.zeros(i.size, dtype=np.int64)
    for w in range(width):
        inside = np.clip(a[i] - w * BITS, 0, BITS)
        mask = np.where(inside == BITS, _ALL, (_ONE << np.minimum(inside, BITS - 1).astype(np.uint64)) - _ONE)
        found += np.bitwise_count(~state[w] & mask)
    return found
