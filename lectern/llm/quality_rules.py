"""Quality rules: fixed statistics first, then a calibrated n-gram model with a fixed threshold.

``base_statistics`` counts, exactly and over whole texts, what the base rule reads. The
method's verdict is a logistic regression over hashed words and hashed character n-grams
(of UTF-8 bytes): a text is the mean weight of its words plus the mean weight of its n-grams,
so scoring is one table lookup per feature, in Arrow batches. The model is trained on
labelled rows and its probability is calibrated on labelled rows kept from the training.

Training takes the labelled rows of lowest digest, ``SAMPLE`` of each class at most: a
documented bound, so that the model fits one machine. All else covers every row.

Cases: null and empty texts have no words and fail the base rule; labels other than 0 or 1,
or null, teach nothing; without labels of both classes the method keeps what the base rule
keeps; repeated rows get a result each; an empty table gives no rows; other columns are
carried in the struct ``doc`` where asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.text import SPACED, Words, mix, pieces, row_sums

SAMPLE = 1000
BITS = 16
GRAM = 4
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_START = (_BYTES & 0xC0) != 0x80
_LINE = _BYTES != 0x0A
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_statistics(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The five counts of every text."""
    data, offsets = words.data, words.offsets
    document = words.documents()
    whole = np.zeros(data.size + 1, dtype=np.int64)
    np.cumsum(_START[data], out=whole[1:])
    chars = whole[words.ends] - whole[words.starts]
    return {
        "n_words": words.counts,
        "word_chars": row_sums(chars, words.first),
        "n_symbols": row_sums(_SYMBOL[data].astype(np.int8), offsets),
        "n_dup_lines": _repeated_lines(texts, words),
        "n_repeat_words": row_sums(_in_repeats(words, document), words.first),
    }


def _repeated_lines(texts: pa.Array, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    lines = Words(texts, _LINE)
    if not len(lines):
        return np.zeros(len(texts), dtype=np.int64)
    holding = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    code = lines.strings().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    document = lines.documents()
    order = np.lexsort((code, document))
    same = np.zeros(len(lines), dtype=bool)
    same[1:] = (code[order][1:] == code[order][:-1]) & (document[order][1:] == document[order][:-1])
    again = np.zeros(len(lines), dtype=np.int8)
    again[order] = same
    return row_sums(again * holding, lines.first)


def _in_repeats(words: Words, document: np.ndarray) -> np.ndarray:
    """1 for each word inside a three-word window that occurs twice or more in its text."""
    n = len(words)
    if n < 3:
        return np.zeros(n, dtype=np.int8)
    coded = words.strings().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    size = np.uint64(len(coded.dictionary))
    if int(size) ** 3 < 1 << 63:
        key = (code[:-2] * size + code[1:-1]) * size + code[2:]
    else:  # number the pairs first: equal pairs get equal numbers below n
        two = code[:-1] * size + code[1:]
        two = np.searchsorted(np.sort(two), two).astype(np.uint64)
        key = two[:-1] * size + code[2:]
    inside = document[2:] == document[:-2]
    order = np.argsort(key, kind="stable")
    k, d, ok = key[order], document[:-2][order], inside[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & ok[1:] & ok[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return cover.astype(np.int8)


def _grams(words: Words) -> np.ndarray:
    """Slot of the hashed n-gram at every byte; ``_bounds`` leaves out those between texts."""
    data = words.data
    if data.size < GRAM:
        return np.zeros(0, dtype=np.uint32)
    fours = np.ndarray((data.size - GRAM + 1,), dtype="<u4", buffer=np.ascontiguousarray(data), strides=(1,))
    slots = (fours * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return slots


def _bounds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    lo = words.offsets[:-1]
    return lo, np.maximum(words.offsets[1:] - GRAM + 1, lo)


def _word_slots(words: Words) -> np.ndarray:
    return (words.digests() >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)


def vector(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: slots and shares."""
    words = Words(texts, SPACED)
    slots = _grams(words)
    own = _word_slots(words)
    lo, hi = _bounds(words)
    out = []
    for d in range(len(texts)):
        parts = []
        for found in (slots[lo[d] : hi[d]].astype(np.int64), own[words.first[d] : words.first[d + 1]]):
            place, times = np.unique(found, return_counts=True)
            parts.append((place, times / max(1, found.size)))
        out.append((np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])))
    return out


class Calibrated:
    """Weights per slot, and the line that turns a sum of weights into a log-odds."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.slope, self.shift = weights.astype(np.float32), slope, shift

    def probability(self, words: Words) -> np.ndarray:
        slots = _grams(words)
        lo, hi = _bounds(words)
        total = np.zeros(slots.size + 1)
        np.cumsum(self.weights[slots], out=total[1:])
        lo, hi = np.minimum(lo, slots.size), np.minimum(hi, slots.size)
        grams = (total[hi] - total[lo]) / np.maximum(hi - lo, 1)
        own = row_sums(self.weights[_word_slots(words)], words.first) / np.maximum(words.counts, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * (grams + own) + self.shift, -500, 500)))


def _train(rows: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, steps: int = 120, rate: float = 2.0, decay: float = 1e-5):
    """Logistic regression by Adam on all rows at once."""
    sizes = np.array([len(r) for r in rows])
    slots, values = np.concatenate(rows), np.concatenate(shares)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weights, shift = np.zeros(2 << BITS), 0.0
    first, second = np.zeros(weights.size + 1), np.zeros(weights.size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, values * weights[slots], minlength=len(rows)) + shift
        wrong = (1 / (1 + np.exp(-z)) - y) / len(rows)
        slope = np.append(np.bincount(slots, values * wrong[owner], minlength=weights.size) + decay * weights, wrong.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        shift -= 0.1 * move[-1]
    return weights


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds by Newton steps, with softened labels."""
    up, down = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-6, np.abs(z).mean())
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        line -= np.linalg.solve(curve, x.T @ (p - goal) + 1e-3 * line)
    return max(line[0], 1e-3) / scale, line[1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Calibrated | None:
    """Train on at most ``sample`` labelled rows of each class; None without both classes."""
    picked = None
    for k in (0, 1):
        own = labels.where(F.col(label) == k).where("doc_id is not null").select("doc_id", F.lit(k).alias("y"))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * sample rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = vector(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("y"),
                        pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                        pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "y", "slots", "shares"],
                )

    schema = "doc_id long, y int, slots array<int>, shares array<float>"
    table = known.mapInArrow(features, schema).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = table.column("y").to_numpy().astype(np.float64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    rows = [v.values.to_numpy() for v in table.column("slots")]
    shares = [v.values.to_numpy().astype(np.float64) for v in table.column("shares")]
    kept = mix(table.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(4) == 0  # for the calibration
    if not all((y[kept] == k).any() and (y[~kept] == k).any() for k in (0, 1)):
        kept[:] = True
        train = kept
    else:
        train = ~kept
    weights = _train([r for r, t in zip(rows, train) if t], [s for s, t in zip(shares, train) if t], y[train])
    z = np.array([float((weights[r] * s).sum()) for r, s, k in zip(rows, shares, kept) if k])
    return Calibrated(weights, *_calibrate(z, y[kept]))


def judge(docs: DataFrame, model: Calibrated | None, keep: Iterable[str] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``doc`` (a struct of ``keep``), the statistics, base_failed, score and kept."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"))
    fields = [T.StructField("doc", rows.schema["doc"].dataType), *(T.StructField(n, T.LongType()) for n in STATISTICS)]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text")
                words = Words(texts, SPACED)
                stats = base_statistics(texts, words)
                n = stats["n_words"]
                failed = (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                score = sent.value.probability(words) if sent.value else np.full(len(n), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        *(pa.array(stats[k].astype(np.int64)) for k in STATISTICS),
                        pa.array(failed),
                        pa.array(score),
                        pa.array(~failed & (score >= threshold)),
                    ],
                    names=[f.name for f in fields],
                )

    return rows.mapInArrow(judged, T.StructType(fields))
