"""Quality classifier: regularised quadratic discriminant over document statistics.

A document becomes a short vector of transformed statistics (word lengths, shares of
symbols, capitals and punctuation, variety and repetition of words). Each class gets
a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the
unit matrix. A score is the difference of the two Mahalanobis log-densities, computed with
Cholesky factors that the fitted model keeps, and turned into a probability.

Two passes over the documents, no shuffle of texts: the first reduces labelled training
documents to sums per class (every labelled row counts, none is sampled), the second scores.

Cases: null and empty texts get the statistics of no words and are scored like others; a
label other than 0 or 1, or null, teaches nothing; repeated label rows count each; with no
label at all every score is 0.5, with labels of one class only it is that class; an empty
table gives no rows. Columns of any name are carried in the struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.text import SPACED, Words, pieces, row_sums, runs

SHRINK_TO_POOLED = 0.3
SHRINK_TO_UNIT = 0.05

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_STOP = np.isin(_BYTES, list(b".,;:!?'\"()"))
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>~^{}\\"))
_NEWLINE = _BYTES == 0x0A
#: pseudo-counts of usual words or characters: the statistics of short texts stay near usual ones
_PRIOR = 20.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    words = Words(texts, SPACED)
    n = words.counts.astype(np.float64)
    data, offsets = words.data, words.offsets
    size = np.diff(offsets).astype(np.float64)
    count = lambda table: row_sums(table[data].astype(np.int8), offsets).astype(np.float64)
    share = lambda x, of, usual: np.sqrt((x + usual * _PRIOR) / (of + _PRIOR))
    lengths = (words.ends - words.starts).astype(np.float64)
    shrunk = lambda x, usual: (row_sums(x, words.first) + usual * _PRIOR) / (n + _PRIOR)
    mean_length = shrunk(lengths, 5.0)
    spread = np.sqrt(np.maximum(shrunk(lengths**2, 34.0) - mean_length**2, 0))
    document = words.documents()
    digests = words.digests()
    # occurrences of each distinct word of each document: one sort of document and digest
    key = np.sort((document.astype(np.uint64) << np.uint64(40)) | (digests >> np.uint64(24)))
    start, times = runs(key)
    owner = (key[start] >> np.uint64(40)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(n.size + 1))
    distinct = np.diff(bounds).astype(np.float64)
    most = np.zeros(n.size)
    np.maximum.at(most, owner, times.astype(np.float64))
    again = np.zeros(len(words), dtype=np.int8)
    again[1:] = (digests[1:] == digests[:-1]) & (document[1:] == document[:-1])
    columns = [
        np.log1p(mean_length),
        np.log1p(spread),
        share(count(_SYMBOL), size, 0.0),
        share(count(_UPPER), size, 0.02),
        share(count(_STOP), size, 0.03),
        share(count(_LETTER | _DIGIT), size, 0.8),
        share(count(_NEWLINE), size, 0.0),
        share(distinct, n, 0.8),
        share(most, n, 0.06),
        share(row_sums(again, words.first).astype(np.float64), n, 0.0),
        share(row_sums((lengths == 1).astype(np.int8), words.first).astype(np.float64), n, 0.03),
    ]
    return np.stack(columns, axis=1) if n.size else np.zeros((0, len(columns)))


WIDTH = statistics(pa.array([], pa.string())).shape[1]


class Discriminant:
    """Fitted model; ``factors`` are the inverse Cholesky factors of the class covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.sizes = {k: m[0] for k, m in moments.items()}
        if len(moments) < 2:
            return
        total = sum(self.sizes.values())
        within = sum(m[2] - np.outer(m[1], m[1]) / m[0] for m in moments.values()) / total
        self.scale = np.sqrt(np.maximum(np.diag(within), 1e-12))
        pooled = within / np.outer(self.scale, self.scale)
        self.means, self.factors, self.constants = {}, {}, {}
        for k, (size, total_k, squares) in moments.items():
            mean = total_k / size
            own = (squares / size - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            shrunk = (1 - SHRINK_TO_POOLED) * own + SHRINK_TO_POOLED * pooled
            shrunk = (1 - SHRINK_TO_UNIT) * shrunk + SHRINK_TO_UNIT * (np.trace(shrunk) / WIDTH + 1e-6) * np.eye(WIDTH)
            lower = np.linalg.cholesky(shrunk)
            self.means[k], self.factors[k] = mean, np.linalg.inv(lower)
            self.constants[k] = np.log(size / total) - np.log(np.diag(lower)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(self.sizes) < 2:
            return np.full(len(x), 0.5 if not self.sizes else float(next(iter(self.sizes))))
        density = {}
        for k, mean in self.means.items():
            z = ((x - mean) / self.scale) @ self.factors[k].T
            density[k] = self.constants[k] - 0.5 * (z * z).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None) -> Discriminant:
    """Fit on the documents that have a label and meet ``learn``, a condition on doc_id."""
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select("doc_id", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = statistics(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    vectors = rows.mapInArrow(described, "doc_id long, x array<double>")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)
            y = batch.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k in (0, 1):
            if total[k, 0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(total.shape[1], k), pa.int32()), pa.array(np.arange(total.shape[1]), pa.int32()), pa.array(total[k])],
                    names=["y", "place", "value"],
                )

    parts = vectors.join(known, "doc_id").select("x", "y").mapInArrow(summed, "y int, place int, value double")
    sums: dict[int, np.ndarray] = {}
    for row in parts.groupBy("y", "place").agg(F.sum("value").alias("value")).collect():  # a few hundred rows
        sums.setdefault(row.y, np.zeros(1 + WIDTH + WIDTH * WIDTH))[row.place] = row.value
    return Discriminant({k: (v[0], v[1 : 1 + WIDTH], v[1 + WIDTH :].reshape(WIDTH, WIDTH)) for k, v in sorted(sums.items())})


def score(docs: DataFrame, model: Discriminant, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``doc`` (a struct of ``keep``), score and predicted of every document."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"))
    schema = T.StructType(
        [T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                p = sent.value.score(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc", "score", "predicted"]
                )

    return rows.mapInArrow(scored, schema)


def held_out(divisor: int) -> Column:
    """Whether crc32 of the doc_id as text leaves remainder 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, keep: Iterable[str] = ("doc_id",), divisor: int = 3) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all."""
    return score(docs, fit(docs, labels, learn=~held_out(divisor)), keep)
