"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become whole numbers, ``x = floor(256 * c)``; every distinct x is in the fit list once.
Centred fit rows are reduced by QR, block by block: each Spark task keeps the triangle of what
it has read, and triangles are merged 16 at a time until one of ``d`` rows is left. What the
driver then solves is of the size of the dimension, whatever the number of rows:

* Householder reflections from both sides make the triangle bidiagonal;
* dqds, with Rutishauser's correction of shifts that come out too large, finds its singular
  values to high relative accuracy;
* for each of the largest, the stationary and the progressive qd transform meet in a twisted
  factorisation, at the place where it is nearest to singular; its vector, carried back through
  the reflections, is the direction. Where equal singular values give the same vector again,
  the next best place of twist is taken and made orthogonal to those before.

``deviation`` is exact: sums are whole numbers of any size, and a result that no long can hold
is null. ``identity_error`` is measured by Spark over the projected fit list.

Cases: vectors that are null, empty, or hold null or non-finite entries are dropped, and those
whose length is not the most frequent one (of equally frequent the longest); rows with equal
vectors share one place in the fit list and each get their results; a null id is kept; a direction without variance has a
null ``whitened`` and is left out of ``identity_error`` (0 if none is left); ``explained`` is 0
where nothing varies; with fewer dimensions than components there are as many components as
dimensions; an empty table gives no rows. Other columns are ignored unless kept in ``doc``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.session import through_table

SCALE = 256.0
COMPONENTS = 4
BLOCK_ROWS = 4096
FAN_IN = 16
_EPS = float(np.finfo(float).eps)
_TINY = 1e-200


def whole(vector: Column) -> Column:
    """Entries as whole numbers; null where the vector cannot be used."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _held(values: np.ndarray, terms: int, power: int = 1) -> bool:
    """Whether sums of ``terms`` such values, raised to ``power``, stay within a long."""
    return values.size == 0 or float(np.abs(values.astype(np.float64)).max()) ** power * terms < 2.0**62


@dataclass
class Model:
    n: int
    sums: list[int]
    variances: list[float]
    directions: np.ndarray  # dimension x component
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> list[bool]:
        return [v > 0 for v in self.variances]

    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.array([math.sqrt(v) if v > 0 else math.nan for v in self.variances])
        return (x - self.means()) @ self.directions / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        sums = np.array(self.sums, dtype=object)
        bound = np.array([self.n * float(np.abs(x).max(initial=0)) + max(abs(s) for s in self.sums)])
        if _held(bound, self.width, 2):
            moved = self.n * x - sums.astype(np.int64)
            return np.einsum("ij,ij->i", moved, moved).tolist()
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


# ---------------------------------------------------------------- solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper off-diagonal of U'RV, and the reflectors of V (first row k + 1 on)."""
    a = r.copy()
    d = a.shape[0]
    right = []
    for k in range(d):
        u = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 1:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector whose reflection leaves only the first entry of ``x``; zero if nothing is to do."""
    size = np.linalg.norm(x)
    if size == 0 or not x[1:].any():
        return np.zeros_like(x)
    v = x / size
    v[0] += math.copysign(1.0, v[0])
    return v / np.linalg.norm(v)


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds sweep: new q and e, where it first failed (-1 if nowhere) and the last pivot."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    pivot, failed = q[0] - shift, -1
    for i in range(n - 1):
        if pivot < 0 and failed < 0:
            failed = i
        new_q[i] = pivot + e[i]
        if new_q[i] <= _TINY:
            new_q[i] = _TINY
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        pivot = pivot * ratio - shift
    if pivot < 0 and failed < 0:
        failed = n - 1
    new_q[n - 1] = max(pivot, _TINY)
    return new_q, new_e, failed, pivot


def dqds(diagonal: np.ndarray, off: np.ndarray) -> list[float]:
    """Singular values of an upper bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0))
    if scale == 0:
        return [0.0] * diagonal.size
    q = [max(float(x), _TINY) for x in (diagonal / scale) ** 2]
    e = [float(x) for x in (off / scale) ** 2]
    found: list[float] = []
    total = 0.0
    while q:
        n = len(q)
        if n == 1 or e[-1] <= (_EPS * _EPS) * (total + q[-1]):
            found.append(total + q.pop())
            if e:
                e.pop()
            continue
        # least eigenvalue of the last two rows, as a shift; it is never below the least of all
        a, b, c = q[-2] + (e[-3] if n > 2 and len(e) > 2 else 0.0), math.sqrt(q[-2] * e[-1]), q[-1] + e[-1]
        half = (a - c) / 2
        shift = max(0.0, min(q[-1], c - b * b / (abs(half) + math.hypot(half, b)) if b else c))
        for attempt in range(6):
            new_q, new_e, failed, pivot = _shifted(q, e, shift)
            if failed < 0:
                break
            if failed == n - 1 and attempt < 2:  # failed in the last step only: the pivot tells by how much
                shift = max(0.0, (shift + pivot) * (1 - 4 * _EPS))
            else:
                shift = shift / 4 if attempt < 4 else 0.0
        q, e, total = new_q, new_e, total + shift
    return [scale * math.sqrt(max(x, 0.0)) for x in sorted(found, reverse=True)]


class Twisted:
    """The twisted factorisations of B'B - value for a bidiagonal B."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, value: float) -> None:
        pivots = [max(float(x) ** 2, _TINY) for x in diagonal]
        slopes = [float(b) / (float(a) if a else math.sqrt(_TINY)) for a, b in zip(diagonal, off)]
        n = len(pivots)
        down, self.low = [0.0] * n, [0.0] * (n - 1)
        down[0] = -value
        for i in range(n - 1):
            at = _apart(down[i] + pivots[i])
            self.low[i] = pivots[i] * slopes[i] / at
            down[i + 1] = self.low[i] * slopes[i] * down[i] - value
        up, self.high = [0.0] * n, [0.0] * (n - 1)
        up[n - 1] = pivots[n - 1] - value
        for i in range(n - 2, -1, -1):
            at = _apart(pivots[i] * slopes[i] ** 2 + up[i + 1])
            ratio = pivots[i] / at
            self.high[i] = slopes[i] * ratio
            up[i] = up[i + 1] * ratio - value
        self.gamma = [s + p + value for s, p in zip(down, up)]

    def vector(self, twist: int) -> tuple[np.ndarray, float]:
        z = np.zeros(len(self.gamma))
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(twist, z.size - 1):
            z[i + 1] = -self.high[i] * z[i]
        return z, self.gamma[twist] / float(z @ z)


def _apart(x: float) -> float:
    return x if abs(x) > _TINY else _TINY


def directions(diagonal: np.ndarray, off: np.ndarray, values: list[float], right: list[np.ndarray]) -> np.ndarray:
    """Unit right singular vectors of the values given, by column."""
    scale = max(values[0], math.sqrt(_TINY))
    diagonal, off = diagonal / scale, off / scale
    made: list[np.ndarray] = []
    for value in values:
        square = (value / scale) ** 2
        twisted = Twisted(diagonal, off, square)
        best, kept = None, -1.0
        for twist in np.argsort(np.abs(twisted.gamma), kind="stable").tolist():
            z, step = twisted.vector(twist)
            if abs(step) <= 1e-3 * square:  # one Rayleigh quotient correction
                again, _ = Twisted(diagonal, off, square + step).vector(twist)
                z = again if np.isfinite(again).all() else z
            z = z / np.linalg.norm(z)
            for _ in range(2):
                for other in made:
                    z = z - (other @ z) * other
                left = float(np.linalg.norm(z))
                if left < 1e-8:
                    break
                z = z / left
            else:
                best, kept = z, 1.0
                break
            if left > kept:
                best, kept = z, left
        made.append(best / max(float(np.linalg.norm(best)), _TINY))
    out = np.stack(made, axis=1)
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return out * np.where(signs == 0, 1.0, signs)


# ---------------------------------------------------------------- Spark


def _moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of fit rows and their exact sums by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            n += x.shape[0]
            part = x.sum(axis=0).tolist() if _held(x, x.shape[0]) else x.astype(object).sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})

    parts = fit.select("x").mapInArrow(partial, "n long, sums array<string>")
    rows = parts.select("n", F.posexplode("sums").alias("dim", "sum")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    found = {r.dim: (r.n, int(r["sum"])) for r in rows.collect()}  # one row per dimension
    return found[0][0], [found[k][1] for k in range(width)]


def triangle(fit: DataFrame, means: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of the centred fit rows."""
    width = means.size
    schema = "part long, r binary"

    def row(part: int, r: np.ndarray) -> dict:
        return {"part": pa.array([part], pa.int64()), "r": pa.array([r.astype("<f8").tobytes()], pa.binary())}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            for at in range(0, x.shape[0], BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, x[at : at + BLOCK_ROWS] - means]), mode="r")
        yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId() // FAN_IN, r))

    def merged(group: pa.Table) -> pa.Table:
        stacked = np.vstack([np.frombuffer(b, dtype="<f8").reshape(-1, width) for b in group.column("r").to_pylist()])
        return pa.table(row(group.column("part")[0].as_py() // FAN_IN, np.linalg.qr(stacked, mode="r") if stacked.size else stacked))

    parts = fit.select("x").rdd.getNumPartitions()
    rs = fit.select("x").mapInArrow(reduced, schema)
    while parts > 1:
        rs = rs.groupBy("part").applyInArrow(merged, schema)
        parts = -(-parts // FAN_IN)
    last = np.vstack([np.frombuffer(bytes(r.r), dtype="<f8").reshape(-1, width) for r in rs.select("r").collect()])  # one row
    return np.vstack([last, np.zeros((max(0, width - last.shape[0]), width))])


def fit_model(fit: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    """Directions and variances of a table of distinct whole vectors ``x`` of one length."""
    n, sums = _moments(fit, width)
    model = Model(n, sums, [], np.zeros((width, 0)), 0.0)
    r = triangle(fit, model.means())
    diagonal, off, right = bidiagonal(r)
    values = dqds(diagonal, off)
    top = values[: min(components, width)]
    model.directions = directions(diagonal, off, top, right)
    model.variances = [s * s / n if s > 8 * width * _EPS * values[0] else 0.0 for s in top]
    model.trace = float((r * r).sum()) / n
    return model


def _projected(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with deviation and an array of whitened values (null where nothing varies)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    place = rows.columns.index("x")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(place), model.width)
            w = model.whitened(x).ravel()
            flat = pa.array(w, mask=np.isnan(w))
            ends = pa.array(np.arange(x.shape[0] + 1, dtype=np.int32) * len(model.variances))
            made = [pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return rows.mapInArrow(out, schema)


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    used = [k for k, fine in enumerate(model.usable) if fine]
    if not used:
        return 0.0
    w = _projected(fit.select("x"), model).select(*[F.col("w")[k].alias(f"w{k}") for k in used])
    pairs = [(a, b) for a in used for b in used if a <= b]
    found = w.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, vector: str = "embedding", keep: Iterable[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``doc`` (struct of ``keep``), component, n, deviation,
    whitened, explained, identity_error."""
    rows = vectors.select(F.struct(*[vectors[c] for c in keep]).alias("doc"), whole(vectors[vector]).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width = first.width if first else 1
    rows = rows.where(F.size("x") == width)
    fit = through_table(rows.select("x").distinct(), "vectors")
    if first:
        model = fit_model(fit, width, components)
        error = identity_error(fit, model)
    else:
        model, error = Model(1, [0], [0.0], np.zeros((1, 1)), 0.0), 0.0
    shares = F.array(*[F.lit(v / model.trace if model.trace > 0 else 0.0) for v in model.variances])
    out = _projected(rows, model).select("doc", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        "doc",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
