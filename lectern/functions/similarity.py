"""Word similarity in the JVM, and indel ratios as Arrow UDFs, all pairs of a batch in lanes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import lanes
from lectern.functions.lanes import common_subsequence

def word_similarity(a: Column, b: Column) -> Column:
    """``1 - edits / longest`` in doubles; equal words give 1, one empty word 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))
    )


def indel_percent(a: str, b: str) -> float:
    """``200 * lcs / (len(a) + len(b))``; two empty texts count as equal."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def partial_percent(a: str, b: str, swapped: bool = False) -> float:
    """Best indel percent of the shorter text against windows of the longer.

    Windows may hang over either end, as they do when the best place is an edge.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if n == 0:
        return 100.0 if m == 0 else 0.0
    letters = set(short)
    best = 0.0
    for i in range(1, n):
        if long[i - 1] in letters:
            best = max(best, indel_percent(short, long[:i]))
    for i in range(m - n):
        if long[i + n - 1] in letters:
            best = max(best, indel_percent(short, long[i : i + n]))
            if best == 100.0:
                return best
    for i in range(m - n, m):
        if long[i] in letters:
            best = max(best, indel_percent(short, long[i:]))
    return best if n < m or best == 100.0 or swapped else max(best, partial_percent(long, short, True))


def _paired(a: pa.Array, b: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts of two columns, the numbers of each row's shorter and longer text, and their lengths."""
    texts, at = lanes.distinct(pa.concat_arrays([a, b]))
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    i, j = at[: len(a)], at[len(a) :]
    turned = size[i] > size[j]
    short, long = np.where(turned, j, i), np.where(turned, i, j)
    return texts, short, long, size[short], size[long]


def indel_percents(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``indel_percent`` of every row of two columns; a null counts as empty."""
    texts, short, long, n, m = _paired(a, b)
    common = lanes.common_subsequences(texts, texts, short, long)
    return np.where(n + m == 0, 100.0, 200.0 * common / np.maximum(n + m, 1))


def partial_percents(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``partial_percent`` of every row of two columns; a null counts as empty."""
    texts, short, long, n, m = _paired(a, b)
    out = np.where(m == 0, 100.0, 0.0)
    some, even = np.flatnonzero(n > 0), np.flatnonzero((n > 0) & (n == m))
    # texts of one length are tried both ways
    rows = np.concatenate([some, even])
    best = lanes.best_windows(texts, texts, np.concatenate([short[some], long[even]]), np.concatenate([long[some], short[even]]))
    np.maximum.at(out, rows, best)
    return out


def _strings(texts: pd.Series) -> pa.Array:
    return pa.array(texts, pa.string(), from_pandas=True)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio in percent, for pairs that a join has already narrowed down; null if a text is."""
    return pd.Series(indel_percents(_strings(a), _strings(b))).where((a.notna() & b.notna()).to_numpy())


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best indel ratio in percent of the shorter text against windows of the longer; null if a text is."""
    return pd.Series(partial_percents(_strings(a), _strings(b))).where((a.notna() & b.notna()).to_numpy())


def letter_counts(text: Column) -> Column:
    """Map from each letter of a text to how often it occurs."""
    letters = F.split(text, "")
    return F.map_from_entries(
        F.transform(F.array_distinct(letters), lambda c: F.struct(c.alias("key"), F.size(F.filter(letters, lambda x: x == c)).alias("value")))
    )


def shared_letters(a: Column, b: Column) -> Column:
    """Letters two maps of counts have in common: no common subsequence is longer."""
    return F.aggregate(
        F.map_entries(a), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))
    )
