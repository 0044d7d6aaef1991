"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words
edged by a blank) of a language's training texts. A document's own most frequent n-grams are
ranked likewise; its out-of-place distance to a profile is the sum over them of how far the
ranks lie apart, the largest distance standing for an n-gram that the profile lacks. The
nearest profile gives the language.

Profiles come from all training texts: tasks count n-grams per language and merge them before
anything is shuffled, and partial counts meet under (language, n-gram). Only the profiles, a
few hundred rows per language, reach the driver; more than ``MAX_LANGUAGES`` languages is an
error, as the column then holds something else.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is everything if
nothing was learnt; null languages teach nothing; equal distances go to the language first
in the alphabet; of n-grams of equal counts the shorter goes first, then that of lower code
points, in profiles and documents alike; repeated rows count and
are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.text import pieces, runs

PROFILE = 400
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: partial counts held by a task before they are handed on
_HELD = 500_000
_POINT = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Grams:
    """Counted letter n-grams of a run of texts, by text and then by n-gram.

    ``gram`` holds up to three code points of 21 bits; 0 stands for the edge of a word.
    ``first[d]:first[d + 1]`` are those of text ``d``.
    """

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
        points = np.where(_letters()[points], points, 0)
        keep = np.ones(points.size, dtype=bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0)  # one blank between words
        owner = np.repeat(np.arange(sizes.size), sizes)
        owner = np.concatenate([[0], owner])[keep]
        c = points[keep]
        alphabet = np.flatnonzero(np.bincount(c)) if c.size else np.zeros(1, dtype=np.int64)
        if alphabet[0] != 0:
            alphabet = np.concatenate([[0], alphabet])
        bits = max(1, int(alphabet.size - 1).bit_length())
        number = np.zeros(int(alphabet[-1]) + 1, dtype=np.uint64)
        number[alphabet] = np.arange(alphabet.size)
        c = number[c]
        b = np.uint64(bits)
        two = (c[:-1] << b) | c[1:]
        three = (two[:-1] << b) | c[2:]
        space = np.uint64(3 * bits + 2)
        kinds = []
        letter = c != 0
        kinds.append((c[letter], owner[letter], 1))
        kinds.append((two, np.maximum(owner[:-1], owner[1:]), 2))
        whole = c[1:-1] != 0
        kinds.append((three[whole], owner[1:-1][whole], 3))
        # owner and n-gram share one sort key where they fit, else texts are sorted one by one
        codes = np.concatenate([(g | (np.uint64(n) << np.uint64(3 * bits))) for g, _, n in kinds])
        whose = np.concatenate([o for _, o, _ in kinds]).astype(np.uint64)
        if int(space) + max(1, int(sizes.size).bit_length()) <= 64:
            key = np.sort((whose << space) | codes)
            start, self.times = runs(key)
            self.owner = (key[start] >> space).astype(np.int64)
            code = key[start] & np.uint64((1 << int(space)) - 1)
        else:
            order = np.lexsort((codes, whose))
            changed = np.ones(order.size, dtype=bool)
            changed[1:] = (np.diff(codes[order]) != 0) | (np.diff(whose[order]) != 0)
            start = np.flatnonzero(changed)
            self.times = np.diff(np.append(start, order.size))
            self.owner, code = whose[order][start].astype(np.int64), codes[order][start]
        mask = np.uint64((1 << bits) - 1)
        real = alphabet.astype(np.uint64)
        kind = code >> np.uint64(3 * bits)
        a, m, z = ((code >> (b * np.uint64(2))) & mask), ((code >> b) & mask), (code & mask)
        spelt = (real[a] << (_POINT * np.uint64(2))) | (real[m] << _POINT) | real[z]
        # the kind tells a blank from no letter: bit 63 marks three, bit 62 (unused by two) marks two
        self.gram = spelt | ((kind == 3).astype(np.uint64) << np.uint64(63)) | ((kind == 2).astype(np.uint64) << np.uint64(62))
        self.first = np.searchsorted(self.owner, np.arange(sizes.size + 1))


def spelling(gram: int) -> str:
    """An n-gram as text, edges of words shown as blanks."""
    points = [(gram >> s) & 0x1FFFFF for s in (42, 21, 0)]
    if not gram >> 63 & 1:
        points = points[1:] if gram >> 62 & 1 else points[2:]
    return "".join(chr(p) if p else " " for p in points)


def profiles(docs: DataFrame, lang: str = "lang", size: int = PROFILE, learn: Column | None = None) -> DataFrame:
    """lang, rank (from 1), gram and its count for each language's most frequent n-grams."""
    rows = (docs if learn is None else docs.where(learn)).where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        room = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, times = _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * grams.size), pa.array(grams.view(np.int64)), pa.array(times, pa.int64())], names=["lang", "gram", "n"]
                )

        for batch in batches:
            for part in pieces(batch):
                made = Grams(part.column("text").to_pylist())
                names = np.array(part.column("lang").to_pylist(), dtype=object)
                for name in sorted(set(names)):
                    own = (names == name)[made.owner]
                    held.setdefault(name, []).append(_sum_by(made.gram[own], made.times[own]))
                    room += held[name][-1][0].size
                if room > _HELD:
                    held = {k: [_sum_by(np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v]))] for k, v in held.items()}
                    room = sum(v[0][0].size for v in held.values())
                    if room > _HELD:
                        yield from merged()
                        held, room = {}, 0
        yield from merged()

    totals = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # as unsigned numbers, as in documents: one letter, two, three (bit 63)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _sum_by(grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    start, _ = runs(grams[order])
    return grams[order][start], np.add.reduceat(times[order], start) if start.size else times


class Profiles:
    """Ranks by language over the sorted union of all profiles' n-grams."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] & 0xFFFFFFFFFFFFFFFF for r in rows}), dtype=np.uint64)
        self.ranks = np.full((len(self.langs), self.grams.size + 1), -1, dtype=np.int32)
        at = {name: n for n, name in enumerate(self.langs)}
        for name, gram, rank in rows:
            place = int(np.searchsorted(self.grams, np.uint64(gram & 0xFFFFFFFFFFFFFFFF)))
            self.ranks[at[name], place] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        made = Grams(texts)
        n = len(texts)
        order = np.argsort((made.owner << 32) | (0xFFFFFFFF - made.times), kind="stable")
        rank = np.arange(order.size) - made.first[made.owner[order]] + 1
        top = order[rank <= self.size]
        owner, rank, gram = made.owner[top], rank[rank <= self.size], made.gram[top]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        count = np.diff(bounds)
        some = np.flatnonzero(count)
        if not self.langs or not some.size:
            return [UNKNOWN] * n, np.zeros(n)
        place = np.minimum(np.searchsorted(self.grams, gram), self.grams.size - 1)
        place = np.where(self.grams[place] == gram, place, self.grams.size)
        best = np.full(some.size, np.iinfo(np.int64).max)
        chosen = np.zeros(some.size, dtype=np.int64)
        for k in range(len(self.langs)):
            own = self.ranks[k][place]
            apart = np.where(own < 0, self.size, np.minimum(np.abs(own - rank), self.size))
            distance = np.add.reduceat(apart, bounds[some])
            nearer = distance < best
            best[nearer], chosen[nearer] = distance[nearer], k
        names = [UNKNOWN] * n
        score = np.zeros(n)
        for d, k in zip(some.tolist(), chosen.tolist()):
            names[d] = self.langs[k]
        score[some] = 1 - best / (count[some] * self.size)
        return names, score


def learn(docs: DataFrame, lang: str = "lang", size: int = PROFILE, among: Column | None = None) -> Profiles:
    rows = profiles(docs, lang, size, among).select("lang", "gram", "rank").limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang!r}")
    return Profiles([(r.lang, r.gram, r.rank) for r in rows], size)


def predict(docs: DataFrame, model: Profiles, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``doc`` (a struct of ``keep``), lang_pred and score of every document."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"))
    schema = T.StructType(
        [T.StructField("doc", rows.schema["doc"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, target=1 << 20):
                names, score = sent.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(names), pa.array(score)], names=["doc", "lang_pred", "score"])

    return rows.mapInArrow(predicted, schema)
