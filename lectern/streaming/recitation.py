"""Live recitation: transcripts in, word events out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.folds import ordered_fold
from lectern.functions.text import normalize_arabic, split_words
from lectern.operators.matching import (
    CHUNK_SIMILARITY, CHUNK_WINDOW, INTERIM_SIMILARITY, INTERIM_WINDOW,
)
from lectern.streaming.folds import fold_late_stream, fold_stream

STATE = "pointer long, consumed long, paused boolean, n_errors long, done boolean, began double"
EVENTS = "seq long, type string, flat_index long, correct_words long, total_words long, duration double"


def asr_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Transcript rows, each (session, seq) once; the watermark bounds what is kept."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "seq"])


def likeness(a: str, b: str) -> float:
    """``1 - edits / longest`` of two short words."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = i
        diagonal = i - 1
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, left + 1, diagonal + (x != y))
            diagonal, row[j], left = row[j], cost, cost
    return 1.0 - row[-1] / max(len(a), len(b))


def _edits(places: dict[str, int], n: int, other: str) -> int:
    """Edit distance of ``other`` and a word of ``n`` letters, given by the places of each: a row of the table in two numbers."""
    full, high = (1 << n) - 1, 1 << n - 1
    up, down, score = full, 0, n
    for c in other:
        equal = places.get(c, 0) | down
        diagonal = ((equal & up) + up ^ up) | equal
        plus, minus = down | ~(diagonal | up), up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(diagonal | plus)) & full, plus & diagonal & full
    return score


def best_ahead(word: str, expected, pointer: int, window: int, least: float):
    """Place and likeness of the best of the next words, the earliest on ties.

    An equal word is the likest; else a word is looked at only if the lengths and letters of
    both leave room for it to be like enough and likelier than those before.
    """
    ahead = expected[pointer : pointer + window]
    for i, other in enumerate(ahead, pointer):
        if other == word:
            return i
    n = len(word)
    if not n:
        return None
    best, at, places = 0.0, None, {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    for i, other in enumerate(ahead, pointer):
        m = len(other)
        longest = n if n > m else m
        bound = 1.0 - (n - m if n > m else m - n) / longest
        if bound < least or bound <= best:
            continue
        # letters that the word lacks can only be replaced or dropped
        lacking = 0
        for c in other:
            if c not in places:
                lacking += 1
        bound = 1.0 - lacking / longest
        if bound < least or bound <= best:
            continue
        s = 1.0 - _edits(places, n, other) / longest
        if s > best:
            best, at = s, i
    return at if at is not None and best >= least else None


def start_tracking() -> dict:
    return {"pointer": 0, "consumed": 0, "paused": False, "n_errors": 0, "done": False, "began": None}


def _reveal(state, row, upto, wrong, total, out):
    for i in range(state["pointer"], min(upto, total)):
        bad = i in wrong
        state["n_errors"] += bad
        out.append((row["seq"], "error-detected" if bad else "word-revealed", i, None, None, None))
    state["pointer"] = max(state["pointer"], upto)
    _finish(state, row, total, out)


def _finish(state, row, total, out):
    if state["pointer"] >= total and not state["done"]:
        state["done"] = True
        out.append(
            (row["seq"], "tracking-complete", None, total - state["n_errors"], total, row["seconds"] - state["began"])
        )


def tracking_step(strict: bool):
    """Step of the tracker; strict mode stops at an error until it is corrected."""

    def step(state, row):
        expected, out = row["expected"], []
        total = len(expected)
        if not total:
            return [(row["seq"], "page-unknown", None, None, None, None)]
        if state["began"] is None:
            state["began"] = float(row["seconds"])
        if row["kind"] == "correct":
            if state["paused"]:
                out.append((row["seq"], "error-corrected", state["pointer"], None, None, None))
                state["paused"] = False
                state["pointer"] += 1
                _finish(state, row, total, out)
            return out
        if state["paused"] or state["pointer"] >= total:
            return out
        words = row["words"]
        if not row["is_final"]:
            fresh = words[state["consumed"]:]
            state["consumed"] = max(state["consumed"], len(words))
            for word in fresh:
                if state["pointer"] >= total:
                    break
                at = best_ahead(word, expected, state["pointer"], INTERIM_WINDOW, INTERIM_SIMILARITY)
                if at is not None:
                    _reveal(state, row, at + 1, (), total, out)
            return out
        state["consumed"] = 0
        pointer, wrong, hits = state["pointer"], [], 0
        for word in words:
            if pointer >= total:
                break
            at = best_ahead(word, expected, pointer, CHUNK_WINDOW, CHUNK_SIMILARITY)
            if at is not None:
                wrong.extend(range(pointer, at))
                pointer = at + 1
                hits += 1
        if not hits:
            return out
        if strict and wrong:
            _reveal(state, row, wrong[0], (), total, out)
            state["n_errors"] += 1
            state["paused"] = True
            out.append((row["seq"], "error-detected", wrong[0], None, None, None))
            return out
        _reveal(state, row, pointer, set(wrong), total, out)
        return out

    return step


def page_words(words: DataFrame) -> DataFrame:
    """(page, expected): normalised words of each page; such a table is taken as it is."""
    if "expected" in words.columns:
        return words.select("page", "expected")
    return words.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("flat_index", "norm")))["norm"].alias("expected")
    )


def _heard(transcripts: DataFrame, norm) -> DataFrame:
    return transcripts.select(
        "session", "page", "seq", "kind", "is_final",
        F.col("ts").cast("double").alias("seconds"),
        F.transform(split_words(F.col("text")), norm).alias("words"),
    )


def with_expected(transcripts: DataFrame, words: DataFrame, norm=normalize_arabic) -> DataFrame:
    """Transcripts with normalised words and their page's expected words, in the JVM.

    ``transcripts`` is ``(session, page, seq, ts, kind, text, is_final)``; a page's words
    travel with each row, a page being the unit a session recites. A page that the corpus
    lacks has no words; its rows stay, and the tracker says so.
    """
    rows = _heard(transcripts, norm).join(page_words(words), "page", "left")
    return rows.withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))


_IN_ROW = ["seq", "kind", "is_final", "seconds", "words"]


def _line(words) -> Column:
    """Words as lines of one text, null without any: smaller in a shuffle than an array."""
    return F.when(F.size(words) > 0, F.array_join(words, "\n"))


def _lines(text) -> list[str]:
    return text.split("\n") if isinstance(text, str) else []


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one session and page in one row."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        same = np.ones(n - 1, dtype=bool)
        for name in ("session", "page"):
            column = batch.column(name)
            same &= pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.append(True, ~same))
        ends = pa.array(np.append(head, n), pa.int32())
        rows = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in _IN_ROW]
        take = pa.array(head)
        yield pa.RecordBatch.from_arrays(
            [batch.column("session").take(take), batch.column("page").take(take), *rows], names=["session", "page", *_IN_ROW]
        )


def _unpack(batch: pd.DataFrame) -> Iterator[dict]:
    for expected, *packed in zip(*[batch[c].array for c in ("expected", *_IN_ROW)]):
        words = _lines(expected)
        for values in zip(*packed):
            row = dict(zip(_IN_ROW, values), expected=words)
            row["words"] = _lines(row["words"])
            yield row


def _tracked_stream(transcripts: DataFrame, words: DataFrame, strict: bool, norm=normalize_arabic) -> DataFrame:
    """The fold of a stream: a page's words travel once with all rows of a session that stand together."""
    heard = _heard(transcripts, norm).withColumn("words", _line(F.col("words"))).select("session", "page", *_IN_ROW)
    keys = [T.StructField(c, heard.schema[c].dataType) for c in ("session", "page")]
    packed = heard.mapInArrow(_pack, T.StructType([*keys, *(T.StructField(c, T.ArrayType(heard.schema[c].dataType)) for c in _IN_ROW)]))
    rows = packed.join(page_words(words).select("page", _line(F.col("expected")).alias("expected")), "page", "left")
    return fold_stream(rows, ["session"], "seq", start_tracking, tracking_step(strict), STATE, EVENTS, _unpack)


def track_recitation(transcripts: DataFrame, words: DataFrame, strict: bool = False, lateness: str | None = None) -> DataFrame:
    """Word events of every session, from a stream or from a table of transcripts.

    ``words`` is the corpus by word, or ``(page, expected)``. Each session's rows are folded in
    order of ``seq``. With ``lateness`` (such as ``10 seconds``) the rows of a stream may arrive
    out of order by that much.
    """
    if transcripts.isStreaming and lateness is None:
        return _tracked_stream(transcripts, words, strict)
    rows = with_expected(transcripts, words)
    if transcripts.isStreaming:
        rows = rows.withColumn("at", F.timestamp_millis((F.col("seconds") * 1000).cast("bigint")))
        return fold_late_stream(rows, ["session"], "seq", start_tracking, tracking_step(strict), STATE, EVENTS, "at", lateness)
    return ordered_fold(rows, ["session"], ["seq"], start_tracking, tracking_step(strict), EVENTS)


__all__ = ["asr_stream", "track_recitation", "with_expected"]
