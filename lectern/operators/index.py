"""Positional word index of a corpus: positions, postings, ranges, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.phonemes import text_to_phonemes, word_to_phonemes
from lectern.functions.session import through_table
from lectern.functions.text import normalize_arabic
from lectern.operators.packed import Corpus, packed_verses


def word_index(verses: DataFrame, norm=normalize_arabic, need_space: bool = False) -> DataFrame:
    """One row per word with its 0-based position in the corpus and on its page.

    A view of the packed verses: only ``(id, page, word count)`` is summed up, and the text
    crosses the network once, in arrays.
    """
    return Corpus(packed_verses(verses, norm, need_space)).words()


def page_word_index(words: DataFrame) -> DataFrame:
    """Expected words of every page in order, 0-based on the page."""
    return words.select("page", "flat_index", "word_ref", "text", "norm")


def document_frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("norm").agg(F.count(F.lit(1)).alias("df"))


def postings(words: DataFrame) -> DataFrame:
    """Every position of every word, with the word's frequency.

    Runs a job: the frequencies are a table, so that Spark can split the side of a frequent
    word in the join.
    """
    return words.select("norm", "global_pos").join(through_table(document_frequency(words), "frequencies"), "norm")


def posting_chunks(words: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Sorted position arrays of every word, one per ``span`` positions of the corpus."""
    return (
        words.select("norm", F.floor(F.col("global_pos") / span).alias("chunk_no"), "global_pos")
        .groupBy("norm", "chunk_no")
        .agg(F.array_sort(F.collect_list("global_pos")).alias("positions"))
    )


def _ranges(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys).agg(
        F.min("global_pos").alias("start_pos"), F.max("global_pos").alias("end_pos")
    )


def chapter_ranges(words: DataFrame) -> DataFrame:
    """First and last word position of each chapter; unknown chapters are absent."""
    return _ranges(words, ["sura_no"])


def verse_ranges(words: DataFrame) -> DataFrame:
    return _ranges(words, ["sura_no", "aya_no"])


def chapter_verse_count(words: DataFrame) -> DataFrame:
    """Distinct verses among the words of each chapter."""
    return words.select("sura_no", "aya_no").distinct().groupBy("sura_no").agg(
        F.count(F.lit(1)).alias("n_verses")
    )


def word_at(positions: DataFrame, words: DataFrame) -> DataFrame:
    """Word at each asked position, nulls outside the corpus."""
    return positions.join(
        words.select(F.col("global_pos").alias("position"), "text", "word_ref"), "position", "left"
    )


def word_blocks(
    words: DataFrame, width: int, overlap: int = 0, cols=("norm",), only: DataFrame | None = None
) -> DataFrame:
    """The corpus cut into blocks of ``width`` words, each with the next ``overlap``.

    A block is a row ``(block, base, <col> arrays)`` of at most ``width + overlap``
    words, so slices are found by an equi-join on the block number. ``only`` holds the
    numbers of the blocks that are wanted; words of others are dropped before they are shuffled.
    """
    home = F.floor(F.col("global_pos") / width)
    reach = -(-overlap // width)
    blocks = F.filter(
        F.sequence(home - F.lit(reach), home),
        lambda b: (b >= 0) & (F.col("global_pos") < (b + 1) * width + overlap),
    )
    rows = words.select(
        F.explode(blocks).alias("block"),
        F.struct("global_pos", *cols).alias("w"),
    )
    if only is not None:
        rows = rows.join(only, "block", "left_semi")
    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return packed.select(
        "block",
        (F.col("block") * width).alias("base"),
        *[F.col("ws")[c].alias(c) for c in cols],
    )


def _window_words(windows: DataFrame, words: DataFrame, width: int, cols: list[str]) -> DataFrame:
    """Word rows of inclusive windows, found block by block."""
    asked = windows.withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("start_pos"), F.lit(0)) / width),
                F.floor(F.greatest(F.col("end_pos"), F.lit(0)) / width),
            )
        ),
    )
    placed = words.select(F.floor(F.col("global_pos") / width).alias("_block"), "global_pos", *cols)
    return asked.join(placed, "_block").filter(
        F.col("global_pos").between(F.col("start_pos"), F.col("end_pos"))
    )


def text_window(windows: DataFrame, words: DataFrame, width: int = 256) -> DataFrame:
    """Text of each ``(window_id, start_pos, end_pos)``, both ends included.

    Windows reaching past the corpus are cut to it; an empty one gives ''.
    """
    asked = windows.filter("start_pos <= end_pos").select("window_id", "start_pos", "end_pos")
    hits = _window_words(asked, words, width, ["text"])
    texts = hits.groupBy("window_id").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("global_pos", "text")))["text"], " "
        ).alias("window_text")
    )
    return windows.join(texts, "window_id", "left").withColumn(
        "window_text", F.coalesce("window_text", F.lit(""))
    )


def phoneme_window(windows: DataFrame, words: Corpus | DataFrame, width: int = 256) -> DataFrame:
    """Phonemes of each window and the corpus position of the word owning each.

    A packed corpus is met verse by verse; phonemes are made for words in windows only.
    """
    asked = windows.filter("start_pos <= end_pos").select("window_id", "start_pos", "end_pos")
    if isinstance(words, Corpus):
        parts = words.slices(asked).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("low", "line"))).alias("ps"))
        line = F.split(F.array_join(F.col("ps")["line"], " "), " ")
        packed = parts.select("window_id", F.transform(line, lambda w, i: F.struct(
            (F.col("ps")[0]["low"] + i).alias("global_pos"), word_to_phonemes(w).alias("phonemes"))).alias("ws"))
    else:
        spoken = words.select("global_pos", "phonemes") if "phonemes" in words.columns else words.select(
            "global_pos", F.flatten(text_to_phonemes(F.col("text"))).alias("phonemes")
        )
        hits = _window_words(asked, spoken, width, ["phonemes"])
        packed = hits.groupBy("window_id").agg(
            F.array_sort(F.collect_list(F.struct("global_pos", "phonemes"))).alias("ws")
        )
    owner = F.flatten(
        F.transform(
            "ws", lambda w: F.transform(w["phonemes"], lambda p: w["global_pos"])
        )
    )
    return windows.join(
        packed.select(
            "window_id", F.flatten(F.col("ws")["phonemes"]).alias("phonemes"), owner.alias("owners")
        ),
        "window_id",
        "left",
    )


def ref_to_range(refs: DataFrame, ranges: DataFrame, ref: str = "ref") -> DataFrame:
    """``s:a[:w][-s:a[:w]]`` to corpus positions; malformed text gives null.

    A verse the corpus lacks gives null too: position 0 would name a real word.
    """
    ends = F.split(F.col(ref), "-")

    def part(end: Column, i: int) -> Column:
        return F.try_element_at(F.split(end, ":"), F.lit(i)).try_cast("bigint")

    def word(end: Column) -> Column:
        parts = F.split(end, ":")
        return F.when(F.size(parts) > 2, part(end, 3)).otherwise(F.lit(1).cast("bigint"))

    first, last = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.size(ends))
    asked = refs.select(
        "*",
        F.when(F.size(ends) <= 2, part(first, 1)).alias("_s1"),
        part(first, 2).alias("_a1"), word(first).alias("_w1"),
        F.when(F.size(ends) <= 2, part(last, 1)).alias("_s2"),
        part(last, 2).alias("_a2"), word(last).alias("_w2"),
    )

    def places(i):
        return ranges.select(
            F.col("sura_no").alias(f"_s{i}"), F.col("aya_no").alias(f"_a{i}"),
            F.col("start_pos").alias(f"_p{i}"),
        )

    found = asked.join(places(1), ["_s1", "_a1"], "left").join(places(2), ["_s2", "_a2"], "left")
    start = F.col("_p1") + F.col("_w1") - 1
    end = F.col("_p2") + F.col("_w2") - 1
    known = start.isNotNull() & end.isNotNull()
    return found.select(
        *refs.columns,
        F.when(known, start).alias("start_pos"),
        F.when(known, end).alias("end_pos"),
    )
