"""The corpus packed by verse: arrays of words with running offsets, a word row only as a view.

One row per verse holds its words, the corpus position of the first one and that of its page's
first one. Parquet codes the arrays by dictionary, so the table is smaller than the text; word
rows, page sizes, ranges and blocks of consecutive words are made from it when asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ordering import running_offset
from lectern.functions.session import broadcast_if_small, through_table
from lectern.functions.text import normalize_arabic, strip_verse_number, word_ref

#: least words of a block that rows are matched against, and of its overlap with the next
BLOCK_WORDS, OVERLAP_WORDS = 16384, 256
#: weight of the rows that meet one block in one task
TASK_WEIGHT = 32768
#: positions of a bucket that single positions are looked up in
BUCKET = 256
#: verse ids of a block whose offsets are summed together
VERSE_BLOCK = 1024
#: white space other than a single blank
ODD_SPACES = r"(?U)\s{2,}|[\s&&[^ ]]"


def tokenised_verses(verses: DataFrame, norm=normalize_arabic, need_space: bool = False, with_norms: bool = True) -> DataFrame:
    """id, page, sura_no, aya_no, sura_name_en, texts, norms, and where a verse stands in its
    block of ``VERSE_BLOCK`` ids: words before it (inside) and before its page there (page_inside).
    Without ``with_norms``, ``with_norms_of_texts`` tells them on reading.

    ``norm`` must work letter by letter: it is applied to the line of a verse's words, and word by
    word only where a word vanishes. Lines, not arrays, cross the network, once.
    """
    block = F.floor(F.col("id") / VERSE_BLOCK)
    rows = verses.select("id", "page", "sura_no", "aya_no", "sura_name_en", block.alias("block"), _line(need_space).alias("line")).repartition("block")
    rows = rows.withColumn("n", F.size(_texts()).cast("bigint"))
    before = F.sum("n").over(W.partitionBy("block").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(before, F.lit(0)))
    rows = rows.withColumn("page_inside", F.min("inside").over(W.partitionBy("block", "page"))).withColumn("normal", norm(F.col("line")))
    norms = [_norms(norm).alias("norms")] if with_norms else []
    return rows.select("id", "page", "sura_no", "aya_no", "sura_name_en", "block", "n", "inside", "page_inside", _texts().alias("texts"), *norms)


def with_norms_of_texts(tokens: DataFrame, norm=normalize_arabic) -> DataFrame:
    """Tokenised verses with ``norms`` as a view: what does not ask for them does not pay for them."""
    rows = tokens.withColumn("line", F.array_join("texts", " ")).withColumn("normal", norm(F.col("line")))
    return rows.withColumn("norms", _norms(norm)).drop("line", "normal")


def _line(need_space: bool) -> Column:
    """Words of a verse between single blanks."""
    return F.regexp_replace(strip_verse_number(F.col("aya_text"), need_space), ODD_SPACES, " ")


def _texts() -> Column:
    return F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))


def _norms(norm) -> Column:
    """Normal forms of a line's words, from its own normal form; null if that is the line."""
    words = F.split("normal", " ")
    return F.when(F.col("normal") != F.col("line"), F.when(F.size(words) == F.size(_texts()), words).otherwise(F.transform(_texts(), norm)))


def tokenised_lines(verses: DataFrame, norm=normalize_arabic, need_space: bool = False) -> DataFrame:
    """sura_no, aya_no, texts, norms of verses that need no ids yet; nothing is shuffled."""
    rows = verses.select("sura_no", "aya_no", _line(need_space).alias("line")).withColumn("normal", norm(F.col("line")))
    return rows.select("sura_no", "aya_no", _texts().alias("texts"), _norms(norm).alias("norms"))


@dataclass(frozen=True)
class Lines:
    """A table of ``tokenised_lines``: what can be told of the words without placing all of them."""

    verses: DataFrame

    def words(self) -> DataFrame:
        return self.verses.select("sura_no", "aya_no", F.explode(F.coalesce("norms", "texts")).alias("norm"))

    def count(self) -> int:
        return self.verses.agg(F.sum(F.size("texts"))).first()[0] or 0

    def chapter_verse_count(self) -> DataFrame:
        """Verses with words of each chapter."""
        return self.verses.filter(F.size("texts") > 0).groupBy("sura_no").agg(F.countDistinct("aya_no").alias("n_verses"))

    def places_of(self, asked: DataFrame) -> DataFrame:
        """(norm, global_pos) of every place of the words ``norm`` of ``asked``.

        Words are found first; only their rows and the sizes of verses meet the words before.
        """
        sizes = self.verses.groupBy("sura_no").agg(F.sum(F.size("texts")).alias("n"))
        chapters = running_offset(sizes, "sura_no", "n", "before")
        wanted = broadcast_if_small(asked.select("norm").distinct())
        words = self.verses.select("sura_no", "aya_no", F.posexplode(F.coalesce("norms", "texts")).alias("pos", "norm"))
        hits = words.join(wanted, "norm", "left_semi")
        # a chapter's own sizes are met only for chapters that are hit
        held = through_table(hits, "hits")
        lengths = self.verses.select("sura_no", "aya_no", F.size("texts").alias("n")).join(held.select("sura_no").distinct(), "sura_no", "left_semi")
        before = F.coalesce(F.sum("n").over(W.partitionBy("sura_no").orderBy("aya_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = lengths.withColumn("inside", before).join(chapters, "sura_no").select("sura_no", "aya_no", (F.col("before") + F.col("inside")).alias("start"))
        return held.join(starts, ["sura_no", "aya_no"]).select("norm", (F.col("start") + F.col("pos")).alias("global_pos"))


def block_bases(tokens: DataFrame) -> DataFrame:
    """Words before each block of verses, and where pages that began in an earlier block start."""
    sizes = tokens.groupBy("block").agg(F.sum("n").alias("n"))
    bases = running_offset(sizes, "block", "n", "base")
    begun = tokens.groupBy("block", "page").agg(F.min("page_inside").alias("at")).join(bases, "block")
    first = begun.groupBy("page").agg(F.min(F.col("base") + F.col("at")).alias("first"), F.count(F.lit(1)).alias("blocks"))
    earlier = begun.join(first.filter("blocks > 1"), "page").filter("first < base").groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("page", "first"))).alias("earlier")
    )
    return bases.join(earlier, "block", "left")


def placed_verses(tokens: DataFrame, bases: DataFrame) -> DataFrame:
    """``packed_verses`` as a view of tokenised verses and the table of block bases."""
    page_start = F.coalesce(F.try_element_at("earlier", F.col("page")), F.col("base") + F.col("page_inside"))
    return tokens.join(bases, "block").select(
        "id", "page", "sura_no", "aya_no", "sura_name_en",
        (F.col("base") + F.col("inside")).alias("start"), page_start.alias("page_start"), "texts", "norms",
    )


def packed_verses(verses: DataFrame, norm=normalize_arabic, need_space: bool = False) -> DataFrame:
    """id, page, sura_no, aya_no, sura_name_en, start, page_start, texts, and norms where a
    word's normal form differs from its text (null else).

    Verse ids are dense and pages follow verse order. Runs a job: tokenised verses are written
    once with their offsets inside blocks of ids; only one row a block is summed and joined.
    """
    tokens = through_table(tokenised_verses(verses, norm, need_space), "tokens")
    return placed_verses(tokens, broadcast_if_small(block_bases(tokens)))


@dataclass(frozen=True)
class Corpus:
    """A table of packed verses."""

    verses: DataFrame

    def words(self) -> DataFrame:
        """A row per word, as ``word_index`` gives them."""
        rows = self.verses.select("*", F.posexplode("texts").alias("pos", "text"))
        at, word_no = F.col("start") + F.col("pos"), (F.col("pos") + 1).cast("bigint")
        return rows.select(
            at.alias("global_pos"),
            "id", "page", "sura_no", "aya_no", "sura_name_en",
            word_no.alias("word_no"),
            "text",
            F.coalesce(F.get("norms", F.col("pos")), F.col("text")).alias("norm"),
            (at - F.col("page_start")).alias("flat_index"),
            word_ref(F.col("sura_no"), F.col("aya_no"), word_no).alias("word_ref"),
        )

    def count(self) -> int:
        return self.verses.agg(F.sum(F.size("texts"))).first()[0] or 0

    def page_starts(self) -> DataFrame:
        """First position and number of words of each page."""
        return self.verses.groupBy("page").agg(
            F.min("page_start").alias("page_start"), F.sum(F.size("texts")).cast("bigint").alias("page_words")
        ).filter("page_words > 0")

    def chapter_ranges(self) -> DataFrame:
        return self._ranges(["sura_no"])

    def verse_ranges(self) -> DataFrame:
        return self._ranges(["sura_no", "aya_no"])

    def _ranges(self, keys: list[str]) -> DataFrame:
        held = self.verses.filter(F.size("texts") > 0)
        return held.groupBy(*keys).agg(F.min("start").alias("start_pos"), F.max(F.col("start") + F.size("texts") - 1).alias("end_pos"))

    def blocks(self, width: int, overlap: int = 0, only: DataFrame | None = None, word: str = "norm") -> DataFrame:
        """(block, base, words): ``width`` consecutive words each, with the next ``overlap``.

        A verse is cut into the blocks it touches, so no word becomes a row. ``only`` holds the
        numbers of the blocks that are wanted.
        """
        words = F.col("texts") if word == "text" else F.coalesce("norms", "texts")
        end = F.col("start") + F.size("texts")
        first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / width))
        rows = self.verses.filter(F.size("texts") > 0).select(
            "start", end.alias("end"), words.alias("w"), F.explode(F.sequence(first, F.floor((end - 1) / width))).alias("block")
        )
        if only is not None:
            rows = rows.join(only, "block", "left_semi")
        low = F.greatest(F.col("start"), F.col("block") * width)
        high = F.least(F.col("end"), (F.col("block") + 1) * width + overlap)
        parts = rows.select("block", low.alias("low"), F.slice("w", (low - F.col("start")).cast("int") + 1, (high - low).cast("int")).alias("w"))
        packed = parts.filter(F.size("w") > 0).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("low", "w"))).alias("parts"))
        return packed.select("block", (F.col("block") * width).alias("base"), F.flatten(F.col("parts")["w"]).alias("words"))

    def block_lines(self, blocks: DataFrame, width: int, overlap: int = 0, word: str = "norm") -> DataFrame:
        """``blocks`` with what each has of each verse, in a row: base, low (first position) and line
        (words between single blanks). They cross the network as lines, a verse for itself."""
        words = F.col("texts") if word == "text" else F.coalesce("norms", "texts")
        end = F.col("start") + F.size("texts")
        first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / width))
        rows = self.verses.filter(F.size("texts") > 0).select(
            "start", end.alias("end"), words.alias("w"), F.explode(F.sequence(first, F.floor((end - 1) / width))).alias("block")
        ).join(blocks, "block")
        low = F.greatest(F.col("start"), F.col("block") * width)
        high = F.least(F.col("end"), (F.col("block") + 1) * width + overlap)
        cut = F.slice("w", (low - F.col("start")).cast("int") + 1, (high - low).cast("int"))
        return rows.filter(high > low).select(*blocks.columns, (F.col("block") * width).alias("base"), low.alias("low"), F.array_join(cut, " ").alias("line"))

    def parts(self, *by: str) -> DataFrame:
        """All words of each part of the corpus, in order, in a row: ``by``, flat_index of the
        first word, texts, norms. Name a bounded part, such as what a chapter has on a page."""
        # as lines in the shuffle, normal forms only where they differ
        verse = F.struct(
            "start", (F.col("start") - F.col("page_start")).alias("flat"),
            F.array_join("texts", " ").alias("texts"), F.array_join("norms", " ").alias("norms"),
        )
        held = self.verses.filter(F.size("texts") > 0).groupBy(*by).agg(F.array_sort(F.collect_list(verse)).alias("v"))
        norms = F.transform("v", lambda v: F.coalesce(v["norms"], v["texts"]))
        return held.select(
            *by, F.col("v")[0]["flat"].alias("flat_index"),
            F.split(F.array_join(F.col("v")["texts"], " "), " ").alias("texts"), F.split(F.array_join(norms, " "), " ").alias("norms"),
        )

    def slices(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the words of their ranges ``start_pos`` to ``end_pos``, a row per verse met:
        low (first position), sura_no, aya_no, first_word_no, line (words between blanks), n.

        Ranges and verses meet in the first bucket of positions that both touch, so only lines of
        text are shuffled and no word becomes a row. Positions outside the corpus are dropped.
        """
        end = F.col("start") + F.size("texts") - 1
        spans = self.verses.filter(F.size("texts") > 0).select(
            "sura_no", "aya_no", F.col("start").alias("_start"), end.alias("_end"), F.array_join("texts", " ").alias("_line"),
            F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(end / BUCKET))).alias("_bucket"),
        )
        first, last = (F.floor(F.greatest(F.col(c), F.lit(0)) / BUCKET) for c in ("start_pos", "end_pos"))
        asked = rows.filter("start_pos <= end_pos AND end_pos >= 0").withColumn("_bucket", F.explode(F.sequence(first, last)))
        met = asked.join(spans, "_bucket").filter((F.col("_start") <= F.col("end_pos")) & (F.col("_end") >= F.col("start_pos")))
        met = met.filter(F.col("_bucket") == F.greatest(first, F.floor(F.col("_start") / BUCKET)))
        low, high = F.greatest("start_pos", "_start"), F.least("end_pos", "_end")
        upto = F.call_function("substring_index", F.col("_line"), F.lit(" "), (high - F.col("_start") + 1).cast("int"))
        line = F.call_function("substring_index", upto, F.lit(" "), (low - high - 1).cast("int"))
        return met.select(
            *rows.columns, low.alias("low"), "sura_no", "aya_no", (low - F.col("_start") + 1).alias("first_word_no"),
            line.alias("line"), (high - low + 1).alias("n"),
        )

    def places(self, rows: DataFrame, at: str = "global_pos") -> DataFrame:
        """``rows`` with the verse and page of the corpus position ``at``; unknown ones are dropped."""
        end = F.col("start") + F.size("texts") - 1
        spans = self.verses.filter(F.size("texts") > 0).select(
            "sura_no", "aya_no", "page", F.col("start").alias("_start"), end.alias("_end"), "page_start",
            F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(end / BUCKET))).alias("_bucket"),
        )
        found = rows.withColumn("_bucket", F.floor(F.col(at) / BUCKET)).join(spans, "_bucket").filter(F.col(at).between(F.col("_start"), F.col("_end")))
        return found.withColumn("flat_index", F.col(at) - F.col("page_start")).drop("_bucket", "_start", "_end", "page_start")

    def with_ref(self, rows: DataFrame, at: str, name: str) -> DataFrame:
        """``rows`` with the word reference ``name`` of the corpus position ``at``, null outside the corpus."""
        end = F.col("start") + F.size("texts") - 1
        spans = self.verses.filter(F.size("texts") > 0).select(
            F.col("sura_no").alias("_sura"), F.col("aya_no").alias("_aya"), F.col("start").alias("_start"), end.alias("_end"),
            F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(end / BUCKET))).alias("_bucket"),
        )
        inside = (F.floor(F.col(at) / BUCKET) == F.col("_bucket")) & F.col(at).between(F.col("_start"), F.col("_end"))
        ref = F.when(F.col("_start").isNotNull(), word_ref(F.col("_sura"), F.col("_aya"), F.col(at) - F.col("_start") + 1))
        return rows.join(spans, inside, "left").select(*rows.columns, ref.alias(name))


def as_corpus(words: Corpus | DataFrame) -> Corpus:
    """A packed corpus as it is; word rows (as ``word_index`` gives them) packed by verse.

    Rows without verse ids are packed by runs of consecutive positions; what else they lack is null.
    """
    if isinstance(words, Corpus):
        return words
    kinds = {"page": "bigint", "sura_no": "bigint", "aya_no": "bigint", "sura_name_en": "string", "flat_index": "bigint"}
    given = {"id": F.floor(F.col("global_pos") / BUCKET), "text": F.col("norm")} | {c: F.lit(None).cast(k) for c, k in kinds.items()}
    words = words.withColumns({c: v for c, v in given.items() if c not in words.columns})
    keys = ["id", "page", "sura_no", "aya_no", "sura_name_en"]
    packed = words.groupBy(*keys).agg(
        F.min("global_pos").alias("start"),
        F.min(F.col("global_pos") - F.col("flat_index")).alias("page_start"),
        F.array_sort(F.collect_list(F.struct("global_pos", "text", "norm"))).alias("ws"),
    )
    return Corpus(packed.select(*keys, "start", "page_start", F.col("ws")["text"].alias("texts"), F.col("ws")["norm"].alias("norms")))


def length_class(reach: Column) -> Column:
    """Power of two, ``OVERLAP_WORDS`` at least, that holds ``reach`` words."""
    least = F.greatest(reach, F.lit(OVERLAP_WORDS)).cast("double")
    return F.pow(F.lit(2), F.ceil(F.log2(least))).cast("bigint")


def over_blocks(
    rows: DataFrame, corpus: Corpus, fn: Callable[[pa.Table, int, pa.Array], pa.Table], schema, weight: Column | None = None, word: str = "norm"
) -> DataFrame:
    """``fn(rows, base, words)`` of rows and the block of the corpus they begin in.

    ``rows`` has ``_at``, a corpus position, and ``_reach``, the words it may need from there on;
    other columns are passed through. Rows of about equal reach share a width, so one long row
    does not widen the blocks of the others. A block that many rows begin in is met in several
    tasks, each with a part of about ``TASK_WEIGHT``. Runs jobs: the rows are written once.
    """
    held = through_table(rows.withColumn("_class", length_class(F.col("_reach"))), "met")
    classes = sorted(r[0] for r in held.select("_class").distinct().collect())  # at most one per power of two
    out = None
    for overlap in classes or [OVERLAP_WORDS]:
        width = max(BLOCK_WORDS, overlap)
        placed = held.where(F.col("_class") == overlap).drop("_class", "_reach").withColumn("block", F.floor(F.col("_at") / width))
        load = placed.groupBy("block").agg(F.sum(F.lit(1) if weight is None else weight).alias("_load"))
        parts = broadcast_if_small(load.select("block", F.ceil(F.col("_load") / TASK_WEIGHT).cast("int").alias("_parts")))
        spread = placed.join(parts, "block").withColumn("_part", F.pmod(F.xxhash64(*placed.columns), F.col("_parts")).cast("int")).drop("_parts")
        lines = corpus.block_lines(parts, width, overlap, word)
        lines = lines.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("block", "_part", "base", "low", "line")

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return fn(left.slice(0, 0), 0, pa.array([], pa.string()))
            verses = right.column("line").combine_chunks().take(pc.sort_indices(right.column("low").combine_chunks()))
            return fn(left, right.column("base")[0].as_py(), pc.split_pattern(verses, " ").flatten())

        done = spread.groupBy("block", "_part").cogroup(lines.groupBy("block", "_part")).applyInArrow(met, schema)
        out = done if out is None else out.unionByName(done)
    return out
