"""Corpus catalogue: verses by page, chapter and part, references, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.folds import ordered_fold
from lectern.functions.session import broadcast_if_small, through_table

# --- fixed values -----------------------------------------------------------
MEDINAN_CHAPTERS = (
    2, 3, 4, 5, 8, 9, 22, 24, 33, 47, 48, 49, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 110,
)
LAST_PART = (78, 114)
VERSES_ON_A_PAGE = 15
DEFAULT_VERSES_PER_DAY = 7
SMALL_CHAPTER = 5
#: share of the corpus in which a search looks first
FIRST_SHARE = 1 / 64
SEARCH_LIMIT = 50
# ----------------------------------------------------------------------------


def verses_of(verses: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Verses whose ``column`` is among the asked keys."""
    return verses.join(keys.select(column), column, "left_semi")


def page_verses(verses: DataFrame, pages: DataFrame) -> DataFrame:
    return verses_of(verses, pages, "page")


def chapter_verses(verses: DataFrame, chapters: DataFrame) -> DataFrame:
    return verses_of(verses, chapters, "sura_no")


def part_verses(verses: DataFrame, parts: DataFrame) -> DataFrame:
    return verses_of(verses, parts, "jozz")


def _first_by_id(verses: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return verses.groupBy(*keys).agg(
        F.min_by(F.struct(*cols), "id").alias("v")
    ).select(*keys, *[F.col("v")[c].alias(c) for c in cols])


def verse_by_ref(refs: DataFrame, verses: DataFrame) -> DataFrame:
    """First verse of each asked (chapter, verse), nulls when there is none."""
    cols = ["id", "page", "jozz", "aya_text"]
    asked = verses.join(refs.select("sura_no", "aya_no"), ["sura_no", "aya_no"], "left_semi")
    return refs.join(_first_by_id(asked, ["sura_no", "aya_no"], cols), ["sura_no", "aya_no"], "left")


def verse_by_id(ids: DataFrame, verses: DataFrame) -> DataFrame:
    return ids.join(verses.select("id", "sura_no", "aya_no", "page", "aya_text"), "id", "left")


def page_of_ref(refs: DataFrame, verses: DataFrame) -> DataFrame:
    return verse_by_ref(refs, verses.withColumn("aya_text", F.lit(None).cast("string"))).select(
        *refs.columns, "page"
    )


def _verse_ids(refs: DataFrame, verses: DataFrame) -> DataFrame:
    first = verses.groupBy("sura_no", "aya_no").agg(F.min("id").alias("id"))
    return refs.join(first, ["sura_no", "aya_no"], "left")


def _step_verse(refs: DataFrame, verses: DataFrame, by: int) -> DataFrame:
    at = _verse_ids(refs, verses).withColumn("_to", F.col("id") + by).drop("id")
    other = verses.select(
        F.col("id").alias("_to"),
        F.col("sura_no").alias("to_sura_no"),
        F.col("aya_no").alias("to_aya_no"),
    )
    return at.join(other, "_to", "left").withColumn(
        "to_id", F.when(F.col("to_sura_no").isNotNull(), F.col("_to"))
    ).select(*refs.columns, "to_id", "to_sura_no", "to_aya_no")


def next_verse(refs: DataFrame, verses: DataFrame) -> DataFrame:
    """Verse after each reference, into the next chapter if need be."""
    return _step_verse(refs, verses, 1)


def prev_verse(refs: DataFrame, verses: DataFrame) -> DataFrame:
    return _step_verse(refs, verses, -1)


def verse_range(ranges: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses between two references; a missing or later end gives none.

    Ids are dense, so a range becomes its ids and an equi-join: as many rows as the
    answer has, and no range join.
    """
    ids = verses.groupBy("sura_no", "aya_no").agg(F.min("id").alias("_id"))

    def end(side):
        return ids.select(
            F.col("sura_no").alias(f"{side}_sura"), F.col("aya_no").alias(f"{side}_aya"),
            F.col("_id").alias(f"_{side}"),
        )

    spans = (
        ranges.join(end("from"), ["from_sura", "from_aya"])
        .join(end("to"), ["to_sura", "to_aya"])
        .filter("_from <= _to")
        .select("range_id", F.explode(F.sequence("_from", "_to")).alias("id"))
    )
    return spans.join(verses.select("id", "sura_no", "aya_no", "page"), "id")


def total_pages(verses: DataFrame) -> DataFrame:
    return verses.agg(F.max("page").alias("total_pages"))


def _chapters_on_page(verses: DataFrame) -> DataFrame:
    return verses.groupBy("page", "sura_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.min_by("aya_no", "id").alias("start_aya"), F.max_by("aya_no", "id").alias("end_aya"),
    )


def _verse_list() -> Column:
    return F.array_sort(F.collect_list(F.struct("id", "sura_no", "aya_no", "aya_text")))


def page_info(verses: DataFrame) -> DataFrame:
    """Per page: part of its first verse, its verses and chapters in order.

    A page is a few lines of print, so its verses fit a row.
    """
    first = verses.groupBy("page").agg(
        F.min_by("jozz", "id").alias("jozz"), F.count(F.lit(1)).alias("n_verses"), _verse_list().alias("verses")
    )
    chapters = _chapters_on_page(verses).groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("first_id", "sura_no")))["sura_no"].alias("chapters")
    )
    return first.join(chapters, "page")


def page_primary_chapter(verses: DataFrame) -> DataFrame:
    """Chapter with most verses on each page; the first to appear wins a tie."""
    return _chapters_on_page(verses).groupBy("page").agg(
        F.max_by(
            F.struct("sura_no", "start_aya", "end_aya"), F.struct("n", -F.col("first_id"))
        ).alias("c")
    ).select("page", F.col("c.sura_no").alias("sura_no"))


def page_chapter_span(verses: DataFrame) -> DataFrame:
    """First and last verse of the primary chapter of each page."""
    return _chapters_on_page(verses).groupBy("page").agg(
        F.max_by(
            F.struct("sura_no", "start_aya", "end_aya"), F.struct("n", -F.col("first_id"))
        ).alias("c")
    ).select("page", "c.*")


def chapter_pages(verses: DataFrame) -> DataFrame:
    """Distinct (chapter, page) rows."""
    return verses.select("sura_no", "page").distinct()


def chapters_pages(verses: DataFrame, chapters: DataFrame) -> DataFrame:
    """Distinct pages of several chapters together."""
    return chapter_verses(verses, chapters).select("page").distinct()


def revelation_type(sura_no: Column) -> Column:
    return F.when(sura_no.isin(*MEDINAN_CHAPTERS), "Medinan").otherwise("Meccan")


def chapter_catalogue(verses: DataFrame) -> DataFrame:
    """One row per chapter: names from its first verse, size, place of revelation."""
    return verses.groupBy("sura_no").agg(
        F.min_by(F.struct("sura_name_ar", "sura_name_en"), "id").alias("v"),
        F.count(F.lit(1)).alias("n_verses"),
    ).select(
        "sura_no",
        F.col("v.sura_name_ar").alias("name_ar"),
        F.col("v.sura_name_en").alias("name_en"),
        revelation_type(F.col("sura_no")).alias("revelation_type"),
        "n_verses",
    )


def chapter_info(verses: DataFrame, chapters: DataFrame) -> DataFrame:
    return chapter_catalogue(chapter_verses(verses, chapters))


def last_part_chapters(verses: DataFrame, bounds: tuple[int, int] = LAST_PART) -> DataFrame:
    return verses.filter(F.col("sura_no").between(*bounds)).select("sura_no").distinct()


def part_index(verses: DataFrame) -> DataFrame:
    """Where each part begins."""
    return _first_by_id(verses, ["jozz"], ["page", "sura_no", "sura_name_en", "aya_no"])


def _grams(chars: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of an array of characters."""
    if n == 1:
        return F.array_distinct(chars)
    last = F.size(chars) - n
    return F.when(
        last >= 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def _containing(queries: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Pairs whose ``text`` contains the non-empty ``needle``, by equi-join.

    A needle is sought by its last three characters (all of it when shorter); texts
    offer their distinct grams of that length, and the full test runs on the pairs. Few
    needles are broadcast, so grams are looked up where they are made.
    """
    size = F.length(F.col(needle))
    texts = texts.withColumn("_chars", F.filter(F.split(F.col(text), ""), lambda ch: ch != ""))
    out = None
    for n in (1, 2, 3):
        mine = queries.filter(size == n if n < 3 else size >= n).withColumn(
            "_gram", F.right(F.col(needle), F.lit(n))
        )
        grams = texts.withColumn("_gram", F.explode(_grams(F.col("_chars"), n))).drop("_chars")
        pairs = grams.join(broadcast_if_small(mine), "_gram").filter(F.col(text).contains(F.col(needle))).drop("_gram")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _containing_by_words(queries: DataFrame, needle: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """As ``_containing``, by the vocabulary of the texts.

    A needle's longest part between blanks lies within one word of every text that contains it.
    Grams are made of distinct words only; the words that contain the part lead to the texts
    that have them. A needle that is one such part is found with that; any other is sought in the
    texts. Needles without a part (tabs alone) go the other way.
    """
    parts = F.array_sort(F.filter(F.split(needle, r"\s+"), lambda w: w != ""), lambda a, b: F.length(b) - F.length(a))
    asked = queries.withColumn("_part", F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    asked = through_table(asked.withColumn("_n", F.least(F.length("_part"), F.lit(3))), "needles")
    sizes = [r[0] for r in asked.select("_n").distinct().collect()]  # four at most
    words = texts.select(F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("_word"), key).filter("_word <> ''")
    pieces = asked.filter("_n > 0").select("_part", "_n").distinct()
    vocabulary = words.select("_word").distinct().withColumn("_chars", F.filter(F.split("_word", ""), lambda ch: ch != ""))
    vocabulary = through_table(vocabulary, "vocabulary")
    out = None
    for n in sorted(set(sizes) - {0}):
        mine = pieces.filter(F.col("_n") == n).select("_part", F.right("_part", F.lit(n)).alias("_gram"))
        grams = vocabulary.select("_word", F.explode(_grams(F.col("_chars"), n)).alias("_gram"))
        pairs = grams.join(broadcast_if_small(mine), "_gram").filter(F.contains(F.col("_word"), F.col("_part"))).select("_word", "_part")
        out = pairs if out is None else out.unionByName(pairs)
    found = None
    if out is not None:
        near = through_table(words.join(broadcast_if_small(out), "_word").select(key, "_part").distinct(), "near")
        asking = broadcast_if_small(asked.filter("_n > 0").drop("_n"))
        fits = (F.col("_part") == F.col(needle)) | F.contains(F.col(text), F.col(needle))
        found = texts.join(near, key).join(asking, "_part").filter(fits).drop("_part")
    if 0 in sizes or found is None:
        rest = _containing(asked.filter("_n = 0").drop("_n", "_part"), needle, texts, text)
        found = rest if found is None else found.unionByName(rest)
    return found


def _first_hits(needles: DataFrame, verses: DataFrame, limit: int) -> DataFrame:
    """Verses that contain each needle, all up to its ``limit``-th in corpus order.

    The smallest ids are searched first, a share of ``FIRST_SHARE``: a needle that has its hits
    there needs no others, since all that follow stand later. Frequent needles thus end early
    and the rest of the corpus is asked for the rare ones only.
    """
    ends = verses.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    if ends.a is None:
        return _containing_by_words(needles, "_needle", verses, "id", "aya_text")
    cut = ends.a + int((ends.b - ends.a) * FIRST_SHARE)
    needles = through_table(needles, "asked")
    early = through_table(_containing_by_words(needles, "_needle", verses.filter(F.col("id") <= cut), "id", "aya_text"), "early")
    full = early.groupBy("query_id").count().filter(F.col("count") >= limit)
    late = _containing_by_words(needles.join(full, "query_id", "left_anti"), "_needle", verses.filter(F.col("id") > cut), "id", "aya_text")
    return early.unionByName(late)


def search_verses(queries: DataFrame, verses: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Hits of ``(query_id, query)``: a reference ``c:v`` or the verses containing it.

    The first ``limit`` hits in corpus order per query; blank queries have none.
    """
    asked = queries.filter(F.trim("query") != "").withColumn(
        "_ref", F.regexp_extract("query", r"^(\d+):(\d+)$", 0) != ""
    )
    refs = asked.filter("_ref").select(
        "query_id",
        F.split_part("query", F.lit(":"), F.lit(1)).try_cast("bigint").alias("sura_no"),
        F.split_part("query", F.lit(":"), F.lit(2)).try_cast("bigint").alias("aya_no"),
    )
    direct = (
        verses.select("sura_no", "aya_no", "id", "page").join(refs, ["sura_no", "aya_no"])
        .groupBy("query_id", "sura_no", "aya_no")
        .agg(F.min_by(F.struct("id", "page"), "id").alias("v"))
        .select("query_id", "v.id", "sura_no", "aya_no", "v.page")
    )
    needles = asked.filter("NOT _ref").select("query_id", F.trim("query").alias("_needle"))
    hits = _first_hits(needles, verses.select("id", "sura_no", "aya_no", "page", "aya_text"), limit)
    found = hits.select("query_id", "id", "sura_no", "aya_no", "page").unionByName(direct)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("id"))
    return found.withColumn("hit_no", place.cast("bigint")).filter(F.col("hit_no") <= limit)


def search_chapters(queries: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters whose name contains a query, or whose English name does in any case.

    A blank query filters nothing, so its answer is the catalogue itself.
    """
    asked = queries.filter(F.col("query") != "").withColumn("_low", F.lower("query"))
    names = chapters.select(
        "sura_no", "name_ar", F.lower("name_en").alias("_en")
    )
    exact = _containing(asked.select("query_id", "query"), "query", names, "name_ar")
    english = _containing(asked.select("query_id", "_low"), "_low", names, "_en")
    return exact.select("query_id", "sura_no").unionByName(
        english.select("query_id", "sura_no")
    ).distinct()


def group_verses_by_chapter(verses: DataFrame) -> DataFrame:
    """Per page and chapter: its verses in order, their span, and whether a header is due."""
    lists = verses.groupBy("page", "sura_no").agg(_verse_list().alias("verses"))
    return _chapters_on_page(verses).join(lists, ["page", "sura_no"]).select(
        "page", "sura_no", F.col("n").alias("n_verses"), "start_aya", "end_aya",
        (F.col("start_aya") == 1).alias("has_header"), "verses",
    )


def verses_per_day(goal: Column) -> Column:
    """Daily verses for a full, half or quarter page."""
    return (
        F.when(goal == "full-page", VERSES_ON_A_PAGE)
        .when(goal == "half-page", VERSES_ON_A_PAGE // 2)
        .when(goal == "quarter-page", VERSES_ON_A_PAGE // 4)
        .otherwise(DEFAULT_VERSES_PER_DAY)
        .cast("bigint")
    )


def group_chapters_by_goal(plan_chapters: DataFrame, chapters: DataFrame) -> DataFrame:
    """Pack a plan's chapters, in their order, into days of about ``cap`` verses.

    ``plan_chapters`` is ``(plan_id, seq, sura_no, cap)``. A chapter that would
    overflow the day opens the next one, unless it is small. Chapters that do not
    exist are left out. A day's end depends on the one before, hence the fold.
    """
    sized = plan_chapters.join(chapters.select("sura_no", "n_verses"), "sura_no")

    def start():
        return {"group": 1, "count": 0}

    def step(state, row):
        n = row["n_verses"]
        full = state["count"] > 0 and state["count"] + n > row["cap"]
        if full and n > SMALL_CHAPTER:
            state["group"] += 1
            state["count"] = 0
        state["count"] += n
        return [(row["seq"], row["sura_no"], state["group"])]

    return ordered_fold(
        sized, ["plan_id"], ["seq"], start, step, "seq bigint, sura_no bigint, group_no bigint"
    )
