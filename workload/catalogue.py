"""Corpus catalogue queries over ``documents`` as verses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalogue as cat
from lectern.plans.corpus_tables import corpus
from lectern.sources.bindings import fold_accents, table
from workload.base import VERSES, fold, with_


def _refs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ref_id"),
        F.col("user_id").alias("sura_no"),
        (F.col("event_id") % 12 + 1).alias("aya_no"),
    )


def _ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("range_id"),
        F.col("user_id").alias("from_sura"), (F.col("event_id") % 12 + 1).alias("from_aya"),
        (F.col("user_id") + F.col("event_id") % 2).alias("to_sura"),
        (F.col("event_id") % 7 + 1).alias("to_aya"),
    )


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("page")).distinct()


def _chapters(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sura_no")).distinct()


def _text_queries(spark, sf_dir):
    """Each benchmark passage as a padded phrase, a reference and a one-letter query."""
    words = F.split(fold_accents(F.col("text")), "\\s+")
    b = table(spark, sf_dir, "benchmark")
    phrase = F.concat(F.lit(" "), F.get(words, F.lit(2)), F.lit(" "), F.get(words, F.lit(3)), F.lit(" "))
    return (
        b.select((F.col("item_id") * 4).alias("query_id"), phrase.alias("query"))
        .unionByName(b.select((F.col("item_id") * 4 + 1).alias("query_id"), F.concat(F.col("item_id").cast("string"), F.lit(":2")).alias("query")))
        .unionByName(b.select((F.col("item_id") * 4 + 2).alias("query_id"), F.substring(F.get(words, F.lit(1)), 1, 2).alias("query")))
        .unionByName(b.select((F.col("item_id") * 4 + 3).alias("query_id"), F.lit("  ").alias("query")))
    )


def _chapter_queries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        "item_id",
        F.explode(F.array(F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")), F.concat(F.lit("S"), F.col("item_id").cast("string")))).alias("query"),
    ).select(F.concat_ws("/", F.col("item_id").cast("string"), "query").alias("query_id"), "query")


def _plan_chapters(spark, sf_dir):
    """Each user's visited chapters in numeric order, capped by a goal."""
    goal = F.element_at(F.array(*[F.lit(g) for g in ("full-page", "half-page", "quarter-page", "other")]), (F.col("user_id") % 4 + 1).cast("int"))
    picked = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("plan_id"), F.col("event_id").alias("sura_no"), cat.verses_per_day(goal).alias("cap")
    ).distinct()
    return picked.withColumn("seq", F.col("sura_no"))


def q(fn, *args):
    return lambda spark, sf_dir: fn(*[a(spark, sf_dir) for a in args])


def _listed(df):
    """Verse lists as text: ids, and texts one after the other."""
    ids = F.array_join(F.transform("verses", lambda v: v["id"].cast("string")), ",").alias("verse_ids")
    texts = F.md5(F.array_join(F.transform("verses", lambda v: v["aya_text"]), "|")).alias("verse_texts")
    return df.select("*", ids, texts).drop("verses")


def page_info(spark, sf_dir):
    info = _listed(cat.page_info(corpus(spark, sf_dir)))
    return info.select("page", "jozz", "n_verses", "verse_ids", "verse_texts", F.array_join(F.col("chapters").cast("array<string>"), ",").alias("chapters"))


QUERIES = {
    "page_verses": q(lambda v, k: cat.page_verses(v, k).select("id", "page", "aya_text"), corpus, _pages),
    "chapter_verses": q(lambda v, k: cat.chapter_verses(v, k).select("id", "sura_no", "aya_text"), corpus, _chapters),
    "part_verses": q(
        lambda v, e: cat.part_verses(v, e.select((F.col("event_id") + 1).alias("jozz")).distinct()).select("id", "jozz", "aya_no"),
        corpus, lambda s, d: table(s, d, "events"),
    ),
    "verse_by_ref": q(lambda v, r: cat.verse_by_ref(r, v).select("ref_id", "id", "page", "jozz", "aya_text"), corpus, _refs),
    "verse_by_id": q(
        lambda v, e: cat.verse_by_id(e.select(F.col("event_id").alias("id")), v), corpus, lambda s, d: table(s, d, "events")
    ),
    "page_of_ref": q(lambda v, r: cat.page_of_ref(r, v).select("ref_id", "page"), corpus, _refs),
    "next_verse": q(lambda v, r: cat.next_verse(r, v).select("ref_id", "to_id", "to_sura_no", "to_aya_no"), corpus, _refs),
    "prev_verse": q(lambda v, r: cat.prev_verse(r, v).select("ref_id", "to_id", "to_sura_no", "to_aya_no"), corpus, _refs),
    "verse_range": q(lambda v, r: cat.verse_range(r, v), corpus, _ranges),
    "total_pages": q(cat.total_pages, corpus),
    "page_info": page_info,
    "page_primary_chapter": q(cat.page_primary_chapter, corpus),
    "page_chapter_span": q(cat.page_chapter_span, corpus),
    "chapter_pages": q(cat.chapter_pages, corpus),
    "chapters_pages": q(cat.chapters_pages, corpus, _chapters),
    "chapter_catalogue": q(cat.chapter_catalogue, corpus),
    "chapter_info": q(cat.chapter_info, corpus, _chapters),
    "last_part_chapters": q(cat.last_part_chapters, corpus),
    "part_index": q(cat.part_index, corpus),
    "search_verses": q(lambda v, a: cat.search_verses(a, v), corpus, _text_queries),
    "search_chapters": q(lambda v, a: cat.search_chapters(a, cat.chapter_catalogue(v)), corpus, _chapter_queries),
    "group_verses_by_chapter": q(lambda v: _listed(cat.group_verses_by_chapter(v)), corpus),
    "group_chapters_by_goal": q(lambda v, p: cat.group_chapters_by_goal(p, cat.chapter_catalogue(v)), corpus, _plan_chapters),
}

REFS = f"{VERSES}, refs AS (SELECT event_id AS ref_id, user_id AS sura_no, event_id % 12 + 1 AS aya_no FROM events)"
ON_PAGE = f"{VERSES}, on_page AS (SELECT page, sura_no, count(*) AS n, min(id) AS first_id, arg_min(aya_no, id) AS start_aya, arg_max(aya_no, id) AS end_aya FROM verses GROUP BY page, sura_no)"
LISTED = "string_agg(id, ',' ORDER BY id) AS verse_ids, md5(string_agg(aya_text, '|' ORDER BY id)) AS verse_texts"
PRIMARY = f"{ON_PAGE}, prim AS (SELECT * FROM on_page QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first_id) = 1)"
MEDINAN = ", ".join(str(c) for c in cat.MEDINAN_CHAPTERS)
CATALOGUE = f"{VERSES}, chapters AS (SELECT sura_no, arg_min(sura_name_ar, id) AS name_ar, arg_min(sura_name_en, id) AS name_en, CASE WHEN sura_no IN ({MEDINAN}) THEN 'Medinan' ELSE 'Meccan' END AS revelation_type, count(*) AS n_verses FROM verses GROUP BY sura_no)"
BW = f"bw AS (SELECT item_id, string_split_regex({fold('text')}, '\\s+') AS w FROM benchmark)"


def _step(by):
    return with_(REFS, f"SELECT ref_id, n.id AS to_id, n.sura_no AS to_sura_no, n.aya_no AS to_aya_no FROM refs LEFT JOIN verses v USING (sura_no, aya_no) LEFT JOIN verses n ON n.id = v.id + ({by})")


ORACLES = {
    "page_verses": with_(VERSES, "SELECT id, page, aya_text FROM verses WHERE page IN (SELECT event_id + 1 FROM events)"),
    "chapter_verses": with_(VERSES, "SELECT id, sura_no, aya_text FROM verses WHERE sura_no IN (SELECT doc_id FROM labels)"),
    "part_verses": with_(VERSES, "SELECT id, jozz, aya_no FROM verses WHERE jozz IN (SELECT event_id + 1 FROM events)"),
    "verse_by_ref": with_(REFS, "SELECT ref_id, id, page, jozz, aya_text FROM refs LEFT JOIN verses USING (sura_no, aya_no)"),
    "verse_by_id": with_(VERSES, "SELECT event_id AS id, sura_no, aya_no, page, aya_text FROM events LEFT JOIN verses ON id = event_id"),
    "page_of_ref": with_(REFS, "SELECT ref_id, page FROM refs LEFT JOIN verses USING (sura_no, aya_no)"),
    "next_verse": _step(1),
    "prev_verse": _step(-1),
    "verse_range": with_(
        VERSES,
        "SELECT event_id AS range_id, v.id, v.sura_no, v.aya_no, v.page FROM events e JOIN verses a ON a.sura_no = e.user_id AND a.aya_no = e.event_id % 12 + 1 "
        "JOIN verses b ON b.sura_no = e.user_id + e.event_id % 2 AND b.aya_no = e.event_id % 7 + 1 JOIN verses v ON v.id BETWEEN a.id AND b.id",
    ),
    "total_pages": with_(VERSES, "SELECT max(page) AS total_pages FROM verses"),
    "page_info": with_(
        ON_PAGE,
        f"SELECT page, jozz, n_verses, chapters, verse_ids, verse_texts FROM (SELECT page, arg_min(jozz, id) AS jozz, count(*) AS n_verses, {LISTED} FROM verses GROUP BY page) "
        "JOIN (SELECT page, string_agg(sura_no, ',' ORDER BY first_id) AS chapters FROM on_page GROUP BY page) USING (page)",
    ),
    "page_primary_chapter": with_(PRIMARY, "SELECT page, sura_no FROM prim"),
    "page_chapter_span": with_(PRIMARY, "SELECT page, sura_no, start_aya, end_aya FROM prim"),
    "chapter_pages": with_(VERSES, "SELECT DISTINCT sura_no, page FROM verses"),
    "chapters_pages": with_(VERSES, "SELECT DISTINCT page FROM verses WHERE sura_no IN (SELECT doc_id FROM labels)"),
    "chapter_catalogue": with_(CATALOGUE, "SELECT * FROM chapters"),
    "chapter_info": with_(CATALOGUE, "SELECT * FROM chapters WHERE sura_no IN (SELECT doc_id FROM labels)"),
    "last_part_chapters": with_(VERSES, "SELECT DISTINCT sura_no FROM verses WHERE sura_no BETWEEN 78 AND 114"),
    "part_index": with_(VERSES, "SELECT jozz, page, sura_no, sura_name_en, aya_no FROM verses QUALIFY row_number() OVER (PARTITION BY jozz ORDER BY id) = 1"),
    "search_verses": with_(
        f"""{VERSES}, {BW},
asked AS (SELECT item_id * 4 AS query_id, ' ' || w[3] || ' ' || w[4] || ' ' AS query FROM bw UNION ALL SELECT item_id * 4 + 1, item_id || ':2' FROM bw
  UNION ALL SELECT item_id * 4 + 2, substr(w[2], 1, 2) FROM bw UNION ALL SELECT item_id * 4 + 3, '  ' FROM bw),
found AS (SELECT query_id, id, sura_no, aya_no, page FROM asked JOIN verses ON contains(aya_text, trim(query)) WHERE trim(query) <> '' AND NOT regexp_matches(query, '^\\d+:\\d+$')
  UNION ALL SELECT query_id, id, sura_no, aya_no, page FROM asked JOIN verses ON sura_no || ':' || aya_no = query)""",
        "SELECT query_id, id, sura_no, aya_no, page, row_number() OVER (PARTITION BY query_id ORDER BY id) AS hit_no FROM found QUALIFY hit_no <= 50",
    ),
    "search_chapters": with_(
        f"{CATALOGUE}, asked AS (SELECT item_id, unnest(['SRC' || (item_id % 20), 'S' || item_id]) AS query FROM benchmark)",
        "SELECT DISTINCT item_id || '/' || query AS query_id, sura_no FROM asked JOIN chapters ON contains(name_ar, query) OR contains(lower(name_en), lower(query))",
    ),
    "group_verses_by_chapter": with_(
        ON_PAGE,
        f"SELECT page, sura_no, n AS n_verses, start_aya, end_aya, start_aya = 1 AS has_header, verse_ids, verse_texts FROM on_page "
        f"JOIN (SELECT page, sura_no, {LISTED} FROM verses GROUP BY page, sura_no) USING (page, sura_no)",
    ),
    "group_chapters_by_goal": with_(
        f"""{CATALOGUE},
picked AS (SELECT DISTINCT user_id AS plan_id, event_id AS sura_no, CASE user_id % 4 WHEN 0 THEN 15 WHEN 2 THEN 3 ELSE 7 END AS cap FROM events),
sized AS (SELECT plan_id, p.sura_no, cap, n_verses, row_number() OVER (PARTITION BY plan_id ORDER BY p.sura_no) AS k FROM picked p JOIN chapters USING (sura_no)),
pack(plan_id, k, sura_no, group_no, total) AS (
  SELECT plan_id, k, sura_no, CAST(1 AS BIGINT), n_verses FROM sized WHERE k = 1
  UNION ALL
  SELECT s.plan_id, s.k, s.sura_no, p.group_no + CASE WHEN p.total + s.n_verses > s.cap AND s.n_verses > 5 THEN 1 ELSE 0 END,
    CASE WHEN p.total + s.n_verses > s.cap AND s.n_verses > 5 THEN s.n_verses ELSE p.total + s.n_verses END
  FROM pack p JOIN sized s ON s.plan_id = p.plan_id AND s.k = p.k + 1)""",
        "SELECT plan_id, sura_no AS seq, sura_no, group_no FROM pack", True,
    ),
}
