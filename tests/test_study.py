"""Study rules on small hand-written facts."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import catalogue as cat
from lectern.operators import study

NOW = dt.datetime(2024, 6, 1)
OLD, NEW = dt.datetime(2024, 3, 1), dt.datetime(2024, 5, 20)


def chunks(spark, rows):
    return spark.createDataFrame(
        [(1, s, a, b, f"c{a}", pages, at) for s, a, b, pages, at in rows],
        "plan_id bigint, sura_no bigint, start_aya bigint, end_aya bigint, chunk_id string, pages array<bigint>, memorized_at timestamp",
    )


def consolidated(spark, rows):
    got = study.consolidate_chunks(chunks(spark, rows), NOW).orderBy("sura_no", "start_aya").collect()
    return [(r["sura_no"], r["chunk_id"], r["end_aya"], r["pages"]) for r in got]


def test_old_neighbours_join_up_to_five_pages(spark):
    rows = [(2, a, a + 9, [a // 10 + 1], OLD) for a in range(0, 70, 10)]
    assert consolidated(spark, rows) == [(2, "c0", 49, [1, 2, 3, 4, 5]), (2, "c50", 69, [6, 7])]


def test_size_is_tested_before_joining(spark):
    rows = [(2, 0, 9, [1, 2, 3, 4], OLD), (2, 10, 19, [5, 6, 7], OLD), (2, 20, 29, [8], OLD)]
    assert consolidated(spark, rows) == [(2, "c0", 19, [1, 2, 3, 4, 5, 6, 7]), (2, "c20", 29, [8])]


def test_recent_chunks_stand_alone(spark):
    rows = [(2, 0, 9, [1], OLD), (2, 10, 19, [2], NEW), (2, 20, 29, [3], OLD), (3, 1, 5, [4], OLD)]
    assert consolidated(spark, rows) == [(2, "c0", 9, [1]), (2, "c10", 19, [2]), (2, "c20", 29, [3]), (3, "c1", 5, [4])]


def plans(spark, direction="forward"):
    return spark.createDataFrame([(1, direction, 1, 6)], "plan_id bigint, direction string, start_page bigint, end_page bigint")


def progress(spark, pages):
    return spark.createDataFrame([(1, p, "memorized") for p in pages], "plan_id bigint, page bigint, status string")


CHAPTER_PAGES = [(1, 1), (2, 2), (2, 3), (3, 3), (3, 4), (4, 5), (5, 6)]


def next_chapter(spark, pages, direction):
    cp = spark.createDataFrame(CHAPTER_PAGES, "sura_no bigint, page bigint")
    return study.next_chapter(plans(spark, direction), progress(spark, pages), cp).first()["next_sura"]


def test_next_chapter(spark):
    assert next_chapter(spark, [], "forward") == 1
    assert next_chapter(spark, [], "backward") == 5
    assert next_chapter(spark, [1], "forward") == 2
    # a chapter is still due while one of its pages is not started
    assert next_chapter(spark, [1, 2], "forward") == 2
    assert next_chapter(spark, [1, 2, 3, 4, 5], "forward") == 5
    assert next_chapter(spark, [6, 5], "backward") == 3
    assert next_chapter(spark, [1, 2, 3, 4, 5, 6], "forward") is None


def test_next_page(spark):
    def page(pages, direction="forward"):
        return study.next_new_page(plans(spark, direction), progress(spark, pages)).first()["next_page"]

    assert page([]) == 1 and page([1, 2, 4]) == 3 and page([6, 5], "backward") == 4 and page(range(1, 7)) is None


def test_streak_needs_today(spark):
    days = [dt.datetime(2024, 5, d) for d in (1, 2, 3, 10, 11)]
    s = spark.createDataFrame([(1, d, True) for d in days + days[:2]], "plan_id bigint, date timestamp, completed boolean")
    assert tuple(study.streaks(s, dt.date(2024, 5, 11)).first())[1:] == (2, 3)
    assert tuple(study.streaks(s, dt.date(2024, 5, 12)).first())[1:] == (0, 3)


def test_page_ties_go_to_the_first_chapter(spark):
    rows = [(1, 1, 7, 5), (2, 1, 8, 1), (3, 1, 8, 2), (4, 1, 7, 6), (5, 2, 9, 1)]
    v = spark.createDataFrame([(i, p, s, a) for i, p, s, a in rows], "id bigint, page bigint, sura_no bigint, aya_no bigint")
    got = {r["page"]: (r["sura_no"], r["start_aya"], r["end_aya"]) for r in cat.page_chapter_span(v).collect()}
    assert got == {1: (7, 5, 6), 2: (9, 1, 1)}


def test_packing_takes_small_chapters_anyway(spark):
    asked = spark.createDataFrame([(1, i, i, 10) for i in range(1, 6)], "plan_id bigint, seq bigint, sura_no bigint, cap bigint")
    sizes = spark.createDataFrame([(1, 8), (2, 5), (3, 6), (5, 9)], "sura_no bigint, n_verses bigint")
    got = cat.group_chapters_by_goal(asked, sizes).orderBy("seq").select("sura_no", "group_no").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 1), (3, 2), (5, 3)]


def test_reset_and_delete(spark):
    log = [(1, 1, "create", "a", True), (1, 2, "update", "b", None), (1, 3, "reset", None, None), (1, 4, "pause", None, None), (2, 1, "create", "x", True), (2, 2, "delete", None, None), (2, 3, "update", "y", None)]
    df = spark.createDataFrame(log, "plan_id bigint, seq bigint, kind string, name string, active boolean").withColumns(
        {"owner": F.lit(1).cast("bigint"), "direction": F.lit("forward"), "current_page": F.lit(1).cast("bigint"), "completion": F.lit(50.0), "ts": F.timestamp_seconds("seq")}
    )
    got = study.plan_state(df).collect()
    assert [(r["plan_id"], r["name"], r["paused_at"] is not None, r["reset_seq"]) for r in got] == [(1, "b", True, 3)]
    facts = spark.createDataFrame([(1, 2), (1, 4), (2, 5)], "plan_id bigint, seq bigint")
    assert [tuple(r) for r in study.after_reset(facts, study.plan_state(df)).collect()] == [(1, 4)]
