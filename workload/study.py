"""Study analytics over ``events`` as plans, progress, sessions and logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import catalogue as cat
from lectern.operators import study
from lectern.plans.corpus_tables import _once, corpus
from lectern.sources.bindings import recording_events, table
from workload.base import VERSES, with_
from workload.catalogue import PRIMARY
from workload.timing import REC

AS_OF = dt.datetime(2024, 2, 10)
DAY = dt.date(2024, 1, 20)
SHORT = (1, 2, 1)


def _ev(spark, sf_dir):
    return _once(
        spark, sf_dir, "study_events",
        lambda: recording_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "plan_id"),
    )


def _et(*kinds):
    return F.col("event_type").isin(*kinds)


def plan_log(spark, sf_dir):
    e = _ev(spark, sf_dir)
    kind = (
        F.when(F.col("seq") == 1, "create").when(F.col("event_id") % 211 == 0, "delete").when(F.col("event_id") % 59 == 0, "reset")
        .when(_et("click"), "pause").when(_et("view"), "resume").otherwise("update")
    )
    first = F.col("seq") == 1
    changes = kind.isin("create", "update")
    return e.select(
        "plan_id", "seq", "ts", kind.alias("kind"),
        F.when(first, F.col("plan_id") % 10).alias("owner"),
        F.when(changes & (first | (F.col("event_id") % 5 == 1)), F.concat(F.lit("plan "), F.col("event_id").cast("string"))).alias("name"),
        F.when(first, F.when(F.col("plan_id") % 2 == 0, "forward").otherwise("backward")).alias("direction"),
        F.when(changes & (first | (F.col("event_id") % 4 == 2)), F.col("event_id") % 3 != 0).alias("active"),
        F.when(changes, F.col("event_id") % 604 + 1).alias("current_page"),
        F.when(changes & (F.col("event_id") % 3 == 0), F.floor(F.col("value")).cast("double")).alias("completion"),
    )


def plans(spark, sf_dir):
    p = F.col("plan_id")
    return _ev(spark, sf_dir).select("plan_id").distinct().select(
        "plan_id", F.when(p % 2 == 0, "forward").otherwise("backward").alias("direction"),
        (p % 3 + 1).alias("start_page"), (60 - p % 7).alias("end_page"), (p % 5).alias("current_index"),
    )


def progress(spark, sf_dir):
    """One row per (user, page): the last event on it decides its state."""
    e = _ev(spark, sf_dir).withColumn("page", F.col("event_id") % 60 + 1)
    status = F.when(_et("purchase", "signup"), "memorized").when(_et("click", "view"), "in-ritual").otherwise("new")
    return e.groupBy("plan_id", "page").agg(
        F.max_by(status, "seq").alias("status"),
        F.least(F.count_if(_et("view")), F.lit(2)).alias("listen_count"),
        F.least(F.count_if(_et("click")), F.lit(15)).alias("read_count"),
        F.least(F.count_if(_et("purchase")), F.lit(3)).alias("recite_count"),
        F.max_by(_et("signup"), "seq").alias("surah_link_done"),
        F.count(F.lit(1)).alias("times_reviewed"),
        F.max("ts").alias("memorized_at"),
    )


def ritual_events(spark, sf_dir):
    kind = F.when(_et("view"), "listen").when(_et("click"), "read").when(_et("signup"), "surah-link").otherwise("recite")
    return _ev(spark, sf_dir).select("plan_id", (F.col("event_id") % 2 + 1).alias("page"), "seq", kind.alias("kind"), _et("purchase").alias("error_free"))


def sessions(spark, sf_dir):
    return _ev(spark, sf_dir).select(F.col("event_id").alias("session_id"), "plan_id", F.col("ts").alias("date"), F.floor(F.col("value")).cast("double").alias("duration"), (~_et("error")).alias("completed"))


def spans(spark, sf_dir):
    return cat.page_chapter_span(corpus(spark, sf_dir))


def chunks(spark, sf_dir):
    return study.build_review_chunks(progress(spark, sf_dir), spans(spark, sf_dir))


def consolidated(spark, sf_dir):
    return _once(spark, sf_dir, "chunks", lambda: study.consolidate_chunks(chunks(spark, sf_dir), AS_OF))


def completions(spark, sf_dir):
    """Purchases complete the review of a page's chunk, known or not."""
    e = _ev(spark, sf_dir).filter(_et("purchase"))
    name = F.concat_ws("-", F.lit("chunk"), F.col("plan_id").cast("string"), (F.col("event_id") % 60 + 1).cast("string"))
    return e.select("plan_id", name.alias("chunk_id"), "ts")


def pages_of(spark, sf_dir):
    return cat.chapter_pages(corpus(spark, sf_dir))


def _text_pages(df):
    return df.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


def plan_state(spark, sf_dir):
    p = study.plan_state(plan_log(spark, sf_dir))
    return p.withColumn("paused", F.col("paused_at").isNotNull()).drop("paused_at")


def after_reset(spark, sf_dir):
    facts = _ev(spark, sf_dir).select("plan_id", "seq", "event_id")
    return study.after_reset(facts, study.plan_state(plan_log(spark, sf_dir)))


def active_plan(spark, sf_dir):
    return study.active_plan(study.plan_state(plan_log(spark, sf_dir)))


def plan_by_id(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value")).alias("plan_id"))
    return study.plan_by_id(asked, study.plan_state(plan_log(spark, sf_dir))).select("event_id", "plan_id", "name", "current_page")


def progress_of(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.floor(F.col("value")).alias("plan_id"), (F.col("event_id") % 9 + 1).alias("page"))
    return study.progress_of(asked, progress(spark, sf_dir)).select("plan_id", "page", "status")


def ritual_phase(spark, sf_dir):
    r = study.ritual_progress(ritual_events(spark, sf_dir), SHORT)
    return r.select("plan_id", "page", study.ritual_phase(SHORT).alias("phase"))


def mark_memorized(spark, sf_dir):
    chapters = table(spark, sf_dir, "events").filter(_et("signup")).select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 23).alias("sura_no")).distinct()
    pages = table(spark, sf_dir, "events").filter(_et("view")).select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 17 + 50).alias("page"))
    marked = study.pages_to_mark(chapters, pages, pages_of(spark, sf_dir))
    return study.mark_memorized(progress(spark, sf_dir), marked)


def todays_review(spark, sf_dir):
    return study.todays_review(plans(spark, sf_dir), consolidated(spark, sf_dir), progress(spark, sf_dir))


def complete_review(spark, sf_dir):
    r = study.complete_reviews(plans(spark, sf_dir), chunks(spark, sf_dir), completions(spark, sf_dir))
    return r.select("plan_id", "current_index", F.to_date("last_review").alias("last_day"))


def reviewed_pages(spark, sf_dir):
    return study.reviewed_pages(progress(spark, sf_dir), chunks(spark, sf_dir), completions(spark, sf_dir)).select("plan_id", "page", "times_reviewed")


def study_statistics(spark, sf_dir):
    return study.study_statistics(plans(spark, sf_dir), progress(spark, sf_dir), consolidated(spark, sf_dir), sessions(spark, sf_dir), DAY)


def projected_completion(spark, sf_dir):
    p = progress(spark, sf_dir).groupBy("plan_id").agg(F.count_if(F.col("status") == "memorized").alias("m"))
    return p.select("plan_id", study.projected_completion(F.col("m"), DAY).alias("projected"))


def next_new_page(spark, sf_dir):
    return study.next_new_page(plans(spark, sf_dir), progress(spark, sf_dir))


def next_chapter(spark, sf_dir):
    return study.next_chapter(plans(spark, sf_dir), progress(spark, sf_dir), pages_of(spark, sf_dir))


def chapter_for_page(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ask_id"), F.floor(F.col("value")).alias("plan_id"), (F.col("event_id") % 700 + 1).alias("page"), (F.col("event_id") % 2 == 0).alias("is_new")
    )
    return study.chapter_for_page(asked, next_chapter(spark, sf_dir), cat.page_primary_chapter(corpus(spark, sf_dir)))


def chapter_progress(spark, sf_dir):
    return study.chapter_progress(next_chapter(spark, sf_dir), progress(spark, sf_dir), pages_of(spark, sf_dir))


def completion_percentage(spark, sf_dir):
    return study.completion_percentage(progress(spark, sf_dir), sessions(spark, sf_dir))


def today_session(spark, sf_dir):
    return study.today_session(sessions(spark, sf_dir), DAY)


def session_upsert(spark, sf_dir):
    return study.session_upsert(plans(spark, sf_dir), today_session(spark, sf_dir), todays_review(spark, sf_dir), next_new_page(spark, sf_dir))


def today_summary(spark, sf_dir):
    return _text_pages(study.today_summary(plans(spark, sf_dir), today_session(spark, sf_dir), todays_review(spark, sf_dir), next_new_page(spark, sf_dir)))


def bookmark_log(spark, sf_dir):
    kind = F.when(_et("signup"), "remove").when(_et("click", "error"), "update").otherwise("add")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 2500).alias("bookmark_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("owner"),
        (F.col("event_id") % 604 + 1).alias("page"), 
        F.when(_et("click"), F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"),
    )


def bookmark_of_page(spark, sf_dir):
    asked = corpus(spark, sf_dir).select("page").distinct()
    return study.bookmark_of_page(asked, study.bookmarks_state(bookmark_log(spark, sf_dir)))


def recordings_with_audio(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rec = e.select(F.col("event_id").alias("recording_id"), F.col("user_id").alias("sura_no"), (F.col("event_id") % 12 + 1).alias("aya_no"))
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.length("text").cast("bigint").alias("n_bytes"))
    return study.recordings_with_audio(rec, blobs)


def session_log_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select((F.col("event_id") % 3000).alias("session_id"), F.col("event_id").alias("seq"), F.when(_et("error"), "delete").otherwise("save").alias("kind"), F.col("user_id").alias("plan_id"))
    return study.session_log_upsert(log)


def session_phase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(
        F.col("event_id").alias("session_id"), F.col("user_id").alias("plan_id"),
        F.when(F.col("event_id") % 4 == 0, F.lit("c")).alias("review_chunk"), (F.col("event_id") % 8 == 0).alias("review_done"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3).alias("new_page"), (F.col("event_id") % 5 == 0).alias("new_done"),
        F.floor(F.col("value") * 10000).alias("elapsed_ms"),
    )
    return study.session_phase(s, study.ritual_progress(ritual_events(spark, sf_dir), SHORT), SHORT)


QUERIES = {
    "plan_state": plan_state,
    "after_reset": after_reset,
    "active_plan": active_plan,
    "plan_by_id": plan_by_id,
    "progress_of": progress_of,
    "ritual_progress": lambda s, d: study.ritual_progress(ritual_events(s, d)),
    "ritual_progress_short": lambda s, d: study.ritual_progress(ritual_events(s, d), SHORT),
    "ritual_phase": ritual_phase,
    "mark_memorized": mark_memorized,
    "build_review_chunks": lambda s, d: _text_pages(chunks(s, d)).drop("memorized_at"),
    "consolidate_chunks": lambda s, d: _text_pages(consolidated(s, d)).drop("memorized_at"),
    "todays_review": lambda s, d: _text_pages(todays_review(s, d)).drop("memorized_at"),
    "complete_review": complete_review,
    "reviewed_pages": reviewed_pages,
    "study_statistics": study_statistics,
    "streaks": lambda s, d: study.streaks(sessions(s, d), DAY),
    "projected_completion": projected_completion,
    "next_new_page": next_new_page,
    "next_chapter": next_chapter,
    "chapter_for_page": chapter_for_page,
    "chapter_progress": chapter_progress,
    "completion_percentage": completion_percentage,
    "today_session": today_session,
    "session_upsert": session_upsert,
    "today_summary": today_summary,
    "bookmarks_state": lambda s, d: study.bookmarks_state(bookmark_log(s, d)),
    "bookmark_of_page": bookmark_of_page,
    "recordings_with_audio": recordings_with_audio,
    "session_log_upsert": session_log_upsert,
    "session_phase": session_phase,
}

# ---------------------------------------------------------------- check SQL
EV = f"{REC}, ev AS (SELECT event_id, ts, user_id AS plan_id, event_type, value, seq FROM rec)"
LOG = f"""{EV},
log0 AS (SELECT *, CASE WHEN seq = 1 THEN 'create' WHEN event_id % 211 = 0 THEN 'delete' WHEN event_id % 59 = 0 THEN 'reset' WHEN event_type = 'click' THEN 'pause'
  WHEN event_type = 'view' THEN 'resume' ELSE 'update' END AS kind FROM ev),
log1 AS (SELECT *, kind IN ('create', 'update') AS chg FROM log0),
log AS (SELECT plan_id, seq, kind, CASE WHEN seq = 1 THEN plan_id % 10 END AS owner,
  CASE WHEN chg AND (seq = 1 OR event_id % 5 = 1) THEN 'plan ' || event_id END AS name,
  CASE WHEN seq = 1 THEN CASE WHEN plan_id % 2 = 0 THEN 'forward' ELSE 'backward' END END AS direction,
  CASE WHEN chg AND (seq = 1 OR event_id % 4 = 2) THEN event_id % 3 <> 0 END AS active,
  CASE WHEN chg THEN event_id % 604 + 1 END AS current_page,
  CASE WHEN kind = 'reset' THEN 0.0 WHEN chg AND event_id % 3 = 0 THEN floor(value) END::DOUBLE AS completion FROM log1),
live AS (SELECT l.* FROM log l WHERE seq > coalesce((SELECT max(seq) FROM log d WHERE d.plan_id = l.plan_id AND d.kind = 'delete'), -1)),
born AS (SELECT plan_id, min(seq) AS created_seq FROM live WHERE kind = 'create' GROUP BY plan_id),
state AS (SELECT plan_id, arg_max(owner, seq) FILTER (owner IS NOT NULL) AS owner, arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
  arg_max(direction, seq) FILTER (direction IS NOT NULL) AS direction, arg_max(active, seq) FILTER (active IS NOT NULL) AS active,
  arg_max(current_page, seq) FILTER (current_page IS NOT NULL) AS current_page, coalesce(arg_max(completion, seq) FILTER (completion IS NOT NULL), 0.0) AS completion,
  coalesce(arg_max(kind, seq) FILTER (kind IN ('pause', 'resume')) = 'pause', FALSE) AS paused, max(seq) FILTER (kind = 'reset') AS reset_seq, min(created_seq) AS created_seq
  FROM live JOIN born USING (plan_id) WHERE seq >= created_seq GROUP BY plan_id)"""
PROGRESS = f"""{EV},
progress AS (SELECT plan_id, event_id % 60 + 1 AS page,
  arg_max(CASE WHEN event_type IN ('purchase', 'signup') THEN 'memorized' WHEN event_type IN ('click', 'view') THEN 'in-ritual' ELSE 'new' END, seq) AS status,
  least(count(*) FILTER (event_type = 'view'), 2) AS listen_count, least(count(*) FILTER (event_type = 'click'), 15) AS read_count,
  least(count(*) FILTER (event_type = 'purchase'), 3) AS recite_count, arg_max(event_type = 'signup', seq) AS surah_link_done,
  count(*) AS times_reviewed, max(ts) AS memorized_at FROM ev GROUP BY ALL),
plans AS (SELECT DISTINCT plan_id, CASE WHEN plan_id % 2 = 0 THEN 'forward' ELSE 'backward' END AS direction, plan_id % 3 + 1 AS start_page, 60 - plan_id % 7 AS end_page, plan_id % 5 AS current_index FROM ev),
sessions AS (SELECT event_id AS session_id, plan_id, ts AS date, floor(value) AS duration, event_type <> 'error' AS completed FROM ev)"""
RITUAL_EVENTS = f"""{EV},
rit AS (SELECT plan_id, event_id % 2 + 1 AS page, seq, CASE event_type WHEN 'view' THEN 'listen' WHEN 'click' THEN 'read' WHEN 'signup' THEN 'surah-link' ELSE 'recite' END AS kind,
  event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY plan_id, event_id % 2 ORDER BY seq) AS k FROM ev)"""


def ritual(l, r, c):
    return f"""{RITUAL_EVENTS},
walk(plan_id, page, k, listen, reads, recite, link) AS (
  SELECT DISTINCT plan_id, page, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, FALSE FROM rit
  UNION ALL
  SELECT w.plan_id, w.page, w.k + 1,
    CASE WHEN e.kind = 'listen' THEN least(listen + 1, {l}) ELSE listen END,
    CASE WHEN e.kind = 'read' AND listen >= {l} THEN least(reads + 1, {r}) ELSE reads END,
    CASE WHEN e.kind = 'recite' AND ok AND reads >= {r} THEN least(recite + 1, {c}) ELSE recite END,
    link OR (e.kind = 'surah-link' AND recite >= {c})
  FROM walk w JOIN rit e ON e.plan_id = w.plan_id AND e.page = w.page AND e.k = w.k + 1),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY plan_id, page ORDER BY k DESC) = 1),
ritual AS (SELECT plan_id, page, listen AS listen_count, reads AS read_count, recite AS recite_count, link AS surah_link_done,
  CASE WHEN link THEN 'memorized' ELSE 'in-ritual' END AS status,
  CASE WHEN listen < {l} THEN 'listen' WHEN reads < {r} THEN 'read' WHEN recite < {c} THEN 'recite' WHEN NOT link THEN 'surah-link' ELSE 'complete' END AS phase FROM final)"""


RITUAL_COLUMNS = "plan_id, page, listen_count, read_count, recite_count, surah_link_done, status"
CHUNKS = f"""{PRIMARY}, {PROGRESS},
chunks AS (SELECT plan_id, 'chunk-' || plan_id || '-' || page AS chunk_id, sura_no, start_aya, end_aya, page, memorized_at FROM progress JOIN prim USING (page) WHERE status = 'memorized')"""
MERGED = f"""{CHUNKS},
queue AS (SELECT *, row_number() OVER (PARTITION BY plan_id, sura_no ORDER BY start_aya, memorized_at, chunk_id) AS k,
  memorized_at > TIMESTAMP '2024-01-11 00:00:00' AS recent FROM chunks),
fold(plan_id, sura_no, k, g, n, recent) AS (
  SELECT plan_id, sura_no, k, k, 1, recent FROM queue WHERE k = 1
  UNION ALL
  SELECT q.plan_id, q.sura_no, q.k, CASE WHEN f.recent OR q.recent OR f.n >= 5 THEN q.k ELSE f.g END,
    CASE WHEN f.recent OR q.recent OR f.n >= 5 THEN 1 ELSE f.n + 1 END, q.recent
  FROM fold f JOIN queue q ON q.plan_id = f.plan_id AND q.sura_no = f.sura_no AND q.k = f.k + 1),
merged AS (SELECT plan_id, sura_no, arg_min(chunk_id, k) AS chunk_id, arg_min(start_aya, k) AS start_aya, arg_max(end_aya, k) AS end_aya, string_agg(page, ',' ORDER BY page) AS pages
  FROM fold JOIN queue USING (plan_id, sura_no, k) GROUP BY plan_id, sura_no, g),
ready AS (SELECT plan_id FROM progress WHERE status = 'memorized' GROUP BY plan_id HAVING count(*) >= 3),
review AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY sura_no, start_aya, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n FROM merged) m
  JOIN plans p ON p.plan_id = m.plan_id AND p.current_index % n = i WHERE m.plan_id IN (SELECT plan_id FROM ready))"""
NEXT_PAGE = """next_page AS (SELECT plan_id, CASE WHEN direction = 'forward' THEN min(pg) ELSE max(pg) END AS next_page FROM (
  SELECT p.*, c.pg FROM plans p LEFT JOIN (SELECT q.plan_id, unnest(range(q.start_page, q.end_page + 1)) AS pg FROM plans q) c
    ON c.plan_id = p.plan_id AND NOT EXISTS (SELECT 1 FROM progress r WHERE r.plan_id = p.plan_id AND r.page = c.pg)) GROUP BY plan_id, direction)"""
NEXT_CHAPTER = f"""{VERSES}, {PROGRESS},
cp AS (SELECT DISTINCT sura_no, page FROM verses),
missing AS (SELECT DISTINCT p.plan_id, direction, sura_no FROM plans p CROSS JOIN cp WHERE NOT EXISTS (SELECT 1 FROM progress r WHERE r.plan_id = p.plan_id AND r.page = cp.page)),
next_ch AS (SELECT p.plan_id, CASE WHEN p.direction = 'forward' THEN min(sura_no) ELSE max(sura_no) END AS next_sura FROM plans p LEFT JOIN missing m ON m.plan_id = p.plan_id GROUP BY p.plan_id, p.direction)"""
STREAKS = """days AS (SELECT DISTINCT plan_id, date::DATE AS d FROM sessions WHERE completed),
isl AS (SELECT plan_id, count(*) AS n, max(d) AS last FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY plan_id ORDER BY d) AS INTEGER) AS g FROM days) GROUP BY plan_id, g),
upto AS (SELECT plan_id, count(*) AS n FROM (SELECT *, DATE '2024-01-20' - d AS back, row_number() OVER (PARTITION BY plan_id ORDER BY d DESC) - 1 AS i FROM days WHERE d <= DATE '2024-01-20') WHERE back = i GROUP BY plan_id),
newest AS (SELECT plan_id, max(d) AS last FROM days GROUP BY plan_id),
streaks AS (SELECT plan_id, coalesce(any_value(CASE WHEN newest.last = DATE '2024-01-20' THEN u.n END), 0) AS current_streak, max(isl.n) AS longest_streak FROM isl JOIN newest USING (plan_id) LEFT JOIN upto u USING (plan_id) GROUP BY plan_id)"""
TODAY = "today AS (SELECT plan_id, arg_min(session_id, {'a': date, 'b': session_id}) AS session_id, arg_min(completed, {'a': date, 'b': session_id}) AS completed FROM sessions WHERE date::DATE = DATE '2024-01-20' GROUP BY plan_id)"
BOOK = """blog AS (SELECT event_id % 2500 AS bookmark_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'remove' WHEN event_type IN ('click', 'error') THEN 'update' ELSE 'add' END AS kind,
  user_id AS owner, event_id % 604 + 1 AS page, CASE WHEN event_type = 'click' THEN 'note ' || event_id END AS note FROM events),
blive AS (SELECT * FROM blog b WHERE seq > coalesce((SELECT max(seq) FROM blog d WHERE d.bookmark_id = b.bookmark_id AND d.kind = 'remove'), -1)),
books AS (SELECT bookmark_id, arg_max(owner, seq) AS owner, arg_max(page, seq) AS page, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, min(created_seq) AS created_seq
  FROM blive JOIN (SELECT bookmark_id, min(seq) AS created_seq FROM blive WHERE kind = 'add' GROUP BY 1) USING (bookmark_id) WHERE seq >= created_seq GROUP BY bookmark_id)"""

ORACLES = {
    "plan_state": with_(LOG, "SELECT * FROM state"),
    "after_reset": with_(LOG, "SELECT plan_id, ev.seq, event_id FROM ev JOIN state USING (plan_id) WHERE ev.seq >= created_seq AND (reset_seq IS NULL OR ev.seq > reset_seq)"),
    "active_plan": with_(LOG, "SELECT owner, arg_min(plan_id, {'a': created_seq, 'b': plan_id}) AS plan_id FROM state WHERE active GROUP BY owner"),
    "plan_by_id": with_(LOG, "SELECT event_id, floor(value)::BIGINT AS plan_id, name, current_page FROM events LEFT JOIN state ON plan_id = floor(value)::BIGINT"),
    "progress_of": with_(PROGRESS, "SELECT plan_id, page, status FROM progress WHERE (plan_id, page) IN (SELECT (floor(value)::BIGINT, event_id % 9 + 1) FROM events)"),
    "ritual_progress": with_(ritual(2, 15, 3), f"SELECT {RITUAL_COLUMNS} FROM ritual", True),
    "ritual_progress_short": with_(ritual(*SHORT), f"SELECT {RITUAL_COLUMNS} FROM ritual", True),
    "ritual_phase": with_(ritual(*SHORT), "SELECT plan_id, page, phase FROM ritual", True),
    "mark_memorized": with_(
        f"""{VERSES}, {PROGRESS},
marked AS (SELECT user_id AS plan_id, page FROM events JOIN (SELECT DISTINCT sura_no, page FROM verses) ON sura_no = event_id % 23 WHERE event_type = 'signup'
  UNION SELECT user_id, event_id % 17 + 50 FROM events WHERE event_type = 'view')""",
        """SELECT plan_id, page, CASE WHEN m THEN 2 ELSE listen_count END AS listen_count, CASE WHEN m THEN 15 ELSE read_count END AS read_count, CASE WHEN m THEN 3 ELSE recite_count END AS recite_count,
CASE WHEN m THEN TRUE ELSE surah_link_done END AS surah_link_done, CASE WHEN m THEN 'memorized' ELSE status END AS status, coalesce(times_reviewed, 0) AS times_reviewed
FROM progress FULL JOIN (SELECT *, TRUE AS m FROM marked) USING (plan_id, page)""",
    ),
    "build_review_chunks": with_(CHUNKS, "SELECT plan_id, chunk_id, sura_no, start_aya, end_aya, page::VARCHAR AS pages FROM chunks"),
    "consolidate_chunks": with_(MERGED, "SELECT * FROM merged", True),
    "todays_review": with_(MERGED, "SELECT plan_id, sura_no, chunk_id, start_aya, end_aya, pages FROM review", True),
    "complete_review": with_(
        f"""{CHUNKS}, done AS (SELECT plan_id, count(*) AS k, max(ts)::DATE AS last_day FROM ev WHERE event_type = 'purchase' AND 'chunk-' || plan_id || '-' || (event_id % 60 + 1) IN (SELECT chunk_id FROM chunks) GROUP BY plan_id),
sizes AS (SELECT plan_id, count(*) AS n FROM chunks GROUP BY plan_id)""",
        "SELECT plan_id, CASE WHEN k IS NOT NULL THEN (current_index + k) % n ELSE current_index END AS current_index, last_day FROM plans LEFT JOIN done USING (plan_id) LEFT JOIN sizes USING (plan_id)",
    ),
    "reviewed_pages": with_(
        CHUNKS,
        """SELECT plan_id, page, times_reviewed + (SELECT count(*) FROM ev e JOIN chunks c ON c.plan_id = e.plan_id AND c.page = e.event_id % 60 + 1 WHERE e.event_type = 'purchase' AND e.plan_id = p.plan_id AND c.page = p.page) AS times_reviewed FROM progress p""",
    ),
    "study_statistics": with_(
        f"{MERGED}, {STREAKS}, pg AS (SELECT plan_id, count(*) FILTER (status = 'memorized') AS memorized, count(*) FILTER (status = 'in-ritual') AS in_ritual FROM progress GROUP BY plan_id), cyc AS (SELECT plan_id, count(*) AS cycle FROM merged GROUP BY plan_id), mins AS (SELECT plan_id, sum(duration) AS minutes FROM sessions GROUP BY plan_id)",
        """SELECT plan_id, coalesce(memorized, 0) AS memorized, coalesce(in_ritual, 0) AS in_ritual, coalesce(cycle, 0) AS cycle, coalesce(minutes, 0.0)::DOUBLE AS minutes, coalesce(current_streak, 0) AS current_streak,
coalesce(longest_streak, 0) AS longest_streak, 604 - coalesce(memorized, 0) - coalesce(in_ritual, 0) AS new_pages, DATE '2024-01-20' + CAST(ceil((604 - coalesce(memorized, 0)) / 0.5) AS INTEGER) AS projected
FROM plans LEFT JOIN pg USING (plan_id) LEFT JOIN cyc USING (plan_id) LEFT JOIN mins USING (plan_id) LEFT JOIN streaks USING (plan_id)""", True,
    ),
    "streaks": with_(f"{PROGRESS}, {STREAKS}", "SELECT * FROM streaks"),
    "projected_completion": with_(PROGRESS, "SELECT plan_id, DATE '2024-01-20' + CAST(ceil((604 - count(*) FILTER (status = 'memorized')) / 0.5) AS INTEGER) AS projected FROM progress GROUP BY plan_id"),
    "next_new_page": with_(f"{PROGRESS}, {NEXT_PAGE}", "SELECT plan_id, next_page FROM next_page"),
    "next_chapter": with_(NEXT_CHAPTER, "SELECT plan_id, next_sura FROM next_ch"),
    "chapter_for_page": with_(
        f"{NEXT_CHAPTER}, oc AS (SELECT page, sura_no, count(*) AS n, min(id) AS f FROM verses GROUP BY page, sura_no), own AS (SELECT page, sura_no FROM oc QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, f) = 1)",
        """SELECT event_id AS ask_id, floor(value)::BIGINT AS plan_id, event_id % 700 + 1 AS page, event_id % 2 = 0 AS is_new, CASE WHEN n.plan_id IS NOT NULL THEN CASE WHEN event_id % 2 = 0 THEN next_sura ELSE own.sura_no END END AS sura_no
FROM events LEFT JOIN next_ch n ON n.plan_id = floor(value)::BIGINT LEFT JOIN own ON own.page = event_id % 700 + 1""",
    ),
    "chapter_progress": with_(
        NEXT_CHAPTER,
        """SELECT n.plan_id, next_sura, count(*) AS total_pages, count(r.page) AS completed_pages, CAST(floor(count(r.page) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent
FROM next_ch n JOIN cp ON cp.sura_no = next_sura LEFT JOIN progress r ON r.plan_id = n.plan_id AND r.page = cp.page AND r.status = 'memorized' GROUP BY ALL""",
    ),
    "completion_percentage": with_(
        PROGRESS, "SELECT plan_id, count(*) FILTER (status = 'memorized') / 604::DOUBLE * 100.0::DOUBLE AS completion FROM progress WHERE plan_id IN (SELECT plan_id FROM sessions WHERE completed) GROUP BY plan_id"
    ),
    "today_session": with_(f"{PROGRESS}, {TODAY}", "SELECT * FROM today"),
    "session_upsert": with_(
        f"{MERGED}, {NEXT_PAGE}, {TODAY}",
        """SELECT plan_id, t.session_id, t.session_id IS NULL AS created, CASE WHEN t.session_id IS NULL THEN chunk_id END AS review_chunk, CASE WHEN t.session_id IS NULL THEN next_page END AS new_page
FROM plans LEFT JOIN (SELECT * FROM today WHERE NOT completed) t USING (plan_id) LEFT JOIN review USING (plan_id) LEFT JOIN next_page USING (plan_id)""", True,
    ),
    "today_summary": with_(
        f"{MERGED}, {NEXT_PAGE}, {TODAY}",
        "SELECT plan_id, chunk_id, sura_no, pages, next_page, coalesce(NOT completed, FALSE) AS has_active_session FROM plans LEFT JOIN review USING (plan_id) LEFT JOIN next_page USING (plan_id) LEFT JOIN today USING (plan_id)", True,
    ),
    "bookmarks_state": with_(BOOK, "SELECT * FROM books"),
    "bookmark_of_page": with_(f"{VERSES}, {BOOK}", "SELECT page, arg_min(bookmark_id, {'a': created_seq, 'b': bookmark_id}) AS bookmark_id, count(bookmark_id) > 0 AS bookmarked FROM (SELECT DISTINCT page FROM verses) LEFT JOIN books USING (page) GROUP BY page"),
    "recordings_with_audio": "SELECT event_id AS recording_id, user_id AS sura_no, event_id % 12 + 1 AS aya_no, length(text) AS n_bytes FROM events JOIN documents ON doc_id = event_id",
    "session_log_upsert": "SELECT session_id, seq, kind, plan_id FROM (SELECT event_id % 3000 AS session_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS kind, user_id AS plan_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY event_id DESC) = 1) WHERE kind <> 'delete'",
    "session_phase": with_(
        ritual(*SHORT),
        """SELECT event_id AS session_id, user_id AS plan_id, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN 'review' WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN CASE WHEN r.status = 'in-ritual' THEN r.phase ELSE 'listen' END ELSE 'complete' END AS phase,
CAST(floor(floor(value * 10000) / 60000 + 0.5) AS BIGINT) AS minutes FROM events LEFT JOIN ritual r ON r.plan_id = user_id AND r.page = event_id % 3 AND event_id % 3 <> 0""", True,
    ),
}
