"""Study analytics: plans, page progress, reviews, streaks and the next thing to do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.folds import ordered_fold
from lectern.functions.ordering import nth_smallest, rank_within, running_offset

# --- fixed values -----------------------------------------------------------
LISTEN_TARGET, READ_TARGET, RECITE_TARGET = 2, 15, 3
TOTAL_PAGES = 604
GRACE_PAGES = 3
RECENT_DAYS = 30
MAX_CHUNK_PAGES = 5
PAGES_PER_DAY = 0.5
# ----------------------------------------------------------------------------


def _current(log: DataFrame, key: str, fields: list[str], born: str, dead: str) -> DataFrame:
    """Rows of a change log that still count: after the last removal, from a birth on."""
    gone = log.groupBy(key).agg(F.max(F.when(F.col("kind") == dead, F.col("seq"))).alias("_gone"))
    rows = log.join(gone, key).filter("_gone IS NULL OR seq > _gone")
    births = rows.filter(F.col("kind") == born).groupBy(key).agg(F.min("seq").alias("created_seq"))
    return rows.join(births, key).filter("seq >= created_seq").select(key, "seq", "kind", "created_seq", *fields)


def _last(field: str, where: Column | None = None) -> Column:
    """Last value given for a field; an aggregate that merges before the shuffle."""
    given = F.col(field).isNotNull() if where is None else where
    return F.max_by(field, F.when(given, F.col("seq"))).alias(field)


def plan_state(log: DataFrame) -> DataFrame:
    """Current plans from ``create / update / pause / resume / reset / delete`` rows.

    Each field keeps its last written value; a reset zeroes the completion, and rows
    of progress or sessions up to ``reset_seq`` no longer count.
    """
    fields = ["owner", "name", "direction", "active", "current_page", "completion", "ts"]
    rows = _current(log, "plan_id", fields, "create", "delete").withColumn(
        "completion", F.when(F.col("kind") == "reset", 0.0).otherwise(F.col("completion"))
    ).withColumn("paused_at", F.when(F.col("kind") == "pause", F.col("ts")))
    return rows.groupBy("plan_id").agg(
        *[_last(f) for f in ("owner", "name", "direction", "active", "current_page")],
        F.coalesce(_last("completion"), F.lit(0.0)).alias("completion"),
        _last("paused_at", F.col("kind").isin("pause", "resume")),
        F.max(F.when(F.col("kind") == "reset", F.col("seq"))).alias("reset_seq"),
        F.min("created_seq").alias("created_seq"),
    )


def after_reset(facts: DataFrame, plans: DataFrame) -> DataFrame:
    """Facts ``(plan_id, seq, ...)`` of existing plans that no reset has dropped."""
    keep = plans.select("plan_id", "created_seq", "reset_seq")
    return facts.join(keep, "plan_id").filter(
        "seq >= created_seq AND (reset_seq IS NULL OR seq > reset_seq)"
    ).drop("created_seq", "reset_seq")


def active_plan(plans: DataFrame) -> DataFrame:
    """First created active plan of each owner."""
    return plans.filter("active").groupBy("owner").agg(
        F.min_by("plan_id", F.struct("created_seq", "plan_id")).alias("plan_id")
    )


def plan_by_id(asked: DataFrame, plans: DataFrame) -> DataFrame:
    return asked.join(plans, "plan_id", "left")


def progress_of(asked: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress of asked plans, or of asked (plan, page) pairs."""
    keys = ["plan_id", "page"] if "page" in asked.columns else ["plan_id"]
    return progress.join(asked.select(*keys).distinct(), keys, "left_semi")


def ritual_progress(
    events: DataFrame, targets: tuple[int, int, int] = (LISTEN_TARGET, READ_TARGET, RECITE_TARGET)
) -> DataFrame:
    """Ritual counts of each (plan, page) from its ordered events.

    A stage counts only once the stage before is complete, that is, from the row that
    completed it on. That row is the n-th of its kind, so the state follows from a few
    small top-n selections and counts instead of a walk through each key's events.
    """
    keys = ["plan_id", "page"]
    ok = {
        "listen": F.col("kind") == "listen",
        "read": F.col("kind") == "read",
        "recite": (F.col("kind") == "recite") & F.col("error_free"),
    }
    state = events.select(*keys).distinct()
    since = None
    for (name, test), target in zip(ok.items(), targets):
        rows = events.filter(test).select(*keys, "seq")
        if since is not None:
            rows = rows.join(since, keys).filter("seq > _since").select(*keys, "seq")
        counts = rows.groupBy(*keys).agg(
            F.least(F.count(F.lit(1)), F.lit(target)).alias(f"{name}_count")
        )
        state = state.join(counts, keys, "left")
        since = nth_smallest(rows, keys, "seq", target, "_since")
    linked = events.filter("kind = 'surah-link'").join(since, keys).filter("seq > _since").select(
        *keys, F.lit(True).alias("surah_link_done")
    ).distinct()
    done = state.join(linked, keys, "left")
    counts = [F.coalesce(f"{n}_count", F.lit(0)).alias(f"{n}_count") for n in ok]
    link = F.coalesce("surah_link_done", F.lit(False))
    return done.select(
        *keys, *counts, link.alias("surah_link_done"),
        F.when(link, "memorized").otherwise("in-ritual").alias("status"),
    )


def ritual_phase(
    targets: tuple[int, int, int] = (LISTEN_TARGET, READ_TARGET, RECITE_TARGET)
) -> Column:
    """Phase of a row with ritual counts."""
    listen, read, recite = targets
    return (
        F.when(F.col("listen_count") < listen, "listen")
        .when(F.col("read_count") < read, "read")
        .when(F.col("recite_count") < recite, "recite")
        .when(~F.col("surah_link_done"), "surah-link")
        .otherwise("complete")
    )


def pages_to_mark(chapters: DataFrame, pages: DataFrame, chapter_pages: DataFrame) -> DataFrame:
    """Distinct pages of listed chapters and listed pages, per plan."""
    return (
        chapters.join(chapter_pages, "sura_no").select("plan_id", "page")
        .unionByName(pages.select("plan_id", "page")).distinct()
    )


def mark_memorized(progress: DataFrame, marked: DataFrame) -> DataFrame:
    """Progress with the marked pages memorized, added where there was no row."""
    flag = marked.select("plan_id", "page").distinct().withColumn("_m", F.lit(True))
    rows = progress.join(flag, ["plan_id", "page"], "full_outer")
    done = {
        "listen_count": F.lit(LISTEN_TARGET), "read_count": F.lit(READ_TARGET),
        "recite_count": F.lit(RECITE_TARGET), "surah_link_done": F.lit(True),
        "status": F.lit("memorized"),
    }
    return rows.select(
        "plan_id", "page",
        *[
            F.when(F.col("_m"), v.cast(progress.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            for c, v in done.items()
        ],
        F.coalesce("times_reviewed", F.lit(0)).alias("times_reviewed"),
    )


def build_review_chunks(progress: DataFrame, spans: DataFrame) -> DataFrame:
    """One chunk per memorized page: the primary chapter's verses on it."""
    return progress.filter("status = 'memorized'").join(spans, "page").select(
        "plan_id",
        F.concat_ws("-", F.lit("chunk"), F.col("plan_id").cast("string"), F.col("page").cast("string")).alias("chunk_id"),
        "sura_no", "start_aya", "end_aya", F.array("page").alias("pages"), "memorized_at",
    )


def consolidate_chunks(chunks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Join neighbouring old chunks of a chapter while they hold under five pages.

    The size is tested before a chunk is taken in, so a joined one may hold more. Each
    step depends on the one before: a fold over the chunks of one plan and chapter.
    """
    recent = F.expr(f"memorized_at > timestamp'{as_of:%Y-%m-%d %H:%M:%S}' - interval {RECENT_DAYS} days")
    rows = chunks.select(
        "plan_id", "sura_no", "start_aya", "end_aya", "chunk_id", "memorized_at",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("_pages"),
        recent.alias("_recent"),
    )

    def start():
        return {"open": None}

    def pack(c):
        return (c["id"], c["a"], c["b"], ",".join(str(p) for p in sorted(c["pages"])), c["at"])

    def step(state, row):
        pages = {int(p) for p in row["_pages"].split(",")}
        cur = state["open"]
        if cur is not None and not cur["recent"] and not row["_recent"] and len(cur["pages"]) < MAX_CHUNK_PAGES:
            cur["b"] = row["end_aya"]
            cur["pages"] |= pages
            return []
        state["open"] = {
            "id": row["chunk_id"], "a": row["start_aya"], "b": row["end_aya"], "pages": pages,
            "at": row["memorized_at"], "recent": row["_recent"],
        }
        return [] if cur is None else [pack(cur)]

    merged = ordered_fold(
        rows, ["plan_id", "sura_no"], ["start_aya", "memorized_at", "chunk_id"], start, step,
        "chunk_id string, start_aya bigint, end_aya bigint, pages string, memorized_at timestamp",
        finish=lambda s: [pack(s["open"])],
    )
    return merged.withColumn("pages", F.split("pages", ",").cast("array<bigint>"))


def todays_review(plans: DataFrame, chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Chunk whose turn it is, for plans with enough memorized pages.

    ``plans`` is ``(plan_id, current_index)``; ``chunks`` are consolidated.
    """
    known = progress.filter("status = 'memorized'").groupBy("plan_id").agg(F.count(F.lit(1)).alias("_m"))
    sizes = chunks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_n"))
    turn = (
        plans.join(known.filter(F.col("_m") >= GRACE_PAGES), "plan_id").join(sizes, "plan_id")
        .select("plan_id", (F.pmod(F.col("current_index"), F.col("_n")) + 1).alias("_turn"))
    )
    ranked = rank_within(chunks, ["plan_id"], F.col("sura_no"), ["start_aya", "chunk_id"], "_turn")
    return ranked.join(turn, ["plan_id", "_turn"]).drop("_turn")


def complete_reviews(plans: DataFrame, chunks: DataFrame, completions: DataFrame) -> DataFrame:
    """Rotation after completed reviews: each known one moves the index by one."""
    sizes = chunks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_n"))
    done = completions.join(chunks.select("plan_id", "chunk_id"), ["plan_id", "chunk_id"], "left_semi")
    moved = done.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_k"), F.max("ts").alias("last_review"))
    return plans.join(sizes, "plan_id", "left").join(moved, "plan_id", "left").select(
        "plan_id",
        F.when(F.col("_k").isNotNull(), F.pmod(F.col("current_index") + F.col("_k"), F.col("_n")))
        .otherwise(F.col("current_index")).alias("current_index"),
        "last_review",
    )


def reviewed_pages(progress: DataFrame, chunks: DataFrame, completions: DataFrame) -> DataFrame:
    """Progress with one more review for every completion of a page's chunk."""
    counted = completions.groupBy("plan_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("_k"), F.max("ts").alias("_at")
    )
    per_page = (
        counted.join(chunks.select("plan_id", "chunk_id", F.explode("pages").alias("page")), ["plan_id", "chunk_id"])
        .groupBy("plan_id", "page").agg(F.sum("_k").alias("_k"), F.max("_at").alias("last_review"))
    )
    return progress.join(per_page, ["plan_id", "page"], "left").withColumn(
        "times_reviewed", F.col("times_reviewed") + F.coalesce("_k", F.lit(0))
    ).drop("_k")


def streaks(sessions: DataFrame, as_of: dt.date) -> DataFrame:
    """Current and longest run of days with a completed session, per plan.

    The current run must reach ``as_of`` itself. Days are counted once before any
    sorting, so a plan's rows are its calendar days.
    """
    days = sessions.filter("completed").select("plan_id", F.to_date("date").alias("day")).distinct()
    n = F.row_number().over(W.partitionBy("plan_id").orderBy("day"))
    islands = days.withColumn("_start", F.date_sub("day", n)).groupBy("plan_id", "_start").agg(
        F.count(F.lit(1)).alias("length"), F.max("day").alias("last")
    )
    # the newest day must be today itself; its run is then the current one
    current = F.when(F.max("last") == F.lit(as_of), F.max_by("length", "last"))
    return islands.groupBy("plan_id").agg(
        F.coalesce(current, F.lit(0)).alias("current_streak"),
        F.max("length").alias("longest_streak"),
    )


def projected_completion(memorized: Column, as_of: dt.date, total: int = TOTAL_PAGES) -> Column:
    return F.date_add(F.lit(as_of), F.ceil((total - memorized) / F.lit(PAGES_PER_DAY)).cast("int"))


def study_statistics(
    plans: DataFrame, progress: DataFrame, chunks: DataFrame, sessions: DataFrame, as_of: dt.date,
    total: int = TOTAL_PAGES,
) -> DataFrame:
    """Pages by state, rotation length, minutes, streaks and expected end per plan."""
    pages = progress.groupBy("plan_id").agg(
        F.count_if(F.col("status") == "memorized").alias("memorized"),
        F.count_if(F.col("status") == "in-ritual").alias("in_ritual"),
    )
    cycle = chunks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("cycle"))
    time = sessions.groupBy("plan_id").agg(F.sum("duration").alias("minutes"))
    rows = plans.select("plan_id")
    for part in (pages, cycle, time, streaks(sessions, as_of)):
        rows = rows.join(part, "plan_id", "left")
    zero = F.lit(0)
    rows = rows.select(
        "plan_id",
        *[F.coalesce(c, zero).alias(c) for c in ("memorized", "in_ritual", "cycle")],
        F.coalesce("minutes", F.lit(0.0)).alias("minutes"),
        *[F.coalesce(c, zero).alias(c) for c in ("current_streak", "longest_streak")],
    )
    return rows.withColumn("new_pages", total - F.col("memorized") - F.col("in_ritual")).withColumn(
        "projected", projected_completion(F.col("memorized"), as_of, total)
    )


def _first_gap(rows: DataFrame, value: str, origin: str, backward: str) -> DataFrame:
    """First whole number from ``origin`` on (or down) that a plan's values lack.

    Sorted values that equal their own place form the unbroken beginning, so the gap
    is found by counting, not by listing what could be missing.
    """
    away = F.when(F.col(backward), F.col(origin) - F.col(value)).otherwise(F.col(value) - F.col(origin))
    near = rows.select("plan_id", away.alias("_d")).filter("_d >= 0").distinct()
    placed = rank_within(near, ["plan_id"], F.floor(F.col("_d") / 4096), ["_d"], "_k")
    return placed.filter("_d = _k - 1").groupBy("plan_id").agg(F.count(F.lit(1)).alias("_run"))


def next_new_page(plans: DataFrame, progress: DataFrame) -> DataFrame:
    """First page of each plan, in its direction, without any progress; else null."""
    p = plans.select(
        "plan_id", "start_page", "end_page", (F.col("direction") == "backward").alias("_back")
    ).withColumn("_origin", F.when(F.col("_back"), F.col("end_page")).otherwise(F.col("start_page")))
    run = _first_gap(progress.join(p, "plan_id"), "page", "_origin", "_back")
    at = p.join(run, "plan_id", "left").withColumn("_run", F.coalesce("_run", F.lit(0)))
    page = F.when(F.col("_back"), F.col("_origin") - F.col("_run")).otherwise(F.col("_origin") + F.col("_run"))
    return at.select(
        "plan_id", F.when(page.between(F.col("start_page"), F.col("end_page")), page).alias("next_page")
    )


def next_chapter(plans: DataFrame, progress: DataFrame, chapter_pages: DataFrame) -> DataFrame:
    """First chapter, in the plan's direction, with a page not started; else null."""
    sizes = chapter_pages.groupBy("sura_no").agg(F.count(F.lit(1)).alias("n_pages")).withColumn("_one", F.lit(1))

    def ranked(key: Column, back: bool) -> DataFrame:
        rows = sizes.withColumn("_key", key)
        ranks = running_offset(rows, "_key", "_one", "place")
        return rows.join(ranks, "_key").select("sura_no", "n_pages", F.lit(back).alias("_back"), "place")

    placed = ranked(F.col("sura_no"), False).unionByName(ranked(-F.col("sura_no"), True))
    p = plans.select("plan_id", (F.col("direction") == "backward").alias("_back"))
    started = (
        progress.select("plan_id", "page").distinct().join(chapter_pages, "page")
        .groupBy("plan_id", "sura_no").agg(F.count(F.lit(1)).alias("_s"))
        .join(p, "plan_id").join(placed, ["sura_no", "_back"]).filter("_s = n_pages")
        .select("plan_id", "place", F.lit(0).alias("_origin"), F.lit(False).alias("_down"))
    )
    run = _first_gap(started, "place", "_origin", "_down")
    at = p.join(run, "plan_id", "left").withColumn("place", F.coalesce("_run", F.lit(0)))
    return at.join(placed, ["_back", "place"], "left").select("plan_id", F.col("sura_no").alias("next_sura"))


def chapter_for_page(asked: DataFrame, next_chapters: DataFrame, primary: DataFrame) -> DataFrame:
    """Chapter to study for ``(ask_id, plan_id, page, is_new)``: next one, or the page's own.

    Plans that do not exist give null.
    """
    rows = asked.join(next_chapters.withColumn("_plan", F.lit(True)), "plan_id", "left").join(
        primary.select("page", F.col("sura_no").alias("_own")), "page", "left"
    )
    return rows.select(
        *asked.columns,
        F.when(F.col("_plan"), F.when(F.col("is_new"), F.col("next_sura")).otherwise(F.col("_own"))).alias("sura_no"),
    )


def chapter_progress(next_chapters: DataFrame, progress: DataFrame, chapter_pages: DataFrame) -> DataFrame:
    """Memorized pages of each plan's next chapter and their rounded share."""
    pages = next_chapters.filter("next_sura IS NOT NULL").join(
        chapter_pages.withColumnRenamed("sura_no", "next_sura"), "next_sura"
    )
    done = progress.filter("status = 'memorized'").select("plan_id", "page").distinct().withColumn("_d", F.lit(1))
    counted = pages.join(done, ["plan_id", "page"], "left").groupBy("plan_id", "next_sura").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count("_d").alias("completed_pages")
    )
    share = F.floor(F.col("completed_pages") * 100.0 / F.col("total_pages") + 0.5)
    return counted.withColumn("percent", share)


def completion_percentage(progress: DataFrame, sessions: DataFrame, total: int = TOTAL_PAGES) -> DataFrame:
    """Share of memorized pages of plans that completed a session."""
    finished = sessions.filter("completed").select("plan_id").distinct()
    counted = progress.groupBy("plan_id").agg(F.count_if(F.col("status") == "memorized").alias("_m"))
    return finished.join(counted, "plan_id", "left").select(
        "plan_id", (F.coalesce("_m", F.lit(0)) / F.lit(total) * 100.0).alias("completion")
    )


def today_session(sessions: DataFrame, as_of: dt.date) -> DataFrame:
    """First session of each plan on the day."""
    return sessions.filter(F.to_date("date") == F.lit(as_of)).groupBy("plan_id").agg(
        F.min_by(F.struct("session_id", "completed"), F.struct("date", "session_id")).alias("s")
    ).select("plan_id", "s.session_id", "s.completed")


def session_upsert(plans: DataFrame, today: DataFrame, review: DataFrame, next_page: DataFrame) -> DataFrame:
    """The day's session of each plan: the unfinished one, or a new one with its parts."""
    rows = (
        plans.select("plan_id")
        .join(today.filter("NOT completed").select("plan_id", "session_id"), "plan_id", "left")
        .join(review.select("plan_id", "chunk_id"), "plan_id", "left")
        .join(next_page, "plan_id", "left")
    )
    fresh = F.col("session_id").isNull()
    return rows.select(
        "plan_id", "session_id", fresh.alias("created"),
        F.when(fresh, F.col("chunk_id")).alias("review_chunk"),
        F.when(fresh, F.col("next_page")).alias("new_page"),
    )


def today_summary(plans: DataFrame, today: DataFrame, review: DataFrame, next_page: DataFrame) -> DataFrame:
    """Review chunk, next page and whether a session is open, per plan."""
    return (
        plans.select("plan_id")
        .join(review.select("plan_id", "chunk_id", "sura_no", "pages"), "plan_id", "left")
        .join(next_page, "plan_id", "left")
        .join(today, "plan_id", "left")
        .select("plan_id", "chunk_id", "sura_no", "pages", "next_page", F.coalesce(~F.col("completed"), F.lit(False)).alias("has_active_session"))
    )


def bookmarks_state(log: DataFrame) -> DataFrame:
    """Current bookmarks from ``add / update / remove`` rows."""
    rows = _current(log, "bookmark_id", ["owner", "page", "note"], "add", "remove")
    return rows.groupBy("bookmark_id").agg(
        _last("owner"), _last("page"), _last("note"), F.min("created_seq").alias("created_seq")
    )


def bookmark_of_page(asked: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """First bookmark on each asked page and whether there is one."""
    first = bookmarks.groupBy("page").agg(
        F.min_by("bookmark_id", F.struct("created_seq", "bookmark_id")).alias("bookmark_id")
    )
    return asked.join(first, "page", "left").withColumn("bookmarked", F.col("bookmark_id").isNotNull())


def recordings_with_audio(recordings: DataFrame, blobs: DataFrame) -> DataFrame:
    """Recordings whose audio is stored; filter the result by verse or page."""
    return recordings.join(blobs, "recording_id")


def session_log_upsert(log: DataFrame) -> DataFrame:
    """Last saved row of each session id, deleted ones left out."""
    cols = [c for c in log.columns if c != "session_id"]
    return log.groupBy("session_id").agg(F.max_by(F.struct(*cols), "seq").alias("r")).filter(
        "r.kind <> 'delete'"
    ).select("session_id", *[F.col("r")[c].alias(c) for c in cols])


def session_phase(sessions: DataFrame, ritual: DataFrame, targets=(LISTEN_TARGET, READ_TARGET, RECITE_TARGET)) -> DataFrame:
    """Where an open session stands, and its length in whole minutes.

    ``sessions`` has ``plan_id, review_chunk, review_done, new_page, new_done, elapsed_ms``.
    """
    state = ritual.select("plan_id", F.col("page").alias("new_page"), "status", ritual_phase(targets).alias("_phase"))
    rows = sessions.join(state, ["plan_id", "new_page"], "left")
    phase = (
        F.when(F.col("review_chunk").isNotNull() & ~F.col("review_done"), "review")
        .when(
            F.col("new_page").isNotNull() & ~F.col("new_done"),
            F.when(F.col("status") == "in-ritual", F.col("_phase")).otherwise("listen"),
        )
        .otherwise("complete")
    )
    return rows.select("session_id", "plan_id", phase.alias("phase"), F.floor(F.col("elapsed_ms") / 60000 + 0.5).alias("minutes"))
