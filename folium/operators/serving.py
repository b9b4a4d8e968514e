"""What is served: courses, weeks, deadlines, ledgers, bibliographies, payloads. Tables by the names of their columns:

course (id, code, title, term, year, ..), session (id, course_id, ordinal, week_number, meeting_date, topic, session_type), reading (session_id, ordinal, work_id,
requirement_level, page_range), work (id, title, surname, signature, raw), deliverable (id, course_id, ordinal, title, due_date, recurrence, weight_percent),
policy (course_id, policy_type, ai_stance), document (work_id), note (id, work_id, page_number, body, shareable), chunk (document_id, ordinal, page_number, body).
A window's partition is a course, whose sessions and deadlines are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import dates as D
from folium.operators.policies import rank

TODAY_BACK, TODAY_AHEAD, LATE, SOON = -3, 7, -6, 30
MOST_PASSAGES = 400


def squeezed(code: Column) -> Column:
    """PRJ7: a course code without spaces and case."""
    return F.lower(F.replace(code, F.lit(" "), F.lit("")))


def with_stance(courses: DataFrame, policies: DataFrame, order: str = "ordinal") -> DataFrame:
    """JOIN3: courses with the stance of their first policy on AI; null without one."""
    first = policies.where("policy_type = 'ai_use'").groupBy(F.col("course_id").alias("id")).agg(F.min_by("ai_stance", order).alias("ai_stance"))
    return courses.join(first, "id", "left")


def course_order() -> list[Column]:
    """SRT1: the latest year first, then term and code."""
    return [F.desc_nulls_last("year"), F.asc_nulls_first("term"), F.asc("code")]


def term_key(term: Column, year: Column) -> Column:
    """VOC17: a term's place in time; a year with an unknown term comes last in it, no year is none."""
    place = D.lookup(F.lower(term), {n: k for k, n in enumerate(D.TERM_ORDER)} | {"autumn": 3})
    return F.when(year.isNotNull(), year * 10 + F.coalesce(place, F.lit(9)))


def current_term(courses: DataFrame) -> DataFrame:
    """AGG18: the courses of the latest term, and those that name none."""
    c = courses.withColumn("_key", term_key(F.col("term"), F.col("year")))
    last = c.agg(F.max("_key").alias("_last"))  # one row
    return c.join(F.broadcast(last)).where(F.col("_key").isNull() | (F.col("_key") == F.col("_last"))).drop("_key", "_last")


def choose_sessions(sessions: DataFrame, on: Column, week: int | None = None) -> DataFrame:
    """SRV1: a course's sessions of the asked week; else those of the seven days from the next meeting on; else of the last meeting; else the first session."""
    if week is not None:
        return sessions.where(F.col("week_number") == week)
    d = F.col("meeting_date")
    ahead = F.min(F.when(d >= on, d))
    picks = sessions.groupBy("course_id").agg(ahead.alias("_next"), F.max("meeting_date").alias("_last"), F.min("ordinal").alias("_first"))
    s = sessions.join(picks, "course_id")
    hit = F.when(F.col("_next").isNotNull(), d.between(F.col("_next"), F.date_add("_next", 6))).when(F.col("_last").isNotNull(), d == F.col("_last")).otherwise(F.col("ordinal") == F.col("_first"))
    return s.where(hit).select(*sessions.columns)


def readings_of(sessions: DataFrame, readings: DataFrame, works: DataFrame, documents: DataFrame) -> DataFrame:
    """JOIN1, JOIN8: the readings of sessions with their work and whether a document is held."""
    held = documents.where("work_id is not null").groupBy("work_id").agg(F.count("*").alias("documents"))
    r = readings.join(sessions.select(F.col("id").alias("session_id"), "course_id", "week_number", "meeting_date"), "session_id")
    r = r.join(works.select(F.col("id").alias("work_id"), "title", "surname", "signature"), "work_id").join(held, "work_id", "left")
    return r.withColumn("present", F.coalesce("documents", F.lit(0)) > 0).drop("documents")


def this_week(courses: DataFrame, sessions: DataFrame, readings: DataFrame, deliverables: DataFrame, on: Column) -> DataFrame:
    """SRV5: of the current term's courses what falls between three days ago and seven ahead: readings, and work that is not handed in (done):
    one row (readings, pages, due, courses)."""
    now = current_term(courses).select(F.col("id").alias("course_id"))
    inside = lambda d: F.datediff(d, on).between(TODAY_BACK, TODAY_AHEAD)
    met = sessions.where(inside(F.col("meeting_date"))).join(now, "course_id", "left_semi")
    r = readings.join(met.select(F.col("id").alias("session_id"), "course_id"), "session_id").select("course_id", D.page_count(F.coalesce("page_range", F.lit(""))).alias("pages"), F.lit(1).alias("r"), F.lit(0).alias("d"))
    due = deliverables.where(inside(F.col("due_date")) & ~F.col("done")).join(now, "course_id", "left_semi").select("course_id", F.lit(0).alias("pages"), F.lit(0).alias("r"), F.lit(1).alias("d"))
    return r.unionByName(due).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("readings"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("d"), F.lit(0)).alias("due"), F.count_distinct("course_id").alias("courses"))


def band(due: Column, done: Column, on: Column) -> Column:
    """SRV6: handed in, overdue, next 7 days, later, no date found."""
    n = F.datediff(due, on)
    return F.when(done, "Handed in").when(n.isNull(), "No date found").when(n < 0, "Overdue").when(n <= 7, "Next 7 days").otherwise("Later")


def ledger(sessions: DataFrame, readings: DataFrame, on: Column) -> DataFrame:
    """SRV7, WIN4, WIN6: the readings of a course in the ledger's order with a running number and their week's number and days.

    A course of which three sessions at least and 80 % are dated goes by date, others as written; sessions of one week number are a group.
    """
    w = Window.partitionBy("course_id")
    s = sessions.withColumn("_sorted", (F.count("meeting_date").over(w) >= 3) & (F.count("meeting_date").over(w) >= 0.8 * F.count("*").over(w)))
    s = s.withColumn("_date", F.when(F.col("_sorted"), F.coalesce("meeting_date", F.lit("9999-12-31").cast("date")))).withColumn("_at", F.row_number().over(w.orderBy("_date", "ordinal")))
    s = s.withColumn("_group", F.coalesce(F.col("week_number").cast("string"), F.concat(F.lit("x"), "ordinal")))
    g = Window.partitionBy("course_id", "_group")
    s = s.withColumn("_first", F.min("_at").over(g)).withColumn("days", F.datediff(F.min("meeting_date").over(g), on)).withColumn("week", F.dense_rank().over(w.orderBy("_first")))
    r = readings.join(s.select(F.col("id").alias("session_id"), "course_id", "week", "days", "_first", "_at"), "session_id")
    number = F.row_number().over(w.orderBy("_first", "_at", "ordinal", "work_id"))
    return r.withColumn("number", number).drop("_first", "_at")


def meters(entries: DataFrame, keep: Column | None = None) -> DataFrame:
    """AGG13, PRJ8: read and total entries and pages of a course (entries with read), and how many a filter leaves; what is hidden still counts."""
    pages = D.page_count(F.coalesce("page_range", F.lit("")))
    shown = F.lit(True) if keep is None else keep
    return entries.withColumn("_pages", pages).groupBy("course_id").agg(F.count_if("read").alias("read"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("read"), F.col("_pages"))), F.lit(0)).alias("pages_done"), F.sum("_pages").alias("pages"), F.count_if(shown).alias("shown"))


def shown_entries(unread: bool = False, required: bool = False, soon: bool = False) -> Column:
    """PRJ8: the ledger's filters."""
    out = F.lit(True)
    if unread:
        out = out & ~F.col("read")
    if required:
        out = out & (F.col("requirement_level") == "required")
    if soon:
        out = out & F.coalesce(F.col("days").between(LATE, SOON), F.lit(False))
    return out


def current_week(entries: DataFrame) -> DataFrame:
    """WIN5: (course_id, week): the week with the least days among those of six days ago or later; the first of equals."""
    return entries.where(F.col("days") >= LATE).groupBy("course_id").agg(F.min_by("week", F.struct("days", "week")).alias("week"))


def due_in_week(sessions: DataFrame, deliverables: DataFrame, most: int | None = None) -> DataFrame:
    """JOIN9, SRT7: the deliverables due on a meeting's date, by course and week (at most so many of each)."""
    met = sessions.where("meeting_date is not null").select("course_id", "week_number", F.col("meeting_date").alias("due_date")).distinct()
    hit = deliverables.join(met, ["course_id", "due_date"])
    if most is None:
        return hit
    n = F.row_number().over(Window.partitionBy("course_id", "week_number").orderBy("due_date", "id"))
    return hit.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def next_due(courses: DataFrame, deliverables: DataFrame, on: Column, most: int = 2) -> DataFrame:
    """SRT7: what is due next in the current term's courses and not done."""
    d = deliverables.where((F.datediff("due_date", on) >= 0) & ~F.col("done")).join(current_term(courses).select(F.col("id").alias("course_id"), "code"), "course_id")
    return d.orderBy("due_date", "code", "id").limit(most)


def dated_deadlines(courses: DataFrame, deliverables: DataFrame, important: DataFrame) -> DataFrame:
    """SET2: what can stand in a calendar: dated work and dates to know (course_id, label, start): code, title, date, weight."""
    c = courses.select(F.col("id").alias("course_id"), "code")
    work = deliverables.where("due_date is not null").join(c, "course_id").select("code", "title", F.col("due_date").alias("date"), F.col("weight_percent").alias("weight"))
    label = F.trim(F.regexp_replace("label", r"\s+", " "))
    know = important.where(F.col("start").isNotNull() & (label != "")).join(c, "course_id").select("code", label.alias("title"), F.col("start").alias("date"), F.lit(None).cast("double").alias("weight"))
    return work.unionByName(know)


FAR, SCHEDULED = "9999-99-99", "9998-99-99"


def placed_in_time(courses: DataFrame, deliverables: DataFrame) -> DataFrame:
    """SRT4: graded work with a key to sort by and a group: dated, dated by the schedule, recurring, undated; what has neither date, recurrence nor weight is left out."""
    weighted = F.coalesce(F.col("weight_percent") != 0, F.lit(False))
    d = deliverables.where(F.col("due_date").isNotNull() | (F.coalesce("recurrence", F.lit("")) != "") | weighted)
    by_schedule, recurs = F.col("recurrence") == "see schedule", F.coalesce("recurrence", F.lit("")) != ""
    key = F.when(F.col("due_date").isNotNull(), F.col("due_date").cast("string")).when(by_schedule, SCHEDULED).otherwise(FAR)
    group = F.when(F.col("due_date").isNotNull() | by_schedule, "dated").when(recurs, "recurring").otherwise("undated")
    return d.join(courses.select(F.col("id").alias("course_id"), "code"), "course_id").withColumn("sort", key).withColumn("group", group)


def bibliography(readings: DataFrame, works: DataFrame) -> DataFrame:
    """AGG14, AGG16, SRT5: a course's works once each (by signature, else raw text), numbered by author, else title. readings: course_id, work_id, place."""
    key = F.coalesce("signature", "raw")
    r = readings.join(works.withColumnRenamed("id", "work_id"), "work_id").withColumn("_key", key)
    first = r.groupBy("course_id", "_key").agg(F.min_by(F.struct("work_id", "title", "surname"), F.struct("place", "work_id")).alias("w")).select("course_id", "w.*")
    sort = F.lower(F.coalesce(F.nullif("surname", F.lit("")), "title", F.lit("")))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("course_id").orderBy(sort, "title", "work_id")))


def policies_in_order(policies: DataFrame) -> DataFrame:
    """SRT3, SRV8: a course's policies by the rank of their type, boilerplate last."""
    return policies.withColumn("place", F.row_number().over(Window.partitionBy("course_id").orderBy(rank(F.col("policy_type")), "ordinal")))


def course_of_work(readings: DataFrame, sessions: DataFrame, courses: DataFrame) -> DataFrame:
    """JOIN5: each work's course: that of the first reading that assigns it (by session)."""
    r = readings.join(sessions.select(F.col("id").alias("session_id"), "course_id"), "session_id").join(courses.select(F.col("id").alias("course_id"), "code"), "course_id")
    return r.groupBy("work_id").agg(F.min_by(F.struct("course_id", "code"), F.struct("session_id", "ordinal", "course_id")).alias("c")).select("work_id", "c.*")


def notes_of_course(readings: DataFrame, sessions: DataFrame, notes: DataFrame, shareable: bool = True) -> DataFrame:
    """JOIN13: the notes on a course's works, once each; only those that may be shared unless asked for all."""
    held = readings.join(sessions.select(F.col("id").alias("session_id"), "course_id"), "session_id").select("course_id", "work_id").distinct()
    return held.join(notes.where("shareable") if shareable else notes, "work_id")


def passages(documents: DataFrame, chunks: DataFrame, most: int = MOST_PASSAGES) -> DataFrame:
    """PRJ6: the first passages of each work, at most so many."""
    c = chunks.join(documents.select(F.col("id").alias("document_id"), "work_id"), "document_id")
    n = F.row_number().over(Window.partitionBy("work_id").orderBy("ordinal", "document_id"))
    return c.withColumn("place", n).where(F.col("place") <= most)


def found_chunks(hits: DataFrame, chunks: DataFrame, documents: DataFrame, works: DataFrame) -> DataFrame:
    """JOIN4: a search's hits (document_id, ordinal, score) with the chunk, its document and the document's work, if it has one."""
    h = hits.join(chunks, ["document_id", "ordinal"]).join(documents.withColumnRenamed("id", "document_id"), "document_id")
    return h.join(works.select(F.col("id").alias("work_id"), "title"), "work_id", "left")
