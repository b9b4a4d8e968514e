"""Parsers of whole documents: citations, schedules, graded work, policies, grids, over the given documents and over documents written from the tables' rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import cite as C
from folium.functions import dates as D
from folium.operators import frontmatter as M
from folium.operators import graded as W
from folium.operators import grids as T
from folium.operators import layout as L
from folium.operators import policies as P
from folium.operators import schedule as S
from folium.operators import segment as G
from folium.operators import syllabus as Y
from folium.registry import literal, query, table
from folium.sources.io import settled, spread


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lines(table(spark, sf_dir, "documents"))


def term(name: str, year: int):
    return F.struct(F.lit(name).alias("name"), F.lit(year).alias("year"))


def written(spark: SparkSession, sf_dir: str, texts: list[str], source: str = "part", key: str = "p_partkey") -> DataFrame:
    """A table's rows as documents (doc_id, kind, text): the text that the key picks, with the key in it."""
    n = len(texts)
    kind = (F.col(key) % n).cast("int")
    text = F.replace(F.get(F.array(*[F.lit(t) for t in texts]), kind), F.lit("{k}"), F.col(key).cast("string"))
    return spread(table(spark, sf_dir, source).select(key), key).select(F.col(key).alias("doc_id"), kind.alias("kind"), text.alias("text"))


def expected(rows: list[tuple], columns: dict[str, str], n: int, source: str = "part", key: str = "p_partkey") -> str:
    """SQL of what each document must give: rows of (kind, values ..)."""
    cases = "\nUNION ALL ".join(f"SELECT k, {', '.join(f'{literal(v)}::{t} AS {c}' for v, (c, t) in zip(r[1:], columns.items(), strict=True))} FROM d WHERE k % {n} = {r[0]}" for r in rows)
    return f"WITH d AS (SELECT {key} AS k FROM {source})\n{cases}"


TEXT, INT, LONG, REAL, DATE = "VARCHAR", "INTEGER", "BIGINT", "DOUBLE", "DATE"


@query()
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT1-EXT5: lines that some shape fits, with their fields."""
    short = _lines(spark, sf_dir).where(F.length("line").between(8, 400) & ~C.looks_like_prose(F.col("line")))
    got = short.select("doc_id", "idx", C.parse_citation(F.col("line")).alias("c")).where("c is not null").select("doc_id", "idx", "c.*")
    return got.withColumn("signature", C.signature(C.parse_authors(F.coalesce("authors", F.lit(""))), F.col("year"), F.col("title")))


@query(r"""
WITH l AS (SELECT doc_id, i - 1 AS idx, lines[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i))
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '\b(19|20)[0-9]{2}\b')) AS dated, count(*) FILTER (WHERE regexp_matches(line, 'https?://')) AS linked,
  count(*) FILTER (WHERE regexp_matches(line, '(?i)^\s*(?:[A-Z][\w ()/''-]{0,60}:\s*)?(?:tbd|tba|to be (?:announced|determined))\s*\.?\s*$')) AS placeholders FROM l GROUP BY doc_id
""")
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, EXT6: by document, what its lines hold."""
    x = F.col("line")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(x.rlike(r"\b(?:19|20)[0-9]{2}\b")).alias("dated"), F.count_if(x.rlike("https?://")).alias("linked"), F.count_if(C.is_placeholder(x)).alias("placeholders"))


# ---- graded work: a document for each shape of a weight

GRADED = [
    "Quizzes            40%\nEssay {k}            60%  due October 3 at 5 pm",
    "Quizzes 30%\nFinal paper {k}\n70%\nTotal 100%",
    "65% - Practice Sets {k}\n- 35% participation\n94% or greater",
    "Lab Work {k} (40% total, as divided below): Part One (20%): x. Part Two (20%): y. Final Exam (60%): due December 9.",
    "Essays 100%\n\nExtra credit 5% for attending each week a talk on {k}",
    "Policy Memo {k} (50%): maximum five (5) pages, due 9/12.\n\nExams (15% each; 30% total)\n\nReading Journal (20%): submit every week on Fridays, up to 1,500 words.",
    "Grading Scheme:      Reports {k}            45%\nThe final exam for this course is worth a lot 55%\nField Notes 55%",
]
GRADED_ROWS = [
    (0, "Quizzes", "other", 40.0, None, None, None, None, None, 0.65), (0, "Essay {k}", "essay", 60.0, "2030-10-03", "17:00:00", None, None, None, 0.8),
    (1, "Quizzes", "other", 30.0, None, None, None, None, None, 0.65), (1, "Final paper {k}", "exam", 70.0, None, None, None, None, None, 0.65),
    (2, "Practice Sets {k}", "other", 65.0, None, None, None, None, None, 0.65), (2, "participation", "other", 35.0, None, None, None, None, None, 0.65),
    (3, "Lab Work {k}", "other", 40.0, None, None, None, None, None, 0.65), (3, "Final Exam", "exam", 60.0, "2030-12-09", None, None, None, None, 0.8),
    (4, "Essays", "other", 100.0, None, None, None, None, None, 0.65), (4, "Extra credit", "other", 5.0, None, None, "weekly", None, None, 0.8),
    (5, "Policy Memo {k}", "essay", 50.0, "2030-09-12", None, None, 5, None, 0.95), (5, "Exams", "other", 30.0, None, None, None, None, None, 0.65), (5, "Reading Journal", "other", 20.0, None, None, "weekly on friday", None, 1500, 0.8),
    (6, "Reports {k}", "report", 45.0, None, None, None, None, None, 0.65), (6, "Field Notes", "other", 55.0, None, None, None, None, None, 0.65),
]


def _zoned(docs: DataFrame, zone: str) -> DataFrame:
    return G.lines(docs).withColumn("zone", F.lit(zone)).withColumn("zone_id", F.lit(0)).withColumn("term", term("fall", 2030))


@query(expected(GRADED_ROWS, {"title": TEXT, "kind": TEXT, "weight": REAL, "due_date": DATE, "due_time": TEXT, "recurrence": TEXT, "page_limit": INT, "word_limit": INT, "confidence": REAL}, len(GRADED)))
def graded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT12-EXT15, AGG5-AGG7, JOIN14: graded work in every shape."""
    got = W.extract(_zoned(written(spark, sf_dir, GRADED), "requirements"))
    return got.select(F.col("doc_id").alias("k"), "title", "kind", "weight", "due_date", "due_time", "recurrence", "page_limit", "word_limit", "confidence")


HINTS = ["Due: Essay {k} due 10/3 at 11:59 pm", "EXAM {k} IN CLASS", "Week 3: Quiz {k}", "assessment {k} due at 11:59 pm", "Final: due 12/10", "sign-up: {k} slots"]


@query(expected([(0, "Essay {k}", "essay", "2030-10-03", "23:59:00"), (1, "EXAM {k} IN CLASS", "exam", "2030-09-16", None), (2, "Quiz {k}", "exam", "2030-09-16", None), (3, "assessment {k}", "weekly_assessment", "2030-09-16", "23:59:00"), (4, "Final", "exam", "2030-12-10", None), (5, "{k} slots", "signup", "2030-09-16", None)], {"title": TEXT, "kind": TEXT, "due_date": DATE, "due_time": TEXT}, len(HINTS)))
def hinted_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT14: lines of the schedule that name work."""
    hints = written(spark, sf_dir, HINTS).select(F.col("doc_id").alias("k"), F.col("text").alias("hint"), F.lit("2030-09-16").cast("date").alias("session_date"), term("fall", 2030).alias("term"))
    return W.from_hints(hints).select("k", "title", "kind", "due_date", "due_time")


MERGES = [
    [("Research Paper (final) {k}", 30.0, None), ("Research paper {k}", None, "2030-05-01"), ("Quiz", 10.0, None)],
    [("MECR and Aid Reports {k}", 20.0, None), ("Control Regime MECR and Aid for {k}", 20.0, "2030-05-02")],
    [("Policy Memos", 30.0, None), ("Policy Report", 30.0, None)],
    [("Midterm Exam", 30.0, None), ("Final Exam", 30.0, None)],
]


@query(expected([(0, "Research Paper (final) {k}", 30.0, "2030-05-01", 2), (0, "Quiz", 10.0, None, 1), (1, "Control Regime MECR and Aid for {k}", 20.0, "2030-05-02", 2), (2, "Policy Memos", 30.0, None, 1), (2, "Policy Report", 30.0, None, 1), (3, "Midterm Exam", 30.0, None, 1), (3, "Final Exam", 30.0, None, 1)], {"title": TEXT, "weight": REAL, "due_date": DATE, "merged": LONG}, len(MERGES)))
def merged_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: the same work named twice."""
    items = F.array(*[F.array(*[F.struct(F.lit(t).alias("title"), F.lit(w).cast("double").alias("weight"), F.lit(d).cast("date").alias("due_date")) for t, w, d in case]) for case in MERGES])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.get(items, (F.col("p_partkey") % len(MERGES)).cast("int"))).alias("ordinal", "i"))
    none = lambda t: F.lit(None).cast(t)
    rows = rows.select("doc_id", "ordinal", F.replace("i.title", F.lit("{k}"), F.col("doc_id").cast("string")).alias("title"), F.lit("other").alias("kind"), "i.weight", "i.due_date", none("string").alias("due_time"), none("string").alias("recurrence"), none("int").alias("page_limit"), none("int").alias("word_limit"), F.lit("").alias("requirements_text"), F.lit(0.8).alias("confidence"))
    return W.merge_same(rows).select(F.col("doc_id").alias("k"), "title", "weight", "due_date", F.col("merged").cast("long").alias("merged"))


# ---- policies

POLICIES = [
    "Use of AI\nGenerative AI must not be used for any work in course {k}.\n\nLate Work\nLate work loses ten percent a day, without exception, in {k}.",
    "Attendance\nMore than three absences without a note lower the grade in {k}.\n\nAttendance again\nMore than three absences without a note lower the grade in {k}.",
    "Notes\nBring the book to every meeting of the course number {k} please.",
]


@query(expected([(0, "ai_use", "Use of AI", "prohibited", 1.0), (0, "late_work", "Late Work", None, 1.0), (1, "attendance", "Attendance", None, 1.0), (1, "ai_use", None, "unstated", 0.5), (2, "ai_use", None, "unstated", 0.5)], {"policy_type": TEXT, "heading": TEXT, "ai_stance": TEXT, "confidence": REAL}, len(POLICIES)))
def policy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG22, EXT17, AGG15: typed blocks under headings, repeats dropped, silence on AI stated."""
    rows = _zoned(written(spark, sf_dir, POLICIES), "policies").withColumn("starts_block", F.col("line").rlike("^(?:Use|Late W|Attendance|Notes)"))
    return P.extract(rows).select(F.col("doc_id").alias("k"), "policy_type", "heading", "ai_stance", "confidence")


# ---- schedules in three layouts

LAYOUTS = [
    "Week 1 (1/13): Introduction to part {k}\nWeek 2 (1/20): Trade\n• Doe, J. 2001. “A study of {k}.” Journal of\nThings 12 (3): 45–67.\n• NRC Ch 3 & 4\nWeek 3 (1/27): Review\nLearning objectives:\n• Know {k}\nReadings:\n• Levin, Steve, and Dan Zib. 2018. How Rules Die. Crown.\nQuiz 1 in class\n• Poe, Ann. 2007. The third book. Boston: Big Press.",
    "Week 1: January 15\nTopic: Opening {k}\nReadings:\nDoe, Jane. 2005. The long book. Boston: Big Press.\nRoe, R. 2006. The other book. Boston: Big\nPress.\nWeek 2: January 22\nTopic: Power\nReview (Inspectional Reading):\nPoe, Ann. 2007. The third book. Boston: Big Press.\nDue: Essay {k}\nSpring break January 29 no class\nWeek 4: February 5\nTopic: End\nGoals:\nKnow things",
    "",
]
GRID = [
    ["Week", "Date", "Topic", "Readings"], ["1", "1/8", "Orientation {k}", ""], ["2", "1/15", "Trade", "NRC Ch 1\n\nDoe, Jane. 2005. The long book. Boston: Big Press."],
    ["", "1/17", "Aid", "T: Roe, R. 2006. The other book. Boston: Big Press.\nTR: Poe, Ann. 2007. The third book. Boston: Big Press."], ["", "", "", "Lee, Ann. 2008. The fourth book. Boston: Big Press."],
]
SESSIONS = [
    (0, "bulleted", 1, 1, "2030-01-13", None, "Introduction to part {k}", 0, "no_reading"), (0, "bulleted", 2, 2, "2030-01-20", None, "Trade", 2, "reading"), (0, "bulleted", 3, 3, "2030-01-27", None, "Review", 2, "reading"),
    (1, "labelled", 1, 1, "2030-01-15", None, "Opening {k}", 2, "reading"), (1, "labelled", 2, 2, "2030-01-22", None, "Power", 1, "reading"), (1, "labelled", 3, None, "2030-01-29", None, "Spring break January 29 no class", 0, "holiday"), (1, "labelled", 4, 4, "2030-02-05", None, "End", 0, "no_reading"),
    (2, "table", 1, 1, "2030-01-08", None, "Orientation {k}", 0, "no_reading"), (2, "table", 2, 2, "2030-01-15", None, "Trade", 2, "reading"), (2, "table", 3, 2, "2030-01-17", "T", "Aid", 1, "reading"), (2, "table", 4, 2, "2030-01-17", "TR", "Aid", 2, "reading"),
]


def _schedules(spark: SparkSession, sf_dir: str):
    docs = written(spark, sf_dir, LAYOUTS)
    rows = G.lines(docs.where("kind < 2")).withColumn("term", term("spring", 2030))
    cells = F.array(*[F.array(*[F.replace(F.lit(c), F.lit("{k}"), F.col("doc_id").cast("string")) for c in r]) for r in GRID])
    grids = docs.where("kind = 2").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("grid"), cells.alias("rows"), term("spring", 2030).alias("term"))
    return S.parse(rows, grids)


@query(expected(SESSIONS, {"structure": TEXT, "session": LONG, "week": INT, "meeting_date": DATE, "sub_label": TEXT, "topic": TEXT, "readings": LONG, "session_type": TEXT}, len(LAYOUTS)))
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG9-SEG17, SEG20, SEG21: three layouts, each read by the parser that resolves most of it."""
    best, sessions, _, _ = _schedules(spark, sf_dir)
    return sessions.join(best, "doc_id").select(F.col("doc_id").alias("k"), "structure", F.col("session").cast("long").alias("session"), "week", "meeting_date", "sub_label", "topic", F.col("readings").cast("long").alias("readings"), "session_type")


READINGS = [
    (0, 2, 0, "required", "author_date_journal", "45-67"), (0, 2, 1, "required", "author_short_chapter", None), (0, 3, 0, "required", "author_date_book", None), (0, 3, 1, "required", "author_date_book", None),
    (1, 1, 0, "required", "author_date_book", None), (1, 1, 1, "required", "author_date_book", None), (1, 2, 0, "inspectional", "author_date_book", None),
    (2, 2, 0, "required", "author_short_chapter", None), (2, 2, 1, "required", "author_date_book", None), (2, 3, 0, "required", "author_date_book", None), (2, 4, 0, "required", "author_date_book", None), (2, 4, 1, "required", "author_date_book", None),
]


@query(expected(READINGS, {"session": LONG, "ordinal": LONG, "requirement_level": TEXT, "matched_pattern": TEXT, "page_range": TEXT}, len(LAYOUTS)))
def schedule_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT7, EXT9, EXT10, SEG15: the readings of the three layouts."""
    _, _, found, _ = _schedules(spark, sf_dir)
    return found.select(F.col("doc_id").alias("k"), F.col("session").cast("long").alias("session"), F.col("ordinal").cast("long").alias("ordinal"), "requirement_level", F.col("c.matched_pattern").alias("matched_pattern"), "page_range")


ENTRIES = [
    "Doe, J. 2001. “A study of {k}.” Journal of Things 12: 4-9. Content warning: war", "Poe, Ann. 2007. The third book {k}. Boston: Big Press. PDF on the course site", "Required Suggested", "TBD", "Syllabus review, no reading", "Human Security",
    "Roe, R. 2006. The other book {k}. Boston: Big Press. pp. 12-30", "mode/2up",
]


@query(expected([(0, "4-9", None, "war"), (1, None, "PDF on the course site", None), (6, "12-30", None, None)], {"page_range": TEXT, "access_note": TEXT, "content_warning": TEXT}, len(ENTRIES)))
def built_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT7: entries that are readings, with what stands beside them; the others are none."""
    rows = written(spark, sf_dir, ENTRIES).select("doc_id", F.lit(1).alias("session"), F.lit(0).alias("entry"), F.col("text").alias("raw"), F.lit(None).cast("string").alias("level"), F.lit(False).alias("appended"))
    return S.readings(rows).select(F.col("doc_id").alias("k"), "page_range", "access_note", "content_warning")


@query()
def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG8, SEG9 over conversations read as schedules: a turn is a week, its lines are entries. Lines come from turns; no conversation is joined."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.concat(F.array(F.concat(F.lit("Week "), F.col("turn") + 1)), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.concat(F.lit("- "), t)))).alias("row", "line"))
    rows = turns.select("doc_id", (F.col("turn").cast("long") * 100_000 + F.col("row")).alias("idx"), "line", F.lit(False).alias("starts_block"), term("fall", 2030).alias("term"))
    sessions, entries, _ = S.bulleted(rows)
    return entries.join(sessions.select("doc_id", "session", "week"), ["doc_id", "session"]).select("doc_id", "session", "week", "entry", "raw")


# ---- zones, front matter, whole syllabi

SYLLABUS = (
    "POLS 4101: Theory of Rule {k}\nFALL 2030\nInstructor: Dr. Ida Berg\n\nCourse Requirements\nQuizzes            40%\nEssay {k}            60%\n\nAcademic Honesty Rules\nThe use of ChatGPT is not allowed in this course in any form.\n\n"
    "Important Dates\nSeptember 2: Drop day {k}\n\nCourse Schedule\nWeek 1 (9/3): Opening\n• Doe, Jane. 2005. The long book {k}. Boston: Big Press.\nWeek 2 (9/10): Trade\n• NRC Ch 3 & 4\n• Poe, Ann. 2007. The third book. Boston: Big Press.\nWeek 3 (9/17): End\n• NRC Ch 5"
)
ARTICLE = "A Study of Things {k}\nAbstract\nWe study things. doi 10.1234/x{k}\nReferences\nDoe, Jane. 2005. The long book. Boston: Big Press."
WHOLE = [SYLLABUS, ARTICLE, SYLLABUS.replace("FALL 2030", "Term to come").replace("Quizzes            40%\n", "")]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, WHOLE).select("doc_id", F.lit(1).alias("page"), F.array("text").alias("blocks"), F.concat(F.lit("file"), "doc_id", F.lit(".pdf")).alias("filename"))


META = (0, "POLS 4101", "Theory of Rule {k}", "fall", 2030, "Dr. Ida Berg", "bulleted", 3, 3, 4, 4, 100.0, "ok", "prohibited")
LESS = (2, "POLS 4101", "Theory of Rule {k}", None, None, "Dr. Ida Berg", "bulleted", 3, 0, 4, 4, 60.0, "under", "prohibited")


@query(expected([META, LESS], {"code": TEXT, "title": TEXT, "term_name": TEXT, "term_year": INT, "instructor": TEXT, "structure": TEXT, "sessions": LONG, "dated": LONG, "readings": LONG, "cited": LONG, "weight_total": REAL, "weights": TEXT, "ai_stance": TEXT}, len(WHOLE)))
def syllabi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV17, SRV18, SEG1-SEG7, EXT11: whole documents parsed; what is no syllabus is sorted out."""
    rows = Y.summary(Y.parse_documents(_pages(spark, sf_dir)))
    return rows.withColumnRenamed("doc_id", "k")


@query("""
SELECT count(*) FILTER (WHERE p_partkey % 3 <> 1) AS syllabi, count(*) FILTER (WHERE p_partkey % 3 <> 1) AS coded, count(*) FILTER (WHERE p_partkey % 3 = 0) AS termed, count(*) FILTER (WHERE p_partkey % 3 <> 1) AS scheduled,
  4 * count(*) FILTER (WHERE p_partkey % 3 <> 1) AS readings, 4 * count(*) FILTER (WHERE p_partkey % 3 <> 1) AS cited, count(*) FILTER (WHERE p_partkey % 3 = 0) AS near_hundred, count(*) FILTER (WHERE p_partkey % 3 <> 1) AS weighed FROM part
""")
def corpus_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9: what the parse found over all documents."""
    return Y.accuracy(Y.summary(Y.parse_documents(_pages(spark, sf_dir))))


@query(expected([(0, "deliverable", 2), (0, "work", 2), (2, "course", 1), (2, "deliverable", 1), (2, "work", 2)], {"entity": TEXT, "n": LONG}, len(WHOLE)))
def parse_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9, SET1: what a person should look at."""
    r = Y.review(Y.parse_documents(_pages(spark, sf_dir)))
    return r.groupBy(F.col("doc_id").alias("k"), "entity").agg(F.count("*").alias("n"))


@query(expected([(0, "POLS 4101", 3, 2, 1), (2, "POLS 4101", 3, 1, 1)], {"code": TEXT, "sessions": LONG, "work": LONG, "policies": LONG}, len(WHOLE)))
def parsed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13, PRJ5: each parse as JSON, read again."""
    j = Y.as_json(Y.parse_documents(_pages(spark, sf_dir)))
    size = lambda name: F.json_array_length(F.get_json_object("value", f"$.{name}")).cast("long")
    return j.select(F.col("doc_id").alias("k"), F.get_json_object("value", "$.course.code").alias("code"), size("sessions").alias("sessions"), size("deliverables").alias("work"), size("policies").alias("policies"))


@query(expected([(0, 0, "front_matter", 4), (0, 1, "requirements", 4), (0, 2, "policies", 6), (0, 3, "schedule", 8), (1, 0, "front_matter", 5), (2, 0, "front_matter", 4), (2, 1, "requirements", 3), (2, 2, "policies", 6), (2, 3, "schedule", 8)], {"zone_id": LONG, "zone": TEXT, "lines": LONG}, len(WHOLE)))
def zones_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1-SEG7: a document's zones."""
    z = G.zones(G.flatten(_pages(spark, sf_dir)))
    return z.groupBy(F.col("doc_id").alias("k"), F.col("zone_id").cast("long").alias("zone_id"), "zone").agg(F.count("*").alias("lines"))


STARTS = [
    "Intro\nWeek 5 Assignment is due\nmore\nWeek 1 a\nWeek 2 b\nWeek 3 c", "Course Schedule\nsome words\n1/9 topic\nx\n1/16 topic", "A blurb\nNotes\n8/18 first\n8/20 second", "Words\nJan 13: a\nJan 20: b\nJan 27: c", "nothing to see {k}", "Course Schedule\nWhat to do\nWeek 1 a\nWeek 2 b",
]


@query(expected([(0, 3), (1, 0), (2, 2), (3, 1), (4, None), (5, 0)], {"start": LONG}, len(STARTS)))
def schedule_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG4, SEG5, SEG6: where the schedule begins."""
    return G.schedule_starts(G.lines(written(spark, sf_dir, STARTS))).select(F.col("doc_id").alias("k"), F.col("start").cast("long").alias("start"))


@query("""
SELECT c_custkey, 'Prof. ' || c_name AS instructor, 'c' || c_custkey || '@example.org' AS email, 'Room ' || c_nationkey AS location, 'ECON ' || (100 + c_nationkey) AS code FROM customer
""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG25, EXT11: front matter written from customers and read back."""
    text = F.concat(
        F.lit("FALL 2030\nECON"), F.col("c_nationkey") + 100, F.lit(": Markets\nInstructor: Prof. "), "c_name", F.lit("\nE-mail:\nc"), F.col("c_custkey"),
        F.lit("@example.org\nRoom: Room "), F.col("c_nationkey"), F.lit("\nTime:\nOffice: none"),
    )
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    values = M.labelled_values(G.lines(docs)).groupBy("doc_id").pivot("label", ["instructor", "email", "location"]).agg(F.first("value"))
    return docs.select("doc_id", M.course_code(F.col("text")).alias("code")).join(values, "doc_id").select(F.col("doc_id").alias("c_custkey"), "instructor", "email", "location", "code")


IMPORTANT = [
    "Intro\nImportant Dates\nMarch 7: Drop day {k}\nMarch 10 - 14\nBreak {k}", "Key dates:\nApril 2nd - 5th\nExams {k}\nMay 1: Grades", "Notable Dates\nJune 3\n\nStart {k}", "No such block\nMarch 7: Drop day {k}",
]


@query(expected([(0, "Drop day {k}", "2030-03-07", None), (0, "Break {k}", "2030-03-10", "2030-03-14"), (1, "Exams {k}", "2030-04-02", "2030-04-05"), (1, "Grades", "2030-05-01", None), (2, "Start {k}", "2030-06-03", None)], {"label": TEXT, "start_date": DATE, "end_date": DATE}, len(IMPORTANT)))
def important_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT7: dates to know, with ranges and labels on the next line."""
    rows = G.lines(written(spark, sf_dir, IMPORTANT)).withColumn("term", term("spring", 2030))
    return M.important_dates(rows).select(F.col("doc_id").alias("k"), "label", "start_date", "end_date")


@query("""
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'fall' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' END AS name, CASE p_partkey % 4 WHEN 0 THEN 2030 WHEN 1 THEN 2026 WHEN 2 THEN 2016 END::INTEGER AS year FROM part
""")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT2: a term by the first pages, else by the file's name, else by the whole text."""
    k = F.col("p_partkey")
    pick = lambda a, b: F.when(k % 4 == a, b).otherwise("words")
    pages = F.array(*[F.struct(F.lit(n).alias("page"), t.alias("text")) for n, t in ((1, pick(0, "Fall 2030")), (2, F.lit("x")), (5, F.when(k % 4 < 3, "Summer 2016").otherwise("none")))])
    name = F.when(k % 4 == 1, F.concat(F.lit("HIST_Ashe_Spring2026_"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("file"), k))
    rows = table(spark, sf_dir, "part").select(k.alias("doc_id"), name.alias("filename"), F.explode(pages).alias("p")).select("doc_id", "filename", "p.*")
    return D.terms_of(rows).select(F.col("doc_id").alias("k"), "term.name", "term.year")


@query()
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT1 on the documents, whatever names a term."""
    t = D.find_term(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.name", "t.year")


@query(r"""
SELECT o_orderkey, 'Nation' || chr(97 + c_nationkey) || ', C' AS authors, year(o_orderdate)::INTEGER AS year, 'Orders of ' || lower(c_mktsegment) AS title, 'Journal of Trade' AS container, (o_orderkey % 60 + 1)::VARCHAR AS volume, (o_orderkey % 4 + 1)::VARCHAR AS issue,
  (o_orderkey % 300 + 1) || '-' || (o_orderkey % 300 + 20) AS pages, 'author_date_journal' AS matched_pattern, 0.95 AS confidence, 'nation' || chr(97 + c_nationkey) || '|' || year(o_orderdate) || '|orders of ' || lower(c_mktsegment) AS signature
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT1-EXT5: references written from orders, and read back into fields."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("Nation"), F.char(F.col("c_nationkey") + 97), F.lit(", C. "), F.year("o_orderdate"), F.lit(". “Orders of "), F.lower("c_mktsegment"), F.lit(".” Journal of Trade "), k % 60 + 1, F.lit(" ("), k % 4 + 1, F.lit("): "), k % 300 + 1, F.lit("–"), k % 300 + 20, F.lit("."))
    got = o.select("o_orderkey", C.parse_citation(raw).alias("c")).select("o_orderkey", *[f"c.{f}" for f in ("authors", "year", "title", "container", "volume", "issue", "pages", "matched_pattern", "confidence")])
    return got.withColumn("signature", C.signature(C.parse_authors(F.col("authors")), F.col("year"), F.col("title")))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(rf"""
SELECT doc_id, CASE WHEN NOT regexp_matches(text, {_sql(P.AI_TERMS)}) THEN 'unstated' WHEN regexp_matches(text, {_sql(P.STANCES["prohibited"])}) THEN 'prohibited' WHEN regexp_matches(text, {_sql(P.STANCES["restricted"])}) THEN 'restricted'
  WHEN regexp_matches(text, {_sql(P.STANCES["permitted"])}) THEN 'permitted' ELSE 'restricted' END AS stance FROM documents WHERE text IS NOT NULL
""")
def ai_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT17."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.ai_stance(F.col("text")).alias("stance"))


@query("""
SELECT o_orderkey, c_custkey, 1.0 AS cover, 0.9 AS confidence FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0
""")
def rescued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT19, EXT20: lines that name a work's words, author and year find it; a wrong year does not."""
    from folium.operators import rescue

    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("ledger of account number "), F.format_string("q%06d", "c_custkey")).alias("title"), F.concat(F.lit("Nation"), F.char(F.col("c_nationkey") + 97)).alias("surname"), (F.col("c_custkey") % 50 + 1950).cast("int").alias("year"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    off = F.when(F.col("o_orderkey") % 3 == 0, 9).otherwise(F.col("o_orderkey") % 3 - 1)
    lines = o.select("o_orderkey", F.concat("surname", F.lit(", C. The "), "title", F.lit(" ("), (F.col("year") + off).cast("string"), F.lit(")")).alias("raw"))
    return rescue.rescues(lines, c, "o_orderkey", "raw", "c_custkey", "title", "surname", "year")


_SEGMENTS = ["building", "machinery", "furniture", "household", "automobile"]
#: Works of customers, several to a title, and lines of parts that name title, author and year of some; both by all pairs.
_LINES = r"""
WITH w AS (SELECT c_custkey, ['survey', lower(c_mktsegment), 'trade', 'number', 'n' || c_custkey % 200 || 'x'] AS words, 'nation' || chr(97 + c_nationkey) AS surname, 1950 + c_custkey % 50 AS y, c_custkey % 7 = 0 AS no FROM customer),
l AS (SELECT p_partkey, ['nation' || chr(97 + (p_partkey % 25)::INT), 'survey', ['building', 'machinery', 'furniture', 'household', 'automobile'][p_size % 5 + 1], 'trade', 'number', 'n' || p_partkey % 200 || 'x', (1950 + p_size)::VARCHAR] AS words,
  'nation' || chr(97 + (p_partkey % 25)::INT) AS surname, 1950 + p_size AS y FROM part),
g AS (SELECT p_partkey, c_custkey, len(list_filter(w.words, lambda x: list_contains(l.words, x)))::DOUBLE / 5 AS cover, w.surname = l.surname AND abs(w.y - l.y) <= 1 AND NOT no AS agrees FROM l, w),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY agrees DESC, cover DESC, c_custkey) AS place FROM g WHERE cover >= 0.9)
"""


def _looked_up(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, p = F.col("c_custkey"), F.col("p_partkey")
    name = lambda n: F.concat(F.lit("Nation"), F.char(n + 97))
    works = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("A survey of "), F.lower("c_mktsegment"), F.lit(" trade: number n"), c % 200, F.lit("x")).alias("title"), F.array(F.struct(name(F.col("c_nationkey")).alias("surname"), F.lit("C.").alias("given"), F.lit(None).cast("string").alias("literal"))).alias("authors"),
        (c % 50 + 1950).cast("int").alias("year"), F.when(c % 7 == 0, "Handbook of Trade").otherwise("Journal of Trade").alias("container"), F.lit("Press").alias("publisher"), (c % 30).cast("string").alias("volume"), F.when(c % 2 == 0, (c % 4).cast("string")).alias("issue"), F.lit("1-9").alias("pages"),
        F.concat(F.lit("10.1234/"), c).alias("doi"), F.lit(None).cast("string").alias("url"), F.when(c % 3 == 0, "monograph").otherwise("journal-article").alias("type"),
    )
    segment = F.get(F.array(*[F.lit(x) for x in _SEGMENTS]), F.col("p_size") % 5)
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(name(p % 25), F.lit(", C. The survey of "), segment, F.lit(" trade, number N"), p % 200, F.lit("x ("), F.col("p_size") + 1950, F.lit(")")).alias("raw"))
    return lines, works


@query(_LINES + "SELECT p_partkey, c_custkey, place, cover, agrees FROM r WHERE place <= 5")
def rescue_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, EXT19, EXT20: the five best works of every line."""
    from folium.operators import rescue

    lines, works = _looked_up(spark, sf_dir)
    return rescue.shortlist(lines, works.withColumn("surname", F.get("authors", 0)["surname"]), "p_partkey", "raw", "c_custkey", "title", "surname", "year", "container")


@query(_LINES + """SELECT p_partkey, c_custkey, 'Nation' || chr(97 + c_nationkey) AS author, 'A survey of ' || lower(c_mktsegment) || ' trade: number n' || c_custkey % 200 || 'x' AS title, (1950 + c_custkey % 50)::INTEGER AS year, '10.1234/' || c_custkey AS doi,
  CASE WHEN c_custkey % 3 = 0 THEN 'book' ELSE 'journal_article' END AS work_type,
  'Nation' || chr(97 + c_nationkey) || ' ' || (1950 + c_custkey % 50) || '. A survey of ' || lower(c_mktsegment) || ' trade: number n' || c_custkey % 200 || 'x. Journal of Trade ' || c_custkey % 30 || CASE WHEN c_custkey % 2 = 0 THEN '.' || c_custkey % 4 ELSE '' END || ': 1-9' AS display,
  'index_lookup' AS matched_pattern, 0.9 AS confidence FROM r JOIN customer USING (c_custkey) WHERE place = 1 AND agrees""")
def rescued_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT19-EXT23: lines looked up, gated, filled and marked in one chain."""
    from folium.operators import rescue

    got = rescue.rescued(*_looked_up(spark, sf_dir), "p_partkey", "raw", "c_custkey")
    return got.select("p_partkey", "c_custkey", F.get("authors", 0)["surname"].alias("author"), "title", "year", "doi", "work_type", "display", "matched_pattern", "confidence")


@query("""
WITH w AS (SELECT s_suppkey, ['report', 'on', 'depot', 'k' || s_suppkey % 40] AS words, 'owner' || s_nationkey AS surname, (1990 + s_suppkey % 20)::INT AS y, 'Port ' || s_suppkey AS publisher, CASE WHEN s_suppkey % 4 > 0 THEN 'v' || s_suppkey END AS volume FROM supplier),
c AS (SELECT c_custkey, ['report', 'on', 'depot', 'k' || c_custkey % 60] AS words, 'owner' || c_nationkey AS surname, CASE WHEN c_custkey % 5 > 0 THEN (1990 + c_custkey % 20)::INT END AS y, CASE WHEN c_custkey % 3 = 0 THEN 'Held' END AS publisher FROM customer),
h AS (SELECT c_custkey, s_suppkey, w.publisher, w.volume, c.y IS NULL OR abs(c.y - w.y) <= 1 AS good, len(list_filter(c.words, lambda x: list_contains(w.words, x)))::DOUBLE / 4 AS share, c.surname = w.surname AS same FROM c, w),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY same DESC, share DESC, s_suppkey) AS place FROM h WHERE share > 0.6),
f AS (SELECT c_custkey, min_by(publisher, place) AS found, (min_by([volume], place))[1] AS volume FROM r WHERE place <= 3 AND good GROUP BY c_custkey)
SELECT c_custkey, coalesce(c.publisher, found) AS publisher, volume, ((c.publisher IS NULL AND found IS NOT NULL)::INT + (volume IS NOT NULL)::INT) AS fills FROM c LEFT JOIN f USING (c_custkey)
""")
def filled_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT21, EXT22: empty fields of citations, from the first plausible of three hits."""
    from folium.operators import rescue

    s, c = F.col("s_suppkey"), F.col("c_custkey")
    works = table(spark, sf_dir, "supplier").select(s.alias("work"), F.concat(F.lit("Report on depot K"), s % 40).alias("title"), F.concat(F.lit("Owner"), "s_nationkey").alias("surname"), (s % 20 + 1990).cast("int").alias("year"), F.concat(F.lit("Port "), s).alias("publisher"), F.when(s % 4 > 0, F.concat(F.lit("v"), s)).alias("volume"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Report, on depot k"), c % 60).alias("title"), F.concat(F.lit("Owner"), "c_nationkey").alias("surname"), F.when(c % 5 > 0, (c % 20 + 1990).cast("int")).alias("year"), F.when(c % 3 == 0, "Held").alias("publisher"), F.lit(None).cast("string").alias("volume"))
    return rescue.looked_up(rows, works, "c_custkey", "work", ["publisher", "volume"]).select("c_custkey", "publisher", "volume", "fills")


@query("""
WITH d AS (SELECT doc_id, n_chars % 3 = 0 AS changed, coalesce(text, '') || CASE WHEN n_chars % 3 = 0 THEN chr(10) || 'one line more' ELSE '' END AS text FROM documents),
l AS (SELECT doc_id, changed, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS place FROM d)
SELECT doc_id, place, line, CASE WHEN changed THEN 2 ELSE 1 END::INTEGER AS run FROM l
""")
def reparsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6, SNK1-SNK3: documents parsed into a store, some of them changed and all put to it again: only those are parsed anew, and their lines replaced."""
    from folium.sources import store
    from folium.sources.io import scratch

    path, changed = scratch(spark, "parses"), F.coalesce(F.col("n_chars") % 3 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    for run, text in ((1, F.col("text")), (2, F.concat("text", F.when(changed, "\none line more").otherwise("")))):
        told = docs.select("doc_id", text.alias("text")).withColumn("file_hash", F.sha2("text", 256))
        store.reparse(told, path, lambda todo: {"lines": todo.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"), F.lit(run).alias("run"))}, "v1")  # noqa: B023
    return store.load(spark, path, "lines")


_BLOCKS = """
WITH b AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 320e0 ELSE 20e0 END + l_quantity / 10 AS x0, CASE WHEN l_linenumber % 2 = 0 THEN 320e0 ELSE 20e0 END + l_quantity / 10 + CASE WHEN l_discount >= 0.095 THEN 520 ELSE 250 END AS x1,
  l_quantity * 10 AS y0, l_quantity * 10 + 12 AS y1, 8 + l_tax * 50 AS size, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber || '. a note' WHEN l_linenumber % 3 = 1 THEN '* another' ELSE 'body ' || l_linenumber END AS text FROM lineitem),
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages, one page an order: two columns, some blocks across both, small print and notes among them."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    x0 = F.when(n % 2 == 0, 320.0).otherwise(20.0) + q / 10
    text = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(". a note"))).when(n % 3 == 1, "* another").otherwise(F.concat(F.lit("body "), n))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), x0.alias("x0"), (x0 + F.when(F.col("l_discount") >= 0.095, 520).otherwise(250)).alias("x1"), (q * 10).alias("y0"), (q * 10 + 12).alias("y1"), (F.col("l_tax") * 50 + 8).alias("size"), text.alias("text"),
    )


@query(_BLOCKS + """
e AS (SELECT doc_id, min(x0) AS l, max(x1) AS r, count(*) AS n FROM b GROUP BY doc_id),
c AS (SELECT b.doc_id, (any_value(l) + any_value(r)) / 2 AS mid, CASE WHEN any_value(n) >= 6 AND count(*) FILTER (WHERE x0 < (l + r) / 2 - 0.04e0 * (r - l) AND x1 > (l + r) / 2 + 0.04e0 * (r - l)) / any_value(n)::DOUBLE <= 0.15
  AND count(*) FILTER (WHERE x1 <= (l + r) / 2 + 0.04e0 * (r - l)) >= 2 AND count(*) FILTER (WHERE x0 >= (l + r) / 2 - 0.04e0 * (r - l)) >= 2 THEN 2 ELSE 1 END AS columns FROM b JOIN e USING (doc_id) GROUP BY b.doc_id)
SELECT doc_id, columns, x0, y0, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN columns = 2 AND (x0 + x1) / 2 >= mid THEN 1 ELSE 0 END, y0, x0) - 1)::INTEGER AS ordinal FROM b JOIN c USING (doc_id)
""")
def blocks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY6, LAY7: pages of one or two columns, and the order in which their blocks are read."""
    from folium.operators import layout as L

    return L.reading_order(_blocks(spark, sf_dir)).select("doc_id", "columns", "x0", "y0", "ordinal")


@query(_BLOCKS + """
m AS (SELECT doc_id, quantile_cont(size, 0.5) AS median, max(y1) AS bottom FROM b GROUP BY doc_id)
SELECT doc_id, x0, y0, text, size < median - 0.4e0 AND y0 >= 0.6e0 * bottom AND text NOT LIKE 'body%' AS is_note FROM b JOIN m USING (doc_id)
""")
def blocks_that_are_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY8: blocks smaller than the page's middle size, low on the page, and begun like a note."""
    from folium.operators import layout as L

    return L.footnotes(_blocks(spark, sf_dir)).select("doc_id", "x0", "y0", "text", "is_note")


# ---- grids from runs and rules


def _run(text: str, x: float, y: float, w: float | None = None) -> tuple:
    return (text, float(x), float(y), float(w if w is not None else 5 * len(text)), 10.0, 10.0)


RULED = [
    _run("Course plan of the whole term in one bar", 5, 5, 290), *[_run(t, 5 + 100 * c, 25 + 20 * r) for r, row in enumerate([["Week", "Topic", "Reading"], ["1", "Trade {k}", "NRC"], ["2", "Aid", "Doe"]]) for c, t in enumerate(row)],
]
RULES = [*[(0.0, 20.0 * r, 300.0, 20.0 * r) for r in range(5)], *[(100.0 * c, 0.0, 100.0 * c, 80.0) for c in range(4)], (302.0, 0.0, 302.0, 80.0), (5.0, 48.0, 40.0, 48.0)]
UNRULED = [r for w in range(1, 5) for r in (_run(f"Week {w}", 10, 60 * w), _run(f"topic {w}", 200, 60 * w + 14), _run("more {k}", 200, 60 * w + 28))]
GATED = [r for i, row in enumerate([["Date", "Topic", "Readings"], *[[f"1/{d}", f"Topic {d}", f"NRC Ch {d}"] for d in range(1, 6)]]) for r in (_run(row[0], 10, 20 * i), _run(row[1], 120, 20 * i), _run(row[2], 260, 20 * i))]
PAGES = [RULED, UNRULED, GATED]
GRIDS = [
    [["Week", "Topic", "Reading"], ["1", "Trade {k}", "NRC"], ["2", "Aid", "Doe"]],
    [[f"Week {w}", f"topic {w}\nmore {{k}}"] for w in range(1, 5)],
    [["Date", "Topic", "Readings"], *[[f"1/{d}", f"Topic {d}", f"NRC Ch {d}"] for d in range(1, 6)]],
]


@query(expected([(i, json.dumps(g, separators=(",", ":"))) for i, g in enumerate(GRIDS)], {"rows": TEXT}, len(PAGES)))
def page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL1-TBL8, LAY1, LAY2: ruled, week-marked and header-gated grids from positioned runs."""
    struct = lambda r: F.struct(F.lit(r[0]).alias("text"), *[F.lit(v).alias(n) for v, n in zip(r[1:], ("x", "y", "w", "h", "size"), strict=True)])
    key = F.col("p_partkey")
    pages = F.array(*[F.array(*[struct(r) for r in p]) for p in PAGES])
    parts = spread(table(spark, sf_dir, "part").select(key), "p_partkey")
    runs = parts.select(key.alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.get(pages, (key % len(PAGES)).cast("int"))).alias("run_id", "r")).select("doc_id", "page", "run_id", "r.*")
    runs = runs.withColumn("text", F.replace("text", F.lit("{k}"), F.col("doc_id").cast("string")))
    drawn = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)]) for r in RULES])
    rules = parts.where(key % len(PAGES) == 0).select(key.alias("doc_id"), F.lit(1).alias("page"), F.explode(drawn).alias("r")).select("doc_id", "page", "r.*")
    runs, rules = settled(runs), settled(rules)
    return T.grids(runs, rules, L.visual_lines(runs)).select(F.col("doc_id").alias("k"), F.to_json("rows").alias("rows"))


FOLDS = ["short one {k}\n\n" + "word " * 60 + "\n\nHeading Here\n\n" + "A sentence here. " * 140, "", "one {k}\n\ntwo"]


@query(expected([(0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1), (2, 0, 1)], {"ordinal": LONG, "page": LONG}, len(FOLDS)))
def chunk_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG24: short paragraphs carried, headings alone, long ones parted."""
    got = G.chunks(G.one_page(written(spark, sf_dir, FOLDS)))
    return got.select(F.col("doc_id").alias("k"), F.col("ordinal").cast("long").alias("ordinal"), F.col("page").cast("long").alias("page"))
