"""What is served, over the tables that stand in: customers are courses, orders sessions and graded work, line items readings, parts works, events notes.

The stand-ins are stated once in SQL (``STAND``) and once as DataFrames; each query's SQL goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import matching as M
from folium.operators import serving as V
from folium.registry import query, table

ON = "1998-06-15"
STAND = """
course AS (SELECT c_custkey AS id, 'AB ' || (100 + c_custkey % 700) AS code, c_name AS title, CASE c_custkey % 5 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' WHEN 3 THEN 'fall' END AS term,
  CASE WHEN c_custkey % 11 <> 0 THEN 1996 + c_custkey % 3 END AS year FROM customer),
session AS (SELECT o_orderkey AS id, o_custkey AS course_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 15 + 1 END AS week_number,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS meeting_date FROM orders),
reading AS (SELECT l_orderkey AS session_id, l_linenumber AS ordinal, l_partkey AS work_id, CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'recommended' ELSE 'review' END AS requirement_level,
  '10-' || (9 + l_quantity::INT) AS page_range, l_linestatus = 'F' AS read FROM lineitem),
work AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 5 THEN p_brand END AS surname, CASE WHEN p_size > 3 THEN p_name || '|' || p_brand END AS signature, 'raw ' || p_partkey AS raw FROM part),
document AS (SELECT p_partkey AS id, CASE WHEN p_size < 25 THEN p_partkey END AS work_id FROM part),
deliverable AS (SELECT o_orderkey AS id, o_custkey AS course_id, 'Work ' || o_orderkey AS title, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderdate + INTERVAL 3 DAY)::DATE END AS due_date,
  CASE o_orderkey % 9 WHEN 0 THEN 'weekly' WHEN 5 THEN 'see schedule' END AS recurrence, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4 * 5)::DOUBLE END AS weight_percent, o_orderstatus = 'F' AS done FROM orders),
policy AS (SELECT c_custkey AS course_id, i AS ordinal, CASE (c_custkey + i) % 6 WHEN 0 THEN 'ai_use' WHEN 1 THEN 'boilerplate' WHEN 2 THEN 'late_work' WHEN 3 THEN 'attendance' WHEN 4 THEN 'grading_scale' ELSE 'academic_honesty' END AS policy_type,
  CASE WHEN (c_custkey + i) % 6 = 0 THEN CASE c_custkey % 2 WHEN 0 THEN 'permitted' ELSE 'prohibited' END END AS ai_stance FROM customer, unnest(range(c_custkey % 4 + 1)) AS u(i)),
note AS (SELECT event_id AS id, event_id % 1999 AS work_id, event_type = 'click' AS shareable FROM events)
"""


class Tables:
    """The stand-ins."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from pyspark.sql import Window

        self.get = lambda name: table(spark, sf_dir, name)
        c, o, k = self.get("customer"), self.get("orders"), F.col("c_custkey")
        term = F.when(k % 5 == 0, "winter").when(k % 5 == 1, "spring").when(k % 5 == 2, "summer").when(k % 5 == 3, "fall")
        self.course = c.select(k.alias("id"), F.concat(F.lit("AB "), k % 700 + 100).alias("code"), F.col("c_name").alias("title"), term.alias("term"), F.when(k % 11 != 0, k % 3 + 1996).alias("year"))
        key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        self.session = o.select(key.alias("id"), F.col("o_custkey").alias("course_id"), ordinal.cast("long").alias("ordinal"), F.when(key % 7 != 0, key % 15 + 1).alias("week_number"), F.when(key % 13 != 0, day).alias("meeting_date"))
        level = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "recommended").otherwise("review")
        self.reading = self.get("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("work_id"), level.alias("requirement_level"), F.concat(F.lit("10-"), F.col("l_quantity").cast("int") + 9).alias("page_range"), (F.col("l_linestatus") == "F").alias("read"))
        p = self.get("part")
        self.work = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("surname"), F.when(F.col("p_size") > 3, F.concat_ws("|", "p_name", "p_brand")).alias("signature"), F.concat(F.lit("raw "), "p_partkey").alias("raw"))
        self.document = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 25, F.col("p_partkey")).alias("work_id"))
        recurs = F.when(key % 9 == 0, "weekly").when(key % 9 == 5, "see schedule")
        self.deliverable = o.select(key.alias("id"), F.col("o_custkey").alias("course_id"), F.concat(F.lit("Work "), key).alias("title"), F.when(key % 5 != 0, F.date_add(day, 3)).alias("due_date"), recurs.alias("recurrence"), F.when(key % 4 != 0, (key % 4 * 5).cast("double")).alias("weight_percent"), (F.col("o_orderstatus") == "F").alias("done"))
        rows = c.select(k.alias("course_id"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("ordinal"))
        six = (F.col("course_id") + F.col("ordinal")) % 6
        kind = F.when(six == 0, "ai_use").when(six == 1, "boilerplate").when(six == 2, "late_work").when(six == 3, "attendance").when(six == 4, "grading_scale").otherwise("academic_honesty")
        self.policy = rows.select("course_id", F.col("ordinal").cast("long").alias("ordinal"), kind.alias("policy_type"), F.when(six == 0, F.when(F.col("course_id") % 2 == 0, "permitted").otherwise("prohibited")).alias("ai_stance"))
        e = self.get("events")
        self.note = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 1999).alias("work_id"), (F.col("event_type") == "click").alias("shareable"))


def on():
    return F.lit(ON).cast("date")


def sql(text: str) -> str:
    return f"WITH {STAND}{text}"


@query(sql("""SELECT id, code, ai_stance, row_number() OVER (ORDER BY year DESC NULLS LAST, term ASC NULLS FIRST, code, id) AS place
FROM course LEFT JOIN (SELECT course_id, arg_min(ai_stance, ordinal) AS ai_stance FROM policy WHERE policy_type = 'ai_use' GROUP BY course_id) ON id = course_id QUALIFY place <= 200"""))
def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN3, SRT1: courses with their stance, the latest first; a list of two hundred."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    top = V.with_stance(t.course, t.policy).orderBy(*V.course_order(), "id").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*V.course_order(), "id")).cast("long")).select("id", "code", "ai_stance", "place")


_KEY = "year * 10 + CASE term WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 WHEN 'fall' THEN 3 ELSE 9 END"


@query(sql(f"SELECT id, code FROM course WHERE year IS NULL OR {_KEY} = (SELECT max({_KEY}) FROM course WHERE year IS NOT NULL)"))
def current_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, VOC17: the latest term's courses, and those of no known term."""
    return V.current_term(Tables(spark, sf_dir).course).select("id", "code")


@query(sql("SELECT id, code FROM course WHERE lower(replace(code, ' ', '')) = 'ab123'"))
def course_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7."""
    t = Tables(spark, sf_dir)
    return t.course.where(V.squeezed(F.col("code")) == "ab123").select("id", "code")


_CHOSEN = f"""p AS (SELECT course_id, min(meeting_date) FILTER (WHERE meeting_date >= DATE '{ON}') AS n, max(meeting_date) AS l, min(ordinal) AS f FROM session GROUP BY course_id),
chosen AS (SELECT session.* FROM session JOIN p USING (course_id) WHERE CASE WHEN n IS NOT NULL THEN meeting_date >= n AND meeting_date < n + INTERVAL 7 DAY WHEN l IS NOT NULL THEN meeting_date = l ELSE ordinal = f END)"""


@query(sql(f""", {_CHOSEN}, held AS (SELECT work_id, count(*) AS n FROM document WHERE work_id IS NOT NULL GROUP BY work_id)
SELECT c.course_id, c.id AS session_id, count(r.work_id) AS readings, count(held.n) AS present, count(*) FILTER (WHERE requirement_level = 'required') AS required FROM chosen c JOIN reading r ON r.session_id = c.id
LEFT JOIN held ON held.work_id = r.work_id GROUP BY ALL"""))
def week_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV1, JOIN1, JOIN8: the chosen sessions with their readings and what is held of them."""
    t = Tables(spark, sf_dir)
    r = V.readings_of(V.choose_sessions(t.session, on()), t.reading, t.work, t.document)
    return r.groupBy("course_id", "session_id").agg(F.count("*").alias("readings"), F.count_if("present").alias("present"), F.count_if(F.col("requirement_level") == "required").alias("required"))


@query(sql("SELECT id, course_id FROM session WHERE week_number = 3"))
def week_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV1 for a week that was asked for."""
    return V.choose_sessions(Tables(spark, sf_dir).session, on(), 3).select("id", "course_id")


@query(sql(f""", now AS (SELECT id FROM course WHERE year IS NULL OR {_KEY} = (SELECT max({_KEY}) FROM course WHERE year IS NOT NULL)),
r AS (SELECT s.course_id, r.page_range FROM session s JOIN reading r ON r.session_id = s.id WHERE s.course_id IN (SELECT id FROM now) AND datediff('day', DATE '{ON}', meeting_date) BETWEEN -3 AND 7),
d AS (SELECT course_id FROM deliverable WHERE course_id IN (SELECT id FROM now) AND datediff('day', DATE '{ON}', due_date) BETWEEN -3 AND 7 AND NOT done)
SELECT (SELECT count(*) FROM r) AS readings, (SELECT coalesce(sum(string_split(page_range, '-')[2]::INT - 9), 0)::BIGINT FROM r) AS pages, (SELECT count(*) FROM d) AS due,
  (SELECT count(DISTINCT course_id) FROM (SELECT course_id FROM r UNION ALL SELECT course_id FROM d)) AS courses"""))
def this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV5."""
    t = Tables(spark, sf_dir)
    w = V.this_week(t.course, t.session, t.reading, t.deliverable, on())
    return w.select(*[F.col(c).cast("long").alias(c) for c in w.columns])


@query(sql(f"""SELECT course_id, CASE WHEN done THEN 'Handed in' WHEN due_date IS NULL THEN 'No date found' WHEN due_date < DATE '{ON}' THEN 'Overdue' WHEN due_date <= DATE '{ON}' + INTERVAL 7 DAY THEN 'Next 7 days' ELSE 'Later' END AS band,
  weight_percent IS NOT NULL AS weighted, count(*) AS n FROM deliverable GROUP BY ALL"""))
def deadline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV6: each course's work by band, what has no weight apart."""
    d = Tables(spark, sf_dir).deliverable
    return d.groupBy("course_id", V.band(F.col("due_date"), F.col("done"), on()).alias("band"), F.col("weight_percent").isNotNull().alias("weighted")).agg(F.count("*").alias("n"))


_LEDGER = f"""a AS (SELECT *, count(meeting_date) OVER w >= 3 AND count(meeting_date) OVER w >= 0.8 * count(*) OVER w AS by_date FROM session WINDOW w AS (PARTITION BY course_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY CASE WHEN by_date THEN coalesce(meeting_date, DATE '9999-12-31') END NULLS FIRST, ordinal) AS seq, coalesce(week_number::VARCHAR, 'x' || ordinal) AS grp FROM a),
g AS (SELECT *, min(seq) OVER x AS first_at, datediff('day', DATE '{ON}', min(meeting_date) OVER x) AS days FROM b WINDOW x AS (PARTITION BY course_id, grp)),
k AS (SELECT *, dense_rank() OVER (PARTITION BY course_id ORDER BY first_at) AS week FROM g),
entry AS (SELECT k.course_id, k.week, k.days, r.*, row_number() OVER (PARTITION BY k.course_id ORDER BY first_at, seq, r.ordinal, work_id) AS number FROM reading r JOIN k ON r.session_id = k.id)"""


@query(sql(f", {_LEDGER} SELECT course_id, week, count(*) AS entries, min(number) AS first_number, any_value(days) AS days FROM entry GROUP BY course_id, week"))
def week_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV7, WIN4, WIN6."""
    t = Tables(spark, sf_dir)
    e = V.ledger(t.session, t.reading, on())
    return e.groupBy("course_id", F.col("week").cast("long").alias("week")).agg(F.count("*").alias("entries"), F.min("number").cast("long").alias("first_number"), F.first("days").cast("long").alias("days"))


@query(sql(f""", {_LEDGER} SELECT course_id, count(*) FILTER (WHERE read) AS read, count(*) AS total, coalesce(sum(string_split(page_range, '-')[2]::INT - 9) FILTER (WHERE read), 0)::BIGINT AS pages_done,
  sum(string_split(page_range, '-')[2]::INT - 9)::BIGINT AS pages, count(*) FILTER (WHERE NOT read AND requirement_level = 'required' AND coalesce(days BETWEEN -6 AND 30, false)) AS shown FROM entry GROUP BY course_id"""))
def ledger_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, PRJ8: totals count what the filters hide."""
    t = Tables(spark, sf_dir)
    m = V.meters(V.ledger(t.session, t.reading, on()), V.shown_entries(True, True, True))
    return m.select("course_id", "read", "total", F.col("pages_done").cast("long").alias("pages_done"), F.col("pages").cast("long").alias("pages"), "shown")


@query(sql(f", {_LEDGER} SELECT course_id, arg_min(week, (days, week)) AS week FROM entry WHERE days >= -6 GROUP BY course_id"))
def current_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5."""
    t = Tables(spark, sf_dir)
    return V.current_week(V.ledger(t.session, t.reading, on())).select("course_id", F.col("week").cast("long").alias("week"))


@query(sql(""", m AS (SELECT DISTINCT course_id, week_number, meeting_date FROM session WHERE meeting_date IS NOT NULL)
SELECT id, course_id, week_number FROM (SELECT d.id, d.course_id, m.week_number, row_number() OVER (PARTITION BY d.course_id, m.week_number ORDER BY due_date, d.id) AS n FROM deliverable d JOIN m ON m.course_id = d.course_id AND m.meeting_date = d.due_date) WHERE n <= 8"""))
def week_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN9, SRT7: what is due on a meeting's date, eight a week."""
    t = Tables(spark, sf_dir)
    return V.due_in_week(t.session, t.deliverable, 8).select("id", "course_id", "week_number")


@query(sql(f""", now AS (SELECT id, code FROM course WHERE year IS NULL OR {_KEY} = (SELECT max({_KEY}) FROM course WHERE year IS NOT NULL))
SELECT d.id, code, due_date FROM deliverable d JOIN now ON now.id = course_id WHERE due_date >= DATE '{ON}' AND NOT done ORDER BY due_date, code, d.id LIMIT 2"""))
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT7: the next two."""
    t = Tables(spark, sf_dir)
    return V.next_due(t.course, t.deliverable, on()).select("id", "code", "due_date")


@query(sql(""" SELECT code, d.title, due_date AS date, weight_percent AS weight FROM deliverable d JOIN course c ON c.id = d.course_id WHERE due_date IS NOT NULL
UNION ALL SELECT code, 'Drop day ' || s.id, meeting_date, NULL FROM session s JOIN course c ON c.id = s.course_id WHERE meeting_date IS NOT NULL AND ordinal = 1"""))
def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: dated work and dates to know."""
    t = Tables(spark, sf_dir)
    know = t.session.where("ordinal = 1").select("course_id", F.concat(F.lit(" Drop  day "), "id").alias("label"), F.col("meeting_date").alias("start"))
    return V.dated_deadlines(t.course, t.deliverable, know)


@query(sql(""", x AS (SELECT d.id, code, CASE WHEN due_date IS NOT NULL THEN due_date::VARCHAR WHEN recurrence = 'see schedule' THEN '9998-99-99' ELSE '9999-99-99' END AS sort,
  CASE WHEN due_date IS NOT NULL OR recurrence = 'see schedule' THEN 'dated' WHEN recurrence IS NOT NULL THEN 'recurring' ELSE 'undated' END AS "group"
  FROM deliverable d JOIN course c ON c.id = d.course_id WHERE due_date IS NOT NULL OR recurrence IS NOT NULL OR coalesce(weight_percent, 0) <> 0)
SELECT id, sort, "group" FROM x"""))
def deadlines_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4's keys and groups."""
    t = Tables(spark, sf_dir)
    return V.placed_in_time(t.course, t.deliverable).select("id", "sort", "group")


@query(sql(""", x AS (SELECT d.id, code, due_date, recurrence FROM deliverable d JOIN course c ON c.id = d.course_id WHERE due_date IS NOT NULL OR recurrence IS NOT NULL OR coalesce(weight_percent, 0) <> 0)
SELECT id, code FROM x ORDER BY CASE WHEN due_date IS NOT NULL THEN due_date::VARCHAR WHEN recurrence = 'see schedule' THEN '9998-99-99' ELSE '9999-99-99' END, code, id LIMIT 12"""))
def first_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4: the first twelve."""
    t = Tables(spark, sf_dir)
    return V.placed_in_time(t.course, t.deliverable).orderBy("sort", "code", "id").limit(12).select("id", "code")


@query(sql(""", r AS (SELECT s.course_id, s.id * 100 + r.ordinal AS place, w.id AS work_id, title, surname, coalesce(signature, raw) AS key FROM reading r JOIN session s ON s.id = r.session_id JOIN work w ON w.id = r.work_id),
f AS (SELECT course_id, key, arg_min(struct_pack(work_id := work_id, title := title, surname := surname), (place, work_id)) AS w FROM r GROUP BY course_id, key)
SELECT course_id, w.work_id AS work_id, row_number() OVER (PARTITION BY course_id ORDER BY lower(coalesce(w.surname, w.title, '')), w.title, w.work_id) AS place FROM f"""))
def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, AGG16, SRT5, SRV8."""
    t = Tables(spark, sf_dir)
    r = t.reading.join(t.session.select(F.col("id").alias("session_id"), "course_id"), "session_id").select("course_id", "work_id", (F.col("session_id") * 100 + F.col("ordinal")).alias("place"))
    return V.bibliography(r, t.work).select("course_id", "work_id", F.col("place").cast("long").alias("place"))


@query(sql(""" SELECT course_id, ordinal, policy_type, row_number() OVER (PARTITION BY course_id ORDER BY CASE policy_type WHEN 'ai_use' THEN 0 WHEN 'late_work' THEN 1 WHEN 'attendance' THEN 2 WHEN 'grading_scale' THEN 3 WHEN 'boilerplate' THEN 9 ELSE 5 END, ordinal) AS place FROM policy"""))
def policies_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3, SRV8."""
    return V.policies_in_order(Tables(spark, sf_dir).policy).select("course_id", "ordinal", "policy_type", F.col("place").cast("long").alias("place"))


@query(sql(""" SELECT work_id, arg_min(c.id, (s.id, r.ordinal, c.id)) AS course_id, arg_min(c.code, (s.id, r.ordinal, c.id)) AS code FROM reading r JOIN session s ON s.id = r.session_id JOIN course c ON c.id = s.course_id GROUP BY work_id"""))
def work_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN5."""
    t = Tables(spark, sf_dir)
    return V.course_of_work(t.reading, t.session, t.course)


@query(sql(""", h AS (SELECT DISTINCT course_id, work_id FROM reading r JOIN session s ON s.id = r.session_id) SELECT h.course_id, n.id, h.work_id FROM h JOIN note n ON n.work_id = h.work_id WHERE shareable"""))
def shared_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN13."""
    t = Tables(spark, sf_dir)
    return V.notes_of_course(t.reading, t.session, t.note).select("course_id", "id", "work_id")


@query(sql(""" SELECT work_id, session_id, ordinal FROM (SELECT d.work_id, r.session_id, r.ordinal, row_number() OVER (PARTITION BY d.work_id ORDER BY r.session_id, r.ordinal, r.page_range) AS n FROM reading r JOIN document d ON d.id = r.work_id WHERE d.work_id IS NOT NULL) WHERE n <= 10"""))
def work_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6: the first passages of each work (ten here)."""
    t = Tables(spark, sf_dir)
    chunks = t.reading.select(F.col("work_id").alias("document_id"), F.struct("session_id", "ordinal", "page_range").alias("ordinal"))
    return V.passages(t.document.where("work_id is not null"), chunks, 10).select("work_id", "ordinal.session_id", F.col("ordinal.ordinal").alias("ordinal"))


@query("""
WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE o_custkey END AS work_id, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 END::DOUBLE AS score FROM d WHERE k < 3
""")
def document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7: documents written from orders: by DOI, by title, surname and year, by the title alone; those that name none match nothing."""
    key, k = F.col("o_custkey"), F.col("o_orderkey") % 4
    w = Tables(spark, sf_dir).get("customer").select(F.col("c_custkey").alias("work_id"), F.format_string("ledger account q%06d", "c_custkey").alias("title"), F.array(F.concat(F.lit("Owner"), F.char(F.col("c_nationkey") + 97))).alias("surnames"), (F.col("c_custkey") % 50 + 1950).cast("int").alias("year"), F.format_string("10.1234/q%06d", "c_custkey").alias("doi"))
    o = Tables(spark, sf_dir).get("orders").join(w.select(F.col("work_id").alias("o_custkey"), "surnames", "year"), "o_custkey")
    title = F.format_string("ledger account q%06d", "o_custkey")
    head = F.when(k == 0, F.concat(F.lit("see doi:10.1234/Q"), F.format_string("%06d", key), F.lit("."))).when(k == 1, F.concat_ws(" ", F.lit("The"), title, F.lit("by"), F.get("surnames", 0), F.col("year").cast("string"))).when(k == 2, F.lit("no opening")).otherwise("words without any work")
    name = F.when(k == 2, F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit(".pdf"))).otherwise("scan.pdf")
    docs = o.select("o_orderkey", head.alias("head"), name.alias("filename"))
    return M.match_documents(docs, w, "o_orderkey", "head", "filename").select("o_orderkey", "work_id", "score")


@query("""
WITH d AS (SELECT o_orderkey, lower('see 10.1234/Q' || o_custkey || ')x' || (o_orderkey % 7)) AS head FROM orders), w AS (SELECT c_custkey, '10.1234/q' || c_custkey AS doi FROM customer)
SELECT o_orderkey, min(c_custkey) AS work_id, 1.0::DOUBLE AS score, 'doi found in the document' AS method FROM d JOIN w ON contains(head, doi) GROUP BY o_orderkey
""")
def doi_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7: a DOI is found as part of the text, whatever follows it; of several that stand there (one may begin another) the first work's wins."""
    t = Tables(spark, sf_dir)
    w = t.get("customer").select(F.col("c_custkey").alias("work_id"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("surnames"), F.lit(None).cast("int").alias("year"), F.concat(F.lit("10.1234/Q"), "c_custkey").alias("doi"))
    docs = t.get("orders").select("o_orderkey", F.concat(F.lit("see 10.1234/Q"), "o_custkey", F.lit(")x"), F.col("o_orderkey") % 7).alias("head"))
    return M.match_documents(docs, w, "o_orderkey", "head")


@query("""
WITH w AS (SELECT c_custkey, ['paper', 'n' || c_custkey % 40, 'topic', 'k' || c_custkey % 13] AS words, ['son' || c_custkey % 9] AS names, (1950 + c_custkey % 30)::VARCHAR AS y FROM (SELECT s_suppkey AS c_custkey FROM supplier)),
d AS (SELECT o_orderkey, ['paper', 'n' || o_custkey % 40, 'kind', 'k' || o_orderkey % 13] AS words, 'son' || o_orderkey % 11 AS name, (1950 + o_orderkey % 31)::VARCHAR AS y FROM orders),
s AS (SELECT o_orderkey, c_custkey, 0.6e0 * len(list_filter(list_distinct(w.words), lambda x: list_contains(d.words, x) AND length(x) > 2)) / len(list_filter(list_distinct(w.words), lambda x: length(x) > 2))
  + CASE WHEN list_contains(w.names, d.name) THEN 0.25e0 ELSE 0e0 END + CASE WHEN w.y = d.y THEN 0.15e0 ELSE 0e0 END AS score FROM d, w)
SELECT o_orderkey, c_custkey AS work_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, c_custkey) AS n FROM s WHERE score >= 0.45e0) WHERE n = 1
""")
def scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7: titles of common words, names and years that agree for some works only; the best of all pairs, as comparing each with each would find it."""
    t = Tables(spark, sf_dir)
    c, o, k = F.col("s_suppkey"), F.col("o_custkey"), F.col("o_orderkey")
    w = t.get("supplier").select(c.alias("work_id"), F.concat(F.lit("paper N"), c % 40, F.lit(" topic k"), c % 13).alias("title"), F.array(F.concat(F.lit("Son"), c % 9)).alias("surnames"), (c % 30 + 1950).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"))
    docs = t.get("orders").select("o_orderkey", F.concat(F.lit("A paper, n"), o % 40, F.lit(" (kind K"), k % 13, F.lit(") by SON"), k % 11, F.lit(", "), k % 31 + 1950).alias("head"))
    return M.match_documents(docs, w, "o_orderkey", "head").select("o_orderkey", "work_id", "score")


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'tick ' || (p_partkey % 10) END AS mark FROM part
""")
def carried_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN11, SNK12: a new parse takes over the marks of the old one's rows of the same title, whatever its case."""
    p = Tables(spark, sf_dir).get("part").select(F.lit(1).alias("doc"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("long"), F.col("p_name").alias("title"), "p_size")
    old = p.where("p_size % 2 = 0").select("doc", F.concat(F.lit("  "), F.upper("long")).alias("long"), F.concat(F.lit("tick "), F.col("id") % 10).alias("mark"))
    return M.carry_marks(p, old, "doc", "long", ["mark"]).select("id", "title", "mark")


@query("""
SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 1
""")
def stale_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6: parses of another version, or of none."""
    p = Tables(spark, sf_dir).get("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 1, "v2").when(F.col("p_size") % 3 == 2, "v1").alias("parser_version"))
    return M.stale(p, "v2").select("id")


@query("""
SELECT 'd' || c_custkey % 100 AS identity, CASE WHEN c_custkey % 100 < 50 THEN 'old ' || c_custkey % 100 ELSE min('new ' || c_custkey) END AS title, CASE WHEN c_custkey % 100 < 50 THEN (c_custkey % 100)::INT ELSE 7 END AS year FROM customer GROUP BY c_custkey % 100
""")
def merged_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: known works keep what they have, new ones come in once."""
    c = Tables(spark, sf_dir).get("customer").select((F.col("c_custkey") % 100).alias("n"), "c_custkey")
    old = c.where("n < 50").select("n").distinct().select(F.concat(F.lit("d"), "n").alias("identity"), F.concat(F.lit("old "), "n").alias("title"), F.col("n").cast("int").alias("year"))
    new = c.select(F.concat(F.lit("d"), "n").alias("identity"), F.concat(F.lit("new "), "c_custkey").alias("title"), F.lit(7).alias("year"))
    return M.merge_works(old, new)


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 88.0 ELSE 70.0 END AS mark, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'C-' END AS letter FROM orders
""")
def edited_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15: an edited mark drops the letter that followed from the old one."""
    o = Tables(spark, sf_dir).get("orders").select(F.col("o_orderkey").alias("id"))
    items = o.select("id", F.lit(70.0).alias("mark"), F.lit("C-").alias("letter"))
    edits = o.where("id % 3 = 0").select("id", F.lit("mark").alias("field"), F.lit("88").alias("value"))
    return M.edited(items, edits, "id", ["mark"]).select("id", "mark", "letter")


@query(sql(f"""SELECT course_id, CASE WHEN max(week_number) <= 17 AND len(m) > 0 THEN CASE WHEN len(m) = 1 THEN 'Week ' || m[1] ELSE 'Weeks ' || array_to_string(m[1:len(m) - 1], ', ') || ' and ' || m[len(m)] END END AS missing FROM (
  SELECT course_id, max(week_number) AS week_number, list_filter(range(min(week_number), max(week_number) + 1), lambda x: NOT list_contains(list(DISTINCT week_number) FILTER (WHERE week_number IS NOT NULL), x)) AS m FROM session GROUP BY course_id) GROUP BY course_id, m"""))
def missing_week_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN3: the weeks that a schedule lacks, as a phrase."""
    from folium.operators import frontmatter as H

    s = Tables(spark, sf_dir).session.select(F.col("course_id").alias("doc_id"), F.col("week_number").alias("week"), F.lit("reading").alias("session_type"), F.lit(1).alias("readings"))
    return H.week_checks(s).select(F.col("doc_id").alias("course_id"), "missing")


@query(sql(""" SELECT course_id, id, first_week FROM (SELECT course_id, id, row_number() OVER w AS n, lag(week_number) OVER w AS first_week FROM session WHERE meeting_date IS NOT NULL WINDOW w AS (PARTITION BY course_id, meeting_date ORDER BY id)) WHERE n > 1"""))
def date_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2."""
    from folium.operators import frontmatter as H

    s = Tables(spark, sf_dir).session.select(F.col("course_id").alias("doc_id"), F.col("id").alias("session"), "meeting_date", F.lit(None).cast("string").alias("sub_label"), F.col("week_number").alias("week"))
    return H.date_checks(s).select(F.col("doc_id").alias("course_id"), F.col("session").alias("id"), "first_week")
