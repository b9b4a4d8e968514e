"""Serving queries: joins, windows, grades, deadlines, exports, on the tables that stand in for courses, sessions and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import dates as D
from folium.operators import grades as A
from folium.operators import matching as M
from folium.operators import publish as P
from folium.operators import segment as G
from folium.registry import query, table
from folium.sources import io

TODAY = "1998-06-15"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("due", F.to_date("o_orderdate"))


@query("""
SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines, coalesce(sum(l.l_quantity), 0)::DOUBLE AS quantity, count(l.l_orderkey) > 0 AS present
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey
""")
def readings_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN1, JOIN8: entries with what is held for each, summed before the join."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey", "left").select("o_orderkey", n.alias("n_lines"), F.coalesce("q", F.lit(0.0)).alias("quantity"), (n > 0).alias("present"))


@query("""
SELECT row_number() OVER (ORDER BY (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END) ASC NULLS LAST, c_name, o_orderkey) AS place, o_orderkey, c_name
FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY place LIMIT 500
""")
def all_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN2, SRT2: undated last, then by date and name; the first 500."""
    o = _orders(spark, sf_dir).withColumn("due", F.when(F.col("o_orderstatus") != "P", F.col("due")))
    top = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).orderBy(F.asc_nulls_last("due"), "c_name", "o_orderkey").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("due"), "c_name", "o_orderkey")).cast("long")).select("place", "o_orderkey", "c_name")


@query(f"""
WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS due FROM orders),
p AS (SELECT o_custkey, coalesce(min(due) FILTER (WHERE due >= DATE '{TODAY}'), max(due)) AS pick, count(*) FILTER (WHERE due >= DATE '{TODAY}') > 0 AS ahead FROM d GROUP BY o_custkey)
SELECT d.o_custkey, count(*) AS sessions, min(d.o_orderkey) AS first_key, any_value(pick) AS pick FROM d JOIN p USING (o_custkey)
WHERE CASE WHEN ahead THEN due >= pick AND due < pick + INTERVAL 7 DAY ELSE due = pick END GROUP BY d.o_custkey
""")
def week_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV1: the week from the next meeting on, else the last meeting."""
    d = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "due")
    today = F.lit(TODAY).cast("date")
    nxt = F.min(F.when(F.col("due") >= today, F.col("due")))
    picks = d.groupBy("o_custkey").agg(F.coalesce(nxt, F.max("due")).alias("pick"), nxt.isNotNull().alias("ahead"))
    hit = F.when(F.col("ahead"), (F.col("due") >= F.col("pick")) & (F.col("due") < F.date_add("pick", 7))).otherwise(F.col("due") == F.col("pick"))
    return d.join(picks, "o_custkey").where(hit).groupBy("o_custkey").agg(F.count("*").alias("sessions"), F.min("o_orderkey").alias("first_key"), F.first("pick").alias("pick"))


@query(f"""
SELECT o_orderkey, o_orderdate::DATE AS due FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' OR o_orderdate::DATE BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + INTERVAL 14 DAY
""")
def upcoming_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV2, STR7: recurring always, dated within fourteen days."""
    today = F.lit(TODAY).cast("date")
    recurring = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    return _orders(spark, sf_dir).where(recurring | F.col("due").between(today, F.date_add(today, 14))).select("o_orderkey", "due")


@query(f"""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'handed in' WHEN o_orderdate::DATE < DATE '{TODAY}' THEN 'overdue' WHEN o_orderdate::DATE <= DATE '{TODAY}' + INTERVAL 7 DAY THEN 'this week' ELSE 'later' END AS band,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def deadline_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV6, DAT9."""
    today = F.lit(TODAY).cast("date")
    n = D.days_until(F.col("due"), today)
    band = F.when(F.col("o_orderstatus") == "F", "handed in").when(n < 0, "overdue").when(n <= 7, "this week").otherwise("later")
    return _orders(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
SELECT o_orderkey, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n = -1 THEN 'yesterday' WHEN n < 0 THEN (-n) || ' days ago' WHEN n <= 14 THEN 'in ' || n || ' days'
  ELSE month(due) || '/' || day(due) END AS label FROM (SELECT o_orderkey, o_orderdate::DATE AS due, datediff('day', DATE '{TODAY}', o_orderdate::DATE) AS n FROM orders)
""")
def when_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT9, DAT10."""
    return _orders(spark, sf_dir).select("o_orderkey", D.when_label(F.col("due"), F.lit(TODAY).cast("date")).alias("label"))


@query("""
SELECT o_custkey, array_to_string(list_filter(range(min(m), max(m) + 1), lambda x: NOT list_contains(list(DISTINCT m), x)), ',') AS missing
FROM (SELECT o_custkey, month(o_orderdate) AS m FROM orders) GROUP BY o_custkey
""")
def missing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, SET3."""
    w = _orders(spark, sf_dir).select("o_custkey", F.month("due").alias("m")).groupBy("o_custkey").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.collect_set("m").alias("seen"))
    return w.select("o_custkey", F.array_join(F.transform(F.array_except(F.sequence("a", "b"), "seen"), lambda x: x.cast("string")), ",").alias("missing"))


@query("""
SELECT o_custkey, o_orderkey, before FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL
""")
def duplicate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "due").orderBy("o_orderkey"))
    return _orders(spark, sf_dir).withColumn("before", before).where("before is not null").select("o_custkey", "o_orderkey", "before")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS number, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY date_trunc('week', l_shipdate)) AS week
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
""")
def ledger_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4, WIN6."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    week = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(F.date_trunc("week", "l_shipdate")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("number"), week.cast("long").alias("week"))


@query("""
WITH i AS (SELECT l_orderkey, l_quantity AS w, CASE WHEN l_returnflag <> 'N' THEN 100 - l_discount * 1000 END AS p, l_linestatus = 'F' AND l_tax > 0.06 AS b FROM lineitem WHERE l_quantity > 0),
s AS (SELECT l_orderkey, round(coalesce(sum(w) FILTER (WHERE NOT b), 0), 9) AS t, round(coalesce(sum(w) FILTER (WHERE NOT b AND p IS NOT NULL), 0), 9) AS g, round(coalesce(sum(w * p / 100) FILTER (WHERE NOT b AND p IS NOT NULL), 0), 9) AS e,
  round(coalesce(sum(w) FILTER (WHERE b), 0), 9) AS x, round(coalesce(sum(w * p / 100) FILTER (WHERE b AND p IS NOT NULL), 0), 9) AS xe FROM i GROUP BY l_orderkey),
r AS (SELECT *, greatest(t - g, 0) AS rest FROM s),
h AS (SELECT l_orderkey, floor(t * 100 + 0.5) / 100 AS total_weight, floor(e * 100 + 0.5) / 100 AS earned, floor(rest * 100 + 0.5) / 100 AS remaining, CASE WHEN g > 0 THEN floor(e / g * 100 * 10 + 0.5) / 10 END AS average, floor(x * 100 + 0.5) / 100 AS bonus,
  floor((e + xe) * 10 + 0.5) / 10 AS banked, floor((e + rest + x) * 10 + 0.5) / 10 AS ceiling FROM r),
n AS (SELECT *, CASE WHEN remaining > 0 THEN floor((total_weight * 0.9 - earned) / remaining * 100 * 10 + 0.5) / 10 END AS need FROM h)
SELECT l_orderkey, total_weight, earned, average, bonus, banked, ceiling, CASE WHEN need IS NULL THEN 'graded' WHEN need <= 0 THEN 'secured' WHEN need > 100 THEN 'out of reach' ELSE 'needed' END AS target FROM n
""")
def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10, AGG12, SRV9."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("w"), F.when(F.col("l_returnflag") != "N", 100 - F.col("l_discount") * 1000).alias("p"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)).alias("b"))
    s = A.standing(items, "l_orderkey", "w", "p", "b")
    needed = A.needed_for(F.col("total_weight") * 0.9, F.col("earned"), F.col("remaining"))
    return s.select("l_orderkey", "total_weight", "earned", "average", "bonus", "banked", "ceiling", A.target_line(needed).alias("target"))


@query("""
WITH l AS (SELECT o_custkey, CASE WHEN p >= 93 THEN 'A' WHEN p >= 90 THEN 'A-' WHEN p >= 87 THEN 'B+' WHEN p >= 83 THEN 'B' WHEN p >= 80 THEN 'B-' WHEN p >= 77 THEN 'C+' WHEN p >= 73 THEN 'C' WHEN p >= 70 THEN 'C-' WHEN p >= 60 THEN 'D' ELSE 'F' END AS letter,
  1.0 + o_orderkey % 4 AS credits FROM (SELECT *, o_totalprice / 5000 AS p FROM orders)),
g AS (SELECT *, CASE letter WHEN 'A' THEN 4.0 WHEN 'A-' THEN 3.7 WHEN 'B+' THEN 3.3 WHEN 'B' THEN 3.0 WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'C-' THEN 1.7 WHEN 'D' THEN 1.0 ELSE 0.0 END AS points FROM l)
SELECT o_custkey, round(sum(points * credits)::DOUBLE / sum(credits)::DOUBLE, 6) AS gpa, sum(credits)::DOUBLE AS credits FROM g GROUP BY o_custkey
""")
def gpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG12's letters."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", A.letter_for(F.col("o_totalprice") / 5000).alias("letter"), (F.lit(1.0) + F.col("o_orderkey") % 4).alias("credits"))
    return A.gpa(rows, ["o_custkey"], "letter", "credits").withColumn("gpa", F.round("gpa", 6))


@query("""
SELECT l_orderkey, round(sum(l_quantity), 2) AS total, CASE WHEN sum(l_quantity) = 0 THEN 'none' WHEN sum(l_quantity) BETWEEN 99 AND 100.5 THEN 'ok' WHEN sum(l_quantity) < 99 THEN 'under' WHEN sum(l_quantity) <= 110 THEN 'over' ELSE 'far over' END AS verdict
FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_orderkey
""")
def weight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2."""
    s = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"))
    return s.select("l_orderkey", F.round("s", 2).alias("total"), A.weight_verdict(F.col("s")).alias("verdict"))


@query("""
WITH s AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS s, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_returnflag) AS k FROM s WHERE s BETWEEN 99 AND 100.5 AND n > 1) WHERE k = 1)
SELECT l.l_orderkey, count(*) AS kept, sum(l.l_quantity) AS quantity FROM lineitem l LEFT JOIN b ON l.l_orderkey = b.l_orderkey WHERE b.l_returnflag IS NULL OR b.l_returnflag = l.l_returnflag GROUP BY l.l_orderkey
""")
def bullet_level_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5."""
    kept = A.select_level(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", "l_linenumber")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("l_quantity").alias("quantity"))


@query("""
WITH e AS (SELECT * FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, ts AS error_ts, event_id AS error_id FROM events WHERE event_type = 'error')
SELECT e.event_id, r.error_id FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.error_ts
""")
def asof_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN16: each event with its user's last error."""
    ev = table(spark, sf_dir, "events")
    errors = ev.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return M.as_of(ev.where("event_type <> 'error'").select("event_id", "user_id", "ts"), errors, "user_id", "ts", "error_ts", ["error_id"]).select("event_id", "error_id")


@query("""
WITH b AS (SELECT r_regionkey, r_regionkey * 10 AS low, r_regionkey * 10 + 10 AS high FROM region)
SELECT p_partkey, r_regionkey AS band FROM part JOIN b ON p_size >= low AND p_size < high
""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN15."""
    bands = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("band"), (F.col("r_regionkey") * 10).alias("low"), (F.col("r_regionkey") * 10 + 10).alias("high"))
    return M.in_band(table(spark, sf_dir, "part").select("p_partkey", "p_size"), bands, "p_size", "low", "high", 10).select("p_partkey", "band")


@query("""
SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS stem FROM part WHERE p_size = 1) s WHERE length(stem) >= 4 AND starts_with(p.p_name, stem))
""")
def prefix_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN12."""
    part = table(spark, sf_dir, "part")
    stems = part.where("p_size = 1").select(F.get(F.split("p_name", " "), 0).alias("stem"))
    return M.prefix_semi(part, stems, "p_name", "stem").select("p_partkey")


@query("""
WITH s AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (value * 600)::BIGINT AS b FROM events WHERE value IS NOT NULL)
SELECT event_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.event_id < x.event_id AND y.a < x.b AND x.a < y.b)
""")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN14: spans of a user that no earlier span overlaps."""
    a = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    s = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", a.alias("a"), (a + F.rint(F.col("value") * 600).cast("long")).alias("b"))
    return M.without_overlaps(s, "user_id", "a", "b", "event_id", 86_400).select("event_id")


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot, (value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS falls FROM events),
r AS (SELECT *, sum(coalesce(falls, 0)) OVER (PARTITION BY user_id ORDER BY spot) AS run FROM o),
g AS (SELECT user_id, run, count(*) AS length, min(spot) AS start_at, min(value) AS start_value, max(value) AS end_value FROM r GROUP BY ALL)
SELECT user_id, length, start_at, start_value, end_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start_at) AS k FROM g) WHERE k = 1
""")
def ascending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG4, WIN7."""
    return G.longest_run(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "length", F.col("start_at").cast("long").alias("start_at"), "start_value", "end_value")


@query("""
SELECT event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), 0) >= 2 AS followed FROM events
""")
def lookahead_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG5, WIN8."""
    return table(spark, sf_dir, "events").select("event_id", G.followed_by(F.col("event_type") == "error", "user_id", ["ts", "event_id"], 2, 60).alias("followed"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7 in batch."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id
""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max_by("value", at).alias("last_value"))


@query("""
SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:o' || o_orderkey || chr(13) || chr(10) || 'DTSTAMP:19980101T000000Z' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10)
  || 'DTEND;VALUE=DATE:' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || '\\, ' || o_orderstatus || chr(13) || chr(10) || 'END:VEVENT' AS event FROM orders
""")
def calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8."""
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", io.ics_event(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("due"), F.concat_ws(", ", "o_orderpriority", "o_orderstatus"), "19980101T000000Z").alias("event"))


@query("""
SELECT c_custkey AS id, 'C' || c_custkey AS code, c_name AS title, n_name AS instructor_name, 2000 + c_custkey % 3 AS year FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'HOUSEHOLD'
""")
def allowlist_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ2, PRJ4, VOC16: customers as courses: sensitive ones stay out, only the fields that a course may show leave."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    course = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), "c_custkey").alias("code"), F.col("c_name").alias("title"), F.col("n_name").alias("instructor_name"), F.concat(F.lit("c"), "c_custkey", F.lit("@x.org")).alias("instructor_email"), (2000 + F.col("c_custkey") % 3).alias("year"), F.lit("room").alias("location"))
    out = P.pick(course, "course")
    if P.audit(out.schema, set(P.ALLOWED["course"])):
        raise ValueError("a field may not leave")
    return out


@query("""
WITH l AS (SELECT l_orderkey, list(struct_pack(ordinal := l_linenumber, work_id := l_partkey, page_range := l_quantity::INT::VARCHAR) ORDER BY l_linenumber, l_partkey, l_quantity::INT::VARCHAR) AS readings FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_custkey, list(struct_pack(id := o_orderkey, topic := o_orderpriority, readings := coalesce(readings, [])) ORDER BY o_orderkey) AS sessions FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey AS id, to_json(struct_pack(title := c_name, sessions := coalesce(sessions, [])))::VARCHAR AS payload FROM customer LEFT JOIN o ON c_custkey = o_custkey WHERE c_mktsegment <> 'HOUSEHOLD'
""")
def nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV10: customers as courses with their orders as sessions, each with its lines as readings, as nested JSON of allowed fields; sensitive ones stay out.

    A course's sessions meet in one cell, as its payload is one row.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("work_id"), F.col("l_quantity").cast("int").cast("string").alias("page_range"), F.col("l_tax").alias("raw_source_text"))
    entry = F.struct(*[c for c in lines.columns if c in P.ALLOWED["assigned_reading"]])
    readings = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("readings"))
    o = table(spark, sf_dir, "orders").join(readings, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kept = F.coalesce("readings", F.array().cast(readings.schema["readings"].dataType)).alias("readings")
    session = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), kept)
    sessions = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(session)).alias("sessions"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'").join(sessions, F.col("c_custkey") == F.col("o_custkey"), "left")
    held = F.coalesce("sessions", F.array().cast(sessions.schema["sessions"].dataType)).alias("sessions")
    out = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), held)
    if P.audit(out.schema, P.every_name()):
        raise ValueError("a field may not leave")
    return out.select("id", F.to_json(F.struct("title", "sessions")).alias("payload"))


@query("""
WITH p AS (SELECT p_partkey, p_size + 200 AS a, p_size + 200 + p_partkey % 90 AS b FROM part)
SELECT p_partkey, CASE WHEN b >= a THEN b - a + 1 ELSE 0 END::BIGINT + 3 AS pages FROM p
""")
def page_range_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM2: ranges with the upper bound's first digits left out, and a roman one."""
    a, b = F.col("p_size") + 200, F.col("p_size") + 200 + F.col("p_partkey") % 90
    same = F.substring(a.cast("string"), 1, 1) == F.substring(b.cast("string"), 1, 1)
    short = F.when(same, F.substring(b.cast("string"), 2, 9)).otherwise(b.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", D.page_count(F.concat(F.lit("pp. "), a.cast("string"), F.lit("–"), short, F.lit(", iv-vi"))).cast("long").alias("pages"))


@query("""
SELECT p_partkey, (p_size % 12 + 1)::INT AS n, (1000 + p_size)::INT AS m FROM part
""")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM1."""
    word = F.get(F.array(*[F.lit(w) for w in list(D.NUMBER_WORDS)[:12]]), F.col("p_size") % 12)
    return table(spark, sf_dir, "part").select("p_partkey", D.to_int(F.initcap(word)).alias("n"), D.to_int(F.format_number(F.col("p_size") + 1000, 0)).alias("m"))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS named, o_orderdate::DATE AS numeric, lpad(((o_orderkey % 12) + 12)::VARCHAR, 2, '0') || ':30:00' AS clock, dayname(o_orderdate) AS weekday FROM orders
""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT4, DAT5, DAT6: dates, times and weekdays written out and read back."""
    o = _orders(spark, sf_dir)
    term = F.struct(F.lit("fall").alias("name"), F.year("due").alias("year"))
    hour = F.when(F.col("o_orderkey") % 12 == 0, 12).otherwise(F.col("o_orderkey") % 12)
    return o.select(
        "o_orderkey", D.parse_date(F.date_format("due", "'Due' MMMM d"), term).alias("named"), D.parse_date(F.date_format("due", "'by' M/d/yyyy"), term).alias("numeric"),
        D.parse_time(F.concat(F.lit("at "), hour.cast("string"), F.lit(":30 pm"))).alias("clock"), D.parse_weekday(F.date_format("due", "EEEE")).alias("weekday"),
    )


@query("""
SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_key, count(*) > 1 AS duplicated FROM customer GROUP BY ALL
""")
def duplicate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_key"), (F.count("*") > 1).alias("duplicated"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS latest FROM orders) WHERE y = latest
""")
def latest_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: only what is of each key's latest term."""
    o = _orders(spark, sf_dir).withColumn("y", F.year("due"))
    return o.join(o.groupBy("o_custkey").agg(F.max("y").alias("y")), ["o_custkey", "y"], "left_semi").select("o_custkey", "o_orderkey")


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS read, count(*) AS total, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS pages_done, sum(l_quantity)::DOUBLE AS pages FROM lineitem GROUP BY l_orderkey
""")
def progress_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, AGG1."""
    done = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(done).alias("read"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(done, F.col("l_quantity"))), F.lit(0.0)).alias("pages_done"), F.sum("l_quantity").alias("pages"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem) WHERE upto <= 100
""")
def greedy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN6: what fits a budget, in order, stopping at the first overflow."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").withColumn("upto", F.sum("l_quantity").over(w)).where("upto <= 100").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type
""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19's median; its mode is ``event_modes``."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


@query("""
SELECT event_type, user_id AS mode_user, n AS n_events FROM (
  SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id NULLS LAST) AS k FROM (SELECT event_type, user_id, count(user_id) AS n FROM events GROUP BY ALL))
WHERE k = 1
""")
def event_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19's mode: the user with the most events of a type, the smallest of those with as many."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("user_id").alias("n"))
    best = counts.groupBy("event_type").agg(F.min(F.struct((-F.col("n")).alias("less"), "user_id")).alias("b"))
    return best.select("event_type", F.col("b.user_id").alias("mode_user"), (-F.col("b.less")).alias("n_events"))
