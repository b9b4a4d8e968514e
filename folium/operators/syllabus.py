"""The whole parse: pages to zones, front matter, schedule, graded work, policies, review and checks, each stage a table keyed by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import dates as D
from folium.operators import frontmatter as M
from folium.operators import graded as W
from folium.operators import grades as A
from folium.operators import policies as P
from folium.operators import schedule as S
from folium.operators import segment as G
from folium.sources.io import settled

THRESHOLD = 0.75
HEAD_PAGES = 2


@dataclass
class Parse:
    """SRV17's tables. Documents whose kind is no syllabus are in ``kinds`` alone."""

    kinds: DataFrame
    zoned: DataFrame
    meta: DataFrame
    structures: DataFrame
    sessions: DataFrame
    readings: DataFrame
    graded: DataFrame
    policies: DataFrame
    important: DataFrame


def parse_documents(pages: DataFrame, grids: DataFrame | None = None, all_kinds: bool = False) -> Parse:
    """SRV17, SRV18: pages (doc_id, page, blocks array<string>, filename) and grids (doc_id, page, grid, rows) as tables.

    The document's kind (EXT18) decides what goes on; ``all_kinds`` parses every document.
    """
    text = pages.withColumn("text", F.array_join("blocks", "\n"))
    terms = settled(D.terms_of(text))
    lines = settled(G.named(G.flatten(pages)))
    meta = settled(M.course_meta(lines.where(F.col("page") <= HEAD_PAGES), terms))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    six = text.where("page <= 6").groupBy("doc_id").agg(joined.alias("six"), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["page"] <= HEAD_PAGES), lambda p: p["text"]), "\n").alias("head"))
    named = meta.select("doc_id", (F.col("code").isNotNull() & F.col("term").isNotNull()).alias("named"))
    kinds = six.join(named, "doc_id").select("doc_id", M.kind_of(F.col("six"), F.col("head"), F.col("named")).alias("k")).select("doc_id", "k.*")
    kinds = settled(kinds)
    chosen = kinds.select("doc_id") if all_kinds else kinds.where("kind = 'syllabus'").select("doc_id")
    only = lambda d: d.join(chosen, "doc_id", "left_semi")

    zoned = settled(G.zones(only(lines)).join(terms, "doc_id", "left"))
    planned = zoned.where("zone = 'schedule'")
    at = only(grids).join(terms, "doc_id", "left").join(planned.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi") if grids is not None else None
    structures, sessions, readings, hints = S.parse(planned, at)
    dated = hints.join(sessions.select("doc_id", "session", "meeting_date"), ["doc_id", "session"]).join(terms, "doc_id", "left")
    told = dated.select("doc_id", "hint", F.col("meeting_date").alias("session_date"), "term", F.row_number().over(Window.partitionBy("doc_id").orderBy("session", "hint_no", "hint")).alias("at"))
    return Parse(kinds, zoned, only(meta), structures, sessions, readings, W.extract(zoned, told), P.extract(zoned), M.important_dates(zoned))


def review(p: Parse, threshold: float = THRESHOLD) -> DataFrame:
    """PRJ9, SET1: what a person should look at: doc_id, entity, ref, reason, confidence."""
    label = lambda d, entity, ref, reason, conf: d.select("doc_id", F.lit(entity).alias("entity"), ref.alias("ref"), reason.alias("reason"), conf.alias("confidence"))
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("code", "code"), ("title", "title"), ("term", "term"), ("instructor", "instructor_name"))]), lambda m: m.isNotNull()), ", ")
    course = label(p.meta.where("confidence < 1.0"), "course", F.lit("course"), F.concat(F.lit("could not find "), missing), F.col("confidence"))
    session = F.concat(F.lit("session["), F.col("session") - 1, F.lit("]"))
    lost = label(p.sessions.where("week is null and meeting_date is null"), "session", session, F.lit("no week number and no date"), F.lit(0.4))
    entry = F.concat(session, F.lit(".reading["), F.col("ordinal"), F.lit("]"))
    why = F.when(F.col("c").isNull(), "no citation pattern matched").otherwise(F.concat(F.lit("matched "), F.col("c.matched_pattern"), F.lit(" but scored low")))
    conf = F.coalesce("c.confidence", F.lit(0.0))
    work = label(p.readings.where(conf < threshold), "work", entry, why, conf)
    due = label(p.graded.where(F.col("confidence") < threshold), "deliverable", F.concat(F.lit("deliverable["), F.col("ordinal"), F.lit("]")), F.lit("incomplete deliverable"), F.col("confidence"))
    rule = label(p.policies.where(F.col("confidence") < threshold), "policy", F.concat(F.lit("policy["), F.col("ordinal"), F.lit("]")), F.concat("policy_type", F.lit(" policy not found in the document")), F.col("confidence"))
    return course.unionByName(lost).unionByName(work).unionByName(due).unionByName(rule)


def summary(p: Parse) -> DataFrame:
    """AGG3, AGG9's rows: by document its code, term, structure, sessions, dated ones, readings, cited ones, the weights' total and the stance on AI."""
    s = p.sessions.groupBy("doc_id").agg(F.count("*").alias("sessions"), F.count("meeting_date").alias("dated"))
    r = p.readings.groupBy("doc_id").agg(F.count("*").alias("readings"), F.count("c").alias("cited"))
    out = p.meta.join(p.structures, "doc_id", "left").join(s, "doc_id", "left").join(r, "doc_id", "left").join(W.weights(p.graded), "doc_id", "left").join(P.stance_of(p.policies), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "code", "title", F.col("term.name").alias("term_name"), F.col("term.year").alias("term_year"), "instructor", "structure", n("sessions"), n("dated"), n("readings"), n("cited"), "weight_total", A.weight_verdict(F.col("weight_total")).alias("weights"), "ai_stance")


def accuracy(rows: DataFrame) -> DataFrame:
    """AGG9: one row: how many documents gave a code, a term, a schedule, how many readings were found and resolved, and whose weights come to a hundred."""
    return rows.agg(
        F.count("*").alias("syllabi"), F.count("code").alias("coded"), F.count("term_name").alias("termed"), F.count_if(F.col("sessions") > 0).alias("scheduled"), F.coalesce(F.sum("readings"), F.lit(0)).alias("readings"),
        F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"), F.count_if(F.abs(F.col("weight_total") - 100) <= 1).alias("near_hundred"), F.count_if(F.col("weight_total") > 0).alias("weighed"),
    )


def as_json(p: Parse) -> DataFrame:
    """PRJ5, SNK13: (doc_id, value): each document's parse as one JSON text: course, sessions with their readings, graded work, policies."""
    entry = F.struct("ordinal", "raw", "requirement_level", "page_range", "access_note", "content_warning", F.col("c").alias("work"))
    r = p.readings.groupBy("doc_id", "session").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    session = F.struct("session", "week", "meeting_date", "sub_label", "topic", "section_heading", "session_type", "confidence", "entries")
    s = p.sessions.join(r, ["doc_id", "session"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(session)).alias("sessions"))
    rows = lambda d, *cells: d.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("rows"))
    g = rows(p.graded, "ordinal", "title", "kind", "weight", "due_date", "due_time", "recurrence", "page_limit", "word_limit", "format_note", "confidence").withColumnRenamed("rows", "deliverables")
    q = rows(p.policies, "ordinal", "policy_type", "heading", "body", "ai_stance", "confidence").withColumnRenamed("rows", "policies")
    out = p.meta.join(p.structures, "doc_id", "left").join(s, "doc_id", "left").join(g, "doc_id", "left").join(q, "doc_id", "left")
    course = F.struct("code", "title", "term", "instructor", "meeting_time", "location", "site_url", "citation_style", "confidence")
    return out.select("doc_id", F.to_json(F.struct(course.alias("course"), "structure", "sessions", "deliverables", "policies")).alias("value"))
