"""Default-deny export: only allowed fields leave, and an audit of the schema proves it before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields that each entity may show, why others may not, and shapes that may stand in no artefact.
ALLOWED = {
    "course": ("id", "code", "title", "term", "year", "instructor_name", "meeting_time", "site_url", "citation_style", "ai_stance"),
    "session": ("id", "week_number", "meeting_date", "sub_session_label", "topic", "section_heading", "session_type", "ordinal"),
    "work": ("id", "authors", "title", "container", "publisher", "year", "year_end", "year_is_open", "volume", "issue", "pages", "doi", "url", "report_number", "work_type", "rendered_citation"),
    "assigned_reading": ("ordinal", "requirement_level", "page_range", "access_note", "content_warning", "work_id", "has_document"),
    "deliverable": ("id", "title", "kind", "due_date", "due_time", "recurrence", "weight_percent", "page_limit", "word_limit", "format_notes"),
    "policy": ("policy_type", "ai_stance", "heading", "body", "page_number"),
    "note": ("id", "work_id", "page_number", "body"),
}
WITHHELD = {
    "course.instructor_email": "personal contact detail", "course.location": "office and room location", "course.source_filename": "local filename",
    "chunk.body": "extracted text of someone else's copyrighted work", "brief.markdown": "model generated, opt in per course", "brief.body": "model generated, opt in per course",
    "note.shareable": "control flag, not content", "deliverable.requirements_text": "verbatim syllabus prose, kept local", "work.raw_source_text": "verbatim syllabus prose, kept local",
    "session.raw_source_text": "verbatim syllabus prose, kept local", "parse_review.source_text": "verbatim syllabus prose, kept local",
}
SHAPES = {
    "extracted reading text": r"(?i)\bchunk_text\b", "generated brief": r"(?i)\bbrief_markdown\b", "model generated content": r"(?i)\bgenerated_by\s*[:=]\s*[\"']?model",
    "instructor email field": r"(?i)\binstructor_email\b", "an academic email address": r"[\w.+-]+@[\w-]+\.(?:edu|ac\.[a-z]{2})\b",
}
FORBIDDEN = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Names that hold entities in a payload.
NESTS = ("schema", "courses", "policies", "deliverables", "sessions", "readings", "works", "notes", "surname", "given", "literal")


def pick(df: DataFrame, entity: str) -> DataFrame:
    """PRJ1: an entity's rows with nothing but the fields that it may show."""
    return allowed_only(df, ALLOWED[entity])


def pick_struct(column: str, fields: list[str], entity: str):
    """PRJ1 of a struct: its allowed fields."""
    return F.struct(*[F.col(f"{column}.{f}").alias(f) for f in fields if f in ALLOWED[entity]])


def every_name() -> set[str]:
    """All names that may stand in a payload."""
    return {f for fields in ALLOWED.values() for f in fields} | set(NESTS)


def forbidden_reasons(text) -> "F.Column":
    """PRJ3: why a text may not leave, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(p), why) for why, p in SHAPES.items()]), lambda w: w.isNotNull()))


def allowed_only(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """PRJ1."""
    return df.select(*[c for c in df.columns if c in allowed])


def audit(schema: T.StructType, allowed: set[str]) -> list[str]:
    """PRJ2: names, at any depth, that are not allowed; no data is read."""
    found: set[str] = set()

    def walk(t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                if f.name not in allowed:
                    found.add(f.name)
                walk(f.dataType)
        elif isinstance(t, T.ArrayType):
            walk(t.elementType)
        elif isinstance(t, T.MapType):
            walk(t.valueType)

    walk(schema)
    return sorted(found)


def export(df: DataFrame, allowed: set[str], path: str) -> None:
    """SNK5: refuse on a violation, else write."""
    if bad := audit(df.schema, allowed):
        raise ValueError(f"fields that may not leave: {bad}")
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    if lines.where(F.col("value").rlike(FORBIDDEN)).limit(1).count():
        raise ValueError("a value has a forbidden shape")
    lines.write.text(path)


def forbidden_rows(texts: DataFrame, column: str) -> DataFrame:
    """PRJ3."""
    return texts.where(F.col(column).rlike(FORBIDDEN))
