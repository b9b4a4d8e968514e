"""Policies: typed blocks of prose under headings, and what they say about AI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import collapse_whitespace
from folium.operators.segment import FRONT, first_pattern, heading_blocks

# Terms, cues and types, in their order.
AI_TERMS = r"(?i)\b(?:artificial intelligence|a\.?i\.?[- ]based|generative ai|chatgpt|large language model|llm|copilot|gemini|cl[a]ude|midjourney)\b"
STANCES = {
    "prohibited": r"(?i)\b(?:must not be used|may not (?:be )?use|is not (?:allowed|permitted)|are not (?:allowed|permitted)|not be used|prohibit\w*|forbidden|do not use|banned|will result in (?:a )?(?:failing|zero)|considered (?:academic dishonesty|plagiarism))\b",
    "restricted": r"(?i)\b(?:with (?:my |the instructor.s |prior |explicit )?(?:permission|approval)|only (?:with|when|for|if)|must (?:be )?(?:cite|disclose|acknowledge)|must cite|must disclose|unless (?:explicitly|otherwise) (?:stated|permitted|approved)|case[- ]by[- ]case|limited to|except)\b",
    "permitted": r"(?i)\b(?:you (?:may|can) use|are (?:allowed|permitted|encouraged) to use|free to use|welcome to use|encourage\w* the use)\b",
}
TYPES = {
    "late_work": r"(?i)\blate (?:work|submission|assignment|policy)\b", "attendance": r"(?i)\b(?:attendance|absence|excused absence|participation policy)\b",
    "grading_scale": r"(?i)\b(?:grading scale|grade scale|letter grade)\b", "academic_honesty": r"(?i)\b(?:academic honesty|academic integrity|honor code|plagiaris|culture of honesty|dishonesty)\b",
    "boilerplate": r"(?i)\b(?:ferpa|mental health|wellness|well[- ]being|land (?:and labor )?acknowledge|disability|accommodation|title ix|covid|counseling|student care|privacy|emergency|non[- ]discrimination|equal opportunity|basic needs|food insecurity|veteran)\b",
}
KEEP_ANYWAY = r"(?i)\b(?:grade dispute|regrade|dispute a grad|make[- ]?up|submission format|format requirement|extra credit)\b"
RANKS = {"ai_use": 0, "late_work": 1, "attendance": 2, "grading_scale": 3, "boilerplate": 9}
LEAST, START = 30, 120
ZONES = ("policies", FRONT, "requirements")


def ai_stance(text: Column) -> Column:
    """EXT17: prohibited, restricted, permitted in this order; restricted where AI is named without a cue; else unstated."""
    return F.when(text.rlike(AI_TERMS), F.coalesce(first_pattern(text, STANCES), F.lit("restricted"))).otherwise("unstated")


def policy_type(heading: Column, body: Column) -> Column:
    """EXT17: AI by the whole body, the others by the heading and the body's first 400 characters."""
    probe = F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.substring(body, 1, 400))
    return F.when(body.rlike(AI_TERMS), "ai_use").otherwise(F.coalesce(first_pattern(probe, TYPES), F.lit("other")))


def briefs_allowed(stance: Column) -> Column:
    return stance.isin("permitted", "unstated")


def rank(kind: Column) -> Column:
    """SRT3: the order in which policies are shown."""
    out = F.lit(5)
    for name, place in RANKS.items():
        out = F.when(kind == name, place).otherwise(out)
    return out


def extract(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """SEG22, EXT17, AGG15: the policies of zoned lines: key, ordinal, policy_type, heading, body, ai_stance, confidence; of equal beginnings the first.

    A document without a word on AI has a policy that says so (confidence 0.5).
    """
    blocks = heading_blocks(rows.where(F.col("zone").isin(*ZONES)), key).withColumn("body", collapse_whitespace(F.col("body"))).where(F.length("body") >= LEAST)
    typed = blocks.withColumn("policy_type", policy_type(F.col("heading"), F.col("body")))
    kept = typed.where((F.col("policy_type") != "other") | F.concat_ws(" ", F.coalesce("heading", F.lit("")), "body").rlike(KEEP_ANYWAY))
    first = F.row_number().over(Window.partitionBy(key, F.lower(F.substring("body", 1, START))).orderBy("idx"))
    kept = kept.withColumn("_n", first).where("_n = 1").withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1)
    out = kept.select(key, "ordinal", "policy_type", "heading", "body", F.when(F.col("policy_type") == "ai_use", ai_stance(F.col("body"))).alias("ai_stance"), F.lit(1.0).alias("confidence"))
    silent = rows.select(key).distinct().join(out.where("policy_type = 'ai_use'").select(key).distinct(), key, "left_anti")
    none = F.lit(None).cast("string")
    return out.unionByName(silent.select(key, F.lit(10_000).alias("ordinal"), F.lit("ai_use").alias("policy_type"), none.alias("heading"), F.lit("").alias("body"), F.lit("unstated").alias("ai_stance"), F.lit(0.5).alias("confidence")))


def stance_of(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """JOIN3's stance: that of a document's first policy on AI."""
    return found.where("policy_type = 'ai_use' and ai_stance is not null").groupBy(key).agg(F.min_by("ai_stance", "ordinal").alias("ai_stance"))
