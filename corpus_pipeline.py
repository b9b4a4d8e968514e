"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, decontaminate, langid, ngram_join, pii
from folium.llm.common import free_name, settle, short_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without a letter. The others bear the language that the model finds, whatever ``lang`` said.

    The model learns from the labelled documents. Where none is labelled, nothing is known: ``lang`` stays, and all with a letter stay.
    """
    short_batches(spark)
    model = langid.fit(langid.known(docs))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    text = free_name(docs.columns, "text_")
    found = langid.identify(docs.withColumnsRenamed({c: f"{text}{k}" for k, c in enumerate(docs.columns)}), model, text_col=f"{text}{docs.columns.index('text')}", with_spans=False)
    found = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*[F.col("lang_pred" if c == "lang" else f"{text}{k}").alias(c) for k, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id, one without an id last. Rows without words stay."""
    short_batches(spark)
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    short_batches(spark)
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digest, and the digest of what they decode to."""
    short_batches(spark)
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), bpe.vocabulary(), digests=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The vocabulary's merges are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
