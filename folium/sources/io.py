"""Sources and sinks: files with content hashes, positioned runs, guarded exports, calendars, backups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "doc_id string, pages array<struct<number:int,width:double,height:double,runs:array<struct<text:string,x:double,y:double,w:double,h:double,size:double>>,rules:array<struct<x0:double,y0:double,x1:double,y1:double>>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's executors share (spark.checkpoint.dir); without one, only a local session gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A table that later stages read several times, written to the shared folder and read back: it is computed once and survives lost executors. It goes when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Narrow rows dealt by their key over all tasks before costly columns are made of them: a table of few megabytes is one task's to read, and would be one task's work.
    What is grouped by the key later lies together already."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


#: Rows and bytes of a batch between Spark and Python at most, where whole texts go there: a worker holds a batch and what it makes of it.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session be small."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).lower().rstrip("b")
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """For what is written within: rows of numbers and words go to Python in batches that are bounded by their count alone. A bound in bytes has Spark
    measure the batch at each row, which takes several times what sending the row does."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """SRC1/SRC2: files below a path with the hash that is their identity; the bytes stay out of every shuffle."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("file_hash"), "content")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: positioned runs from JSON, one row a run."""
    pages = spark.read.schema(RUNS).json(path).select("doc_id", F.explode("pages").alias("p"))
    return pages.select("doc_id", F.col("p.number").alias("page"), F.posexplode("p.runs").alias("run_id", "r")).select("doc_id", "page", "run_id", "r.*")


def rules(spark: SparkSession, path: str, skew: float = 0.7, least: float = 6, most: int = 4000) -> DataFrame:
    """SRC12: ruled segments that lie along an axis and are long enough, the first so many of a page that are."""
    pages = spark.read.schema(RUNS).json(path).select("doc_id", F.explode("pages").alias("p"))
    dx, dy = lambda r: F.abs(r["x1"] - r["x0"]), lambda r: F.abs(r["y1"] - r["y0"])
    kept = F.filter("p.rules", lambda r: ((dx(r) <= skew) & (dy(r) >= least)) | ((dy(r) <= skew) & (dx(r) >= least)))
    return pages.select("doc_id", F.col("p.number").alias("page"), F.posexplode(F.slice(kept, 1, most)).alias("rule_id", "r")).select("doc_id", "page", "rule_id", "r.*")


def needs_ocr(text: Column) -> Column:
    """SRC5: a page with almost no text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 40


def new_only(found: DataFrame, known: DataFrame, key: str = "file_hash") -> DataFrame:
    """SNK3: what is not known yet, once for each hash."""
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replace_by_hash(table: DataFrame, fresh: DataFrame, key: str = "file_hash") -> DataFrame:
    """SNK1: all rows of a parsed file give way to those of its new parse."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def backup(df: DataFrame, binary: tuple[str, ...] = ("content", "pdf")) -> DataFrame:
    """SNK10: one JSON line a row, binary columns left out."""
    return df.drop(*binary).select(F.to_json(F.struct("*")).alias("value"))


def restore(spark: SparkSession, path: str, schema: str, held: DataFrame, key: str) -> DataFrame:
    """SRC17: a backup read again; cells that it lacks, binaries first of all, keep what is held, and rows that only the store has stay."""
    read = spark.read.schema(schema).json(path)
    cells = [c for c in held.columns if c != key]
    new = read.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in read.columns if c != key])
    both = held.join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in read.columns else F.col(c) for c in cells], *[F.col(f"_{c}").alias(c) for c in read.columns if c != key and c not in cells])


def ics_escape(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ics_event(uid: Column, day: Column, title: Column, stamp: str) -> Column:
    """SNK8: an all-day event, folded at 73 characters."""
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")),
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(day, 1), "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), ics_escape(title)), F.lit("END:VEVENT"),
    )

    def fold(x: Column) -> Column:
        rest = F.transform(F.sequence(F.lit(0), ((F.length(x) - 74) / 72).cast("int")), lambda k: F.concat(F.lit("\r\n "), F.substring(x, F.lit(74) + k * 72, F.lit(72))))
        return F.when(F.length(x) <= 73, x).otherwise(F.concat(F.substring(x, 1, 73), F.array_join(rest, "")))

    return F.array_join(F.transform(lines, fold), "\r\n")


def notes_markdown(notes: DataFrame, course: str, title: str, note: str, order: str) -> DataFrame:
    """SNK9: one Markdown text a course."""
    items = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(note)).alias("t"))))
    return notes.groupBy(course).agg(F.concat(F.lit("# "), F.first(course), F.lit("\n\n"), F.array_join(F.transform(items, lambda s: s["t"]), "\n\n")).alias("markdown"))
