"""A store of parses: a parent table of documents and the child tables of what was parsed from them, which change together.

Rows lie in buckets of the document's hash, each bucket's rows of a table in a folder of their own. A manifest says which folder counts for each bucket; it is
written last, as one row, so a reader sees the tables before or after a change and never between, and a writer that fails leaves everything as it was. A change
writes the buckets of the documents that it touches, no others. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folium.sources.io import settled

BUCKETS = 32
PARENTS = "documents"
_MANIFEST = "version long, tables map<string,struct<schema:string,folders:map<int,string>>>"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return -1, {}
    row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    return (row["version"], row["tables"]) if row else (-1, {})


def load(spark: SparkSession, path: str, name: str, buckets: list[int] | None = None) -> DataFrame | None:
    """A table as the last change left it, all of it or some buckets; None where the store has no such table."""
    import json

    table = _manifest(spark, path)[1].get(name)
    if table is None:
        return None
    schema = StructType.fromJson(json.loads(table["schema"]))
    folders = [f for b, f in sorted(table["folders"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def replace(spark: SparkSession, path: str, touched: DataFrame, fresh: dict[str, DataFrame], key: str) -> int:
    """SNK1: the rows of the ``touched`` documents (their keys) give way to ``fresh`` ones, in all tables at once. How many buckets were written."""
    touched = settled(touched.select(key).distinct())
    buckets = sorted(r[0] for r in touched.select(_bucket(key)).distinct().collect())  # BUCKETS at most
    if not buckets:
        return 0
    version, tables = _manifest(spark, path)
    out = {n: (t["schema"], dict(t["folders"])) for n, t in tables.items()}
    for name in sorted({*out, *fresh}):
        old, new = load(spark, path, name, buckets), fresh.get(name)
        kept = None if old is None else old.join(touched, key, "left_anti")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r in (kept, new) if r is not None])
        run = f"{name}-{uuid.uuid4().hex}"
        told = rows.withColumn("bucket", _bucket(key))
        # Each task writes its rows' buckets: dealt by bucket, all rows would be shuffled, and few tasks would sort them.
        told.write.partitionBy("bucket").parquet(f"{path}/{run}")
        # A bucket without rows has no folder; the data's own column order stays.
        held = {r[0] for r in spark.read.parquet(f"{path}/{run}").select("bucket").distinct().collect()} if told.limit(1).count() else set()
        folders = {b: f for b, f in out.get(name, ("", {}))[1].items() if b not in buckets} | {b: f"{run}/bucket={b}" for b in held}
        out[name] = (rows.schema.json(), folders)
    row = (version + 1, {n: (s, f) for n, (s, f) in out.items()})
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(buckets)


def outdated(spark: SparkSession, path: str, docs: DataFrame, version: str, key: str, hash_col: str) -> DataFrame:
    """STR6: documents that the store lacks, or has of another content or parser version."""
    held = load(spark, path, PARENTS)
    if held is None:
        return docs
    same = held.where(F.col("parser_version").eqNullSafe(F.lit(version))).select(key, hash_col)
    return docs.join(same, [key, hash_col], "left_anti")


def _once_each(docs: DataFrame, key: str) -> DataFrame:
    """One row of each key. Only rows whose key repeats meet each other; of the others nothing but the key is shuffled."""
    again = settled(docs.groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again"))
    if not again.limit(1).count():
        return docs
    same = F.col(key).eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates([key]))


def reparse(docs: DataFrame, path: str, parse: Callable[[DataFrame], dict[str, DataFrame]], version: str, key: str = "doc_id", hash_col: str = "file_hash") -> int:
    """STR6, SNK1-SNK3: parses what is outdated and puts it in the store; how many documents that were. ``parse`` gives the child tables (with ``key``) of documents."""
    spark = docs.sparkSession
    todo = settled(outdated(spark, path, _once_each(docs, key), version, key, hash_col))
    n = todo.count()
    if n:
        parents = todo.select(key, hash_col, F.lit(version).alias("parser_version"))
        replace(spark, path, todo, {PARENTS: parents} | parse(todo), key)
    return n
