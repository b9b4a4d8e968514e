"""Where queries put themselves: a name, a function of (spark, sf_dir), and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.io import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    """A value as SQL; of texts and lists of texts the mark {k} becomes the row's key."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    text = "'" + str(value).replace("'", "''") + "'"
    for code in (*range(1, 32), 127, *range(128, 160)):
        text = text.replace(chr(code), f"' || chr({code}) || '")
    return f"replace({text}, '{{k}}', k::VARCHAR)" if "{k}" in text else text


def cases(name: str, rows: list[tuple], read: Callable[[Column], dict[str, Column]], doc: str, types: dict[str, str], source: str = "part", key: str = "p_partkey") -> None:
    """A query that gives each row of a table the case that its key picks (key modulo their number), the key written into it, and reads it with the library;
    its SQL states what the rule says for each case. ``rows`` are (given, value of the first field, of the second ..)."""
    n = len(rows)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = F.replace(F.get(F.array(*[F.lit(r[0]) for r in rows]), (F.col(key) % n).cast("int")), F.lit("{k}"), F.col(key).cast("string"))
        told = spread(table(spark, sf_dir, source).select(key), key).select(F.col(key).alias("k"), given.alias("given"))
        return told.select("k", *[c.alias(f) for f, c in read(F.col("given")).items()])

    run.__name__, run.__doc__ = name, doc
    columns = []
    for i, (f, kind) in enumerate(types.items()):
        whens = " ".join(f"WHEN {j} THEN {literal(r[1 + i])}" for j, r in enumerate(rows))
        columns.append(f"(CASE k % {n} {whens} END)::{kind} AS {f}")
    QUERIES[name] = run
    SQL[name] = f"SELECT k, {', '.join(columns)} FROM (SELECT {key} AS k FROM {source})"
