"""Substring search from an n-gram index over everything that has been entered or parsed.

The index has, for each row, its distinct runs of three characters (lower case) with their places, and its distinct pairs of characters, sorted by
gram within stretches of ``STRETCH`` characters of text, so that a page of a file spans few grams, and a dictionary of how many rows hold each. A needle of three characters or more is covered by grams
that together hold each of its characters, the cheapest such cover by the dictionary; the rows where all of them stand at the right distance hold
the needle, so no text is read. A needle of two characters is a gram itself, and a shorter one finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WIDE, PAIR = 3, 2
#: Characters of text whose lists are made and sorted together, and rows of a batch of lists.
STRETCH, BATCH = 2_000_000, 20_000
#: Characters of a policy that a result shows.
SHOWN = 160


def searchable(sessions: DataFrame, readings: DataFrame, notes: DataFrame, work: DataFrame, policies: DataFrame) -> DataFrame:
    """SRV4, SET5: rows (kind, course_id, place, id, body, shown) of the five kinds that a search looks through.

    sessions: course_id, id, topic, week; readings: course_id, id, cited, raw, week; notes: course_id, id, note, cited, week;
    work: course_id, id, title, requirements, due; policies: course_id, id, body.
    """
    week = F.when(F.coalesce("week", F.lit(0)) != 0, F.concat(F.lit("Week "), "week")).otherwise("")
    text = lambda c: F.coalesce(c, F.lit(""))
    flat = F.trim(F.regexp_replace("body", r"[\s ]+", " "))

    def rows(df: DataFrame, kind: str, place: Column, body: Column, shown: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "course_id", place.alias("place"), "id", body.alias("body"), shown.alias("shown"))

    parts = [
        rows(sessions, "Topic", week, text("topic"), text("topic")),
        rows(readings, "Reading", week, F.concat_ws(" ", text("cited"), text("raw")), text("cited")),
        rows(notes, "Your note", week, text("note"), F.concat(text("note"), F.lit(" — on "), text("cited"))),
        rows(work, "Assignment", text(F.date_format("due", "M/d")), F.concat_ws(" ", text("title"), text("requirements")), text("title")),
        rows(policies, "Policy", F.lit(""), text("body"), F.concat(F.substring(flat, 1, SHOWN), F.when(F.length(flat) > SHOWN, "…").otherwise(""))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams_of(text: str, wide: int) -> np.ndarray:
    """The text's runs of characters, each as one number (21 bits a character), in order."""
    c = _codes(text)
    n = max(0, len(c) - wide + 1)
    out = np.zeros(n, np.int64)
    for k in range(wide):
        out = (out << 21) | c[k : k + n]
    return out


def _sorted_lists(texts: list[str], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of several texts by gram and text: the text's number, the gram, the places one after the other, and where each list begins in them, with the end."""
    each = [grams_of(t, wide) for t in texts]
    gram, text = np.concatenate(each), np.repeat(np.arange(len(each)), [len(g) for g in each])
    order = np.argsort(gram, kind="stable")
    gram, text = gram[order], text[order]
    first = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in each])[order]
    return text[first], gram[first], place, np.append(first, len(gram))


def _listed(schema: pa.Schema):
    def stretch(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        for wide in (WIDE, PAIR):
            text, gram, place, at = _sorted_lists(texts, wide)
            for start in range(0, len(gram), BATCH):
                end = min(start + BATCH, len(gram))
                ends = at[start : end + 1] - at[start] if wide == WIDE else np.zeros(end - start + 1, np.int64)
                held = place[at[start] : at[end]] if wide == WIDE else place[:0]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(text[start:end])), pa.array(np.full(end - start, wide, np.int32)), pa.array(gram[start:end]), lists], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= STRETCH:
                    yield from stretch(pa.concat_arrays([*keys, batch.column(0).slice(start, i + 1 - start)]), texts)
                    keys, texts, held, start = [], [], 0, i + 1
            keys.append(batch.column(0).slice(start))
        if texts:
            yield from stretch(pa.concat_arrays(keys), texts)

    return go


def write_grams(rows: DataFrame, key: list[str], path: str, body: str = "body") -> None:
    """Lists (wide, gram, *key, places) and the dictionary (wide, gram, n).

    Each task writes what its own rows hold, as it comes: lists are many times the size of the texts, and a shuffle or a sort would put them on disk once more.
    """
    told = rows.select(F.struct(*key).alias("key"), F.lower(body).alias("body"))
    kind = T.StructType([T.StructField("key", told.schema["key"].dataType), *T._parse_datatype_string("wide int, gram long, places array<int>").fields])
    lists = told.mapInArrow(_listed(to_arrow_schema(kind)), kind).select("wide", "gram", "key.*", "places")
    lists.write.option("compression", "zstd").parquet(f"{path}/lists")
    counts = rows.sparkSession.read.parquet(f"{path}/lists").groupBy("wide", "gram").agg(F.count("*").alias("n"))
    counts.sortWithinPartitions("wide", "gram").write.parquet(f"{path}/counts")


def cover(grams: list[int], cost: dict[int, int]) -> list[int]:
    """Places of the grams that cover the needle at the least cost: the first, the last, and none further than its width from the one before."""
    best: list[tuple[int, list[int]]] = []
    for k, g in enumerate(grams):
        before = min((best[j] for j in range(max(0, k - WIDE), k)), default=(0, []))
        best.append((before[0] + cost.get(g, 0), [*before[1], k]))
    return best[-1][1]


def _lists(spark: SparkSession, path: str, part: str, wide: int, grams: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}").where((F.col("wide") == wide) & F.col("gram").isin(*grams))


def find(spark: SparkSession, path: str, needle: str, key: list[str]) -> DataFrame:
    """Rows (*key, place) that hold the needle, whatever its case, and where first (from 0; null for a needle of two characters)."""
    needle = needle.lower()
    wide = WIDE if len(needle) >= WIDE else PAIR
    grams = [int(g) for g in grams_of(needle, wide)]
    empty = spark.createDataFrame([], spark.read.parquet(f"{path}/lists").select(*key).schema.add("place", "integer"))
    if not grams:
        return empty
    if wide == PAIR:
        return _lists(spark, path, "lists", PAIR, grams).select(*key, F.lit(None).cast("int").alias("place"))
    cost = {r["gram"]: r["n"] for r in _lists(spark, path, "counts", WIDE, sorted(set(grams))).collect()}  # a row a gram of the needle
    if any(g not in cost for g in grams):
        return empty
    at = cover(grams, cost)
    used = list(dict.fromkeys(grams[k] for k in at))
    held = _lists(spark, path, "lists", WIDE, used).groupBy(*key).agg(*[F.first(F.when(F.col("gram") == g, F.col("places")), ignorenulls=True).alias(f"g{i}") for i, g in enumerate(used)])
    starts = None
    for k in at:
        own = F.transform(f"g{used.index(grams[k])}", lambda p: p - k)  # noqa: B023
        starts = own if starts is None else F.array_intersect(starts, own)
    return held.select(*key, F.array_min(starts).alias("place")).where("place is not null")
