"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle set. An item's sketch is its smallest hashes, as many as its partition
needs so that a document holding the threshold's share of the item must hold one hash of the sketch at least: for a
threshold t and a partition's upper size U, floor((1 - t) * U) + 1. A document, however long, probes with all its
shingles; items with a hit are verified by counting shared shingles.

The items are the stated query set. While all their shingles fit one block of ``BLOCK``, they are broadcast and the documents are
read once. A larger set never leaves Spark: sketches and documents' shingles meet in a join on the hash, and the candidates are
verified by a second join on document and hash, so that nothing grows on the driver or in a task.

Defined results: null or blank texts and items match nothing; an item with fewer than five words is one shingle, matched only by
a document that is this sequence of words; repeated items and repeated documents each give a row; empty tables give an
empty result. ``clean`` decides row by row, by the row's own text, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import free_name, settle, table, width
from folium.llm.shingles import pieces, shingles

NUMBER, OF = 4, 5  # containment 4/5 or more
BLOCK = 1_000_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def sketch_size(n: int) -> int:
    """Hashes that an item of n shingles is found by: those of the partition (powers of two) that n is in."""
    upper = 1 << max(0, (n - 1).bit_length())
    return min(n, (OF - NUMBER) * upper // OF + 1)


class Index:
    """A block of items: the sketches' hashes, sorted, and the items' whole sets."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        hashes = [s[: sketch_size(len(s))] for s in sets]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(h) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        # Most probes miss: a table by 20 bits of the hash says so at once.
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.flat >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared) for texts whose sorted sets are h[at[i]:at[i+1]]."""
        near = np.flatnonzero(self.gate[(h >> np.uint64(44)).astype(np.int64)])
        left, right = np.searchsorted(self.flat, h[near]), np.searchsorted(self.flat, h[near], side="right")
        hit = right > left
        near, left, right = near[hit], left[hit], right[hit]
        if not len(near):
            return
        text = np.searchsorted(at, near, side="right") - 1
        span = right - left
        item = self.owner[np.repeat(left, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)]
        for t, i in np.unique(np.stack([np.repeat(text, span), item]), axis=1).T.tolist():
            own, s = h[at[t] : at[t + 1]], self.sets[i]
            where = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[where] == s).sum())
            if OF * shared >= NUMBER * len(s):
                yield t, i, shared


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            h, at = shingles(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["item_id", "n", "items"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of each item as a row, and whether the sketch holds it."""
    for batch in batches:
        for item, n, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            h = np.frombuffer(items, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(np.full(n, n)), pa.array(h), pa.array(np.arange(n) < sketch_size(n))], names=["item", "n", "hash", "sketched"])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            h, at = shingles(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), np.diff(at))), pa.array(h.view(np.int64))], names=["row", "hash"])


def _item_table(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """Items with words, written: item (a number of its own), item_id, n and the sorted set."""
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    sets = queries.mapInArrow(_item_sets, "item_id long, n long, items binary").where("n > 0").repartition(width(items.sparkSession))
    return settle(sets.withColumn("item", F.monotonically_increasing_id()))


def _index(queries: DataFrame) -> Index | None:
    """All items as one block, or None where they are more than ``BLOCK`` shingles."""
    if (queries.agg(F.sum("n")).first()[0] or 0) > BLOCK:
        return None
    got = queries.select("item_id", "items").collect()  # BLOCK shingles at most
    return Index([r["item_id"] for r in got], [np.frombuffer(r["items"], np.uint64) for r in got])


def _joined(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """row, item, n, n_shared of all pairs; ``rows`` (row, text) is a written table."""
    flat = settle(queries.select("item", "n", "items").mapInArrow(_ranked, "item long, n long, hash long, sketched boolean"))
    sketch = flat.where("sketched").select("item", "hash")
    found = settle(rows.mapInArrow(_probes, "row long, hash long").join(sketch, "hash").select("row", "item").distinct())
    own = rows.join(found.select("row").distinct(), "row", "left_semi").mapInArrow(_probes, "row long, hash long")
    shared = found.join(flat.select("item", "n", "hash"), "item").join(own, ["row", "hash"]).groupBy("row", "item").agg(F.first("n").alias("n"), F.count("*").alias("n_shared"))
    return shared.where(OF * F.col("n_shared") >= NUMBER * F.col("n"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_item, n_shared, containment."""
    queries = _item_table(items, item_col, item_text)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = _index(queries)
    if index is None:
        rows = settle(texts.withColumn("row", F.monotonically_increasing_id()))
        hits = _joined(rows.select("row", "text"), queries).join(rows.select("row", "doc_id"), "row").join(queries.select("item", "item_id"), "item")
        return hits.select("doc_id", "item_id", F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            out = []
            for part in pieces(batch, 1):
                h, at = shingles(part.column(1))
                for t, i, shared in index.find(h, at):
                    n = len(index.sets[i])
                    out.append((part.column(0)[t].as_py(), index.ids[i], n, shared, shared / n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return texts.mapInArrow(probe, SCHEMA)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    queries = _item_table(items, item_col, item_text)
    index = _index(queries)
    if index is None:
        key = free_name(docs.columns, "row")
        rows = settle(docs.withColumn(key, F.monotonically_increasing_id()))
        hits = _joined(rows.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), queries).select(F.col("row").alias(key)).distinct()
        return rows.join(hits, key, "left_anti").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at_text = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            begin = 0
            for part in pieces(batch, at_text):
                for t, _, _ in sent.value.find(*shingles(part.column(at_text))):
                    stays[begin + t] = False
                begin += part.num_rows
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES_SQL = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""
_SETS_SQL = """CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [len(words)::VARCHAR || ':' || array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END"""
SQL = {
    "op4_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_SHINGLES_SQL} AS words FROM documents),
iw AS (SELECT item_id, {_SHINGLES_SQL} AS words FROM benchmark),
d AS (SELECT doc_id, unnest({_SETS_SQL}) AS g FROM dw),
i AS (SELECT item_id, {_SETS_SQL} AS sh FROM iw),
g AS (SELECT item_id, len(sh) AS n, unnest(sh) AS g FROM i)
SELECT doc_id, item_id, min(n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / min(n) AS containment
FROM d JOIN g USING (g) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * min(n)
"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
