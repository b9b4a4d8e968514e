"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic. They are ordered by their smallest ``doc_id``; the smallest shard
capacity for which a greedy left-to-right fill needs no more than ``n_shards`` shards is found by search,
and the order is cut where that greedy fill cuts it. Law: ``bytes``.

Everything stays in DataFrame operations. The driver never sees the groups: it gets the first and last group end of each of at most
``CELLS`` cells of the byte axis, bounds the smallest capacity from below and above by greedy fills over these, and asks
again, with finer cells, only about the windows in which the cuts may still lie. A pass over the prefix sums narrows the windows a
thousandfold, so two to five passes find the exact cuts at any size.

Defined results: a null text has size 1 and stands in the group of the empty text; an empty table gives an
empty result; repeated rows each get their own slot; a null ``doc_id`` sorts first; a group larger than the
ideal shard fills a shard of its own, and shards may stay empty then.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import settle, table, text_of, width

#: Cells of the byte axis that one pass asks about.
CELLS = 1 << 16
FIRST = -(2**63)


def _cells(prefix: DataFrame, windows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """First and last group end of each cell that has one, in order, and whether each cell is one byte wide."""
    wide = max(1, -(-sum(b - a + 1 for a, b in windows) // CELLS))
    at = F.col("upto")
    inside, cell = F.lit(False), F.lit(None).cast("long")
    for a, b in windows:  # one a shard at most
        inside = inside | at.between(a, b)
        cell = F.when(at.between(a, b), F.floor((at - a) / wide)).otherwise(cell)
    which = F.lit(-1)
    for k, (a, b) in enumerate(windows):
        which = F.when(at.between(a, b), k).otherwise(which)
    rows = prefix.where(inside).groupBy(which.alias("w"), cell.alias("c")).agg(F.min("upto").alias("low"), F.max("upto").alias("high")).select("low", "high").collect()  # about CELLS at most
    low, high = np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64)
    return np.sort(low), np.sort(high), wide == 1


def _fill(low: np.ndarray, high: np.ndarray, capacity: int, n_shards: int, hopeful: bool) -> list[int]:
    """Cuts of a greedy fill: at known group ends, or (hopeful) as far as an unknown end may lie."""
    cuts, at = [], 0
    for _ in range(n_shards):
        target = at + capacity
        k = int(np.searchsorted(low, target, side="right")) - 1  # the last cell that begins at or before the target
        if k >= 0:
            known = int(high[k]) if high[k] <= target else int(low[k])
            at = max(at, target if hopeful and high[k] > target else known)
        cuts.append(at)
    return cuts


def _least(low: np.ndarray, high: np.ndarray, a: int, b: int, total: int, n_shards: int, hopeful: bool) -> int:
    """The least capacity in [a, b] whose fill reaches the end; b where none below it does."""
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if _fill(low, high, mid, n_shards, hopeful)[-1] >= total else (mid + 1, b)
    return a


def smallest_capacity(prefix: DataFrame, total: int, largest: int, n_shards: int) -> list[int]:
    """Cut positions of the smallest feasible capacity. ``prefix`` has one inclusive prefix sum a row."""
    a, b = max(largest, -(-total // n_shards)), -(-total // n_shards) + largest  # b is always feasible
    windows = [(0, total)]
    while True:
        low, high, exact = _cells(prefix, windows)
        b = _least(low, high, a, b, total, n_shards, False)
        a = _least(low, high, a, b, total, n_shards, True)
        near, far = _fill(low, high, a, n_shards, False), _fill(low, high, b, n_shards, True)
        if exact or a == b and near == far:
            return near
        windows = []
        for x, y in zip(near, far, strict=True):
            if windows and x <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(y, windows[-1][1]))
            else:
                windows.append((x, y))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, group_id (smallest id of equal texts)."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    groups = settle(rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(FIRST)).alias("head"), F.sum("size").alias("bytes")))
    placed = groups.select("head", "digest", "bytes").repartitionByRange(width(spark), "head", "digest").sortWithinPartitions("head", "digest")
    placed = settle(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    before = placed.groupBy("part").agg(F.sum("bytes").alias("held"))
    # One row a partition: a bound that the number of shuffle partitions sets.
    before = before.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("at"))
    prefix = settle(placed.withColumn("running", running).join(F.broadcast(before), "part").select("head", "digest", "bytes", (F.col("running") + F.col("before")).alias("upto")))
    total, largest = prefix.agg(F.max("upto"), F.max("bytes")).first()
    heads = []
    if total:
        cuts = smallest_capacity(prefix.select("upto"), total, largest, n_shards)
        firsts = prefix.agg(*[F.min(F.when(F.col("upto") > c, F.struct("head", "digest"))).alias(f"h{i}") for i, c in enumerate(cuts[:-1])]).first()
        heads = [h for h in firsts if h is not None]

    # The hot group of copies joins a table that was written out, so that Spark may split its rows.
    full = rows.join(groups.select("digest", "head"), "digest")
    own = F.lit(0)
    for h in heads:
        own = own + (F.struct("head", "digest") >= F.struct(F.lit(h["head"]).alias("head"), F.lit(bytes(h["digest"])).alias("digest"))).cast("int")
    full = full.select("doc_id", "size", "text_crc32", F.when(F.col("head") != FIRST, F.col("head")).alias("group_id"), own.alias("shard"))
    # Rows get a place in their shard without one task a shard: dealt by ranges, counted, and moved up by what is before.
    dealt = full.repartitionByRange(width(spark), "shard", "group_id", "doc_id").sortWithinPartitions("shard", "group_id", "doc_id")
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", "first_at", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return dealt.join(F.broadcast(counts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_at") + F.col("ahead")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_id"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sharding": op6_sharding}
SQL: dict[str, str] = {}
