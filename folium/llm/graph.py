"""Connected components, and comparison within candidate groups without any group meeting whole in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) that connect what the edges connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(flat[:half].tolist(), flat[half:].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    root = np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition replaced, some hundred thousand at a time, by stars that connect the same nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= 400_000:
            yield _batch(*forest(*map(np.concatenate, zip(*held, strict=True))))
            held, n = [], 0
    if n:
        yield _batch(*forest(*map(np.concatenate, zip(*held, strict=True))))


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Labels sink to the smallest of each neighbourhood and jump to their label's label, so the rounds grow with the
    logarithm of the longest path. Joins read written tables, so that Spark may split the rows of a hub.
    """
    edges = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(_stars, "a long, b long").dropDuplicates(["a", "b"]))
    both = settle(edges.union(edges.select("b", "a")))
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        sunk = settle(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("moved")))
        if not sunk.where("moved").limit(1).count():
            return sunk.select("node", F.col("label").alias("root"))
        above = sunk.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = settle(sunk.select("node", "label").join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def dealt_pairs(members: DataFrame, group: str, node: str, most: int) -> DataFrame:
    """Each member once for every pair of tiles that its tile is in: columns i, j and side (0: of i, 1: of j, 2: of both).

    A group of up to ``most`` members is one tile. A larger one is dealt into tiles by a hash of the node, and each pair of
    tiles meets in a task of its own, so that all pairs of a group are compared and none meets more than two tiles.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("held")).where(F.col("held") > most)
    sizes = settle(sizes.select(group, F.ceil(F.col("held") / most).cast("int").alias("tiles")))
    if sizes.limit(1).count():
        members = members.join(sizes, group, "left")
    else:
        members = members.withColumn("tiles", F.lit(None).cast("int"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64(node, F.lit(7)), tiles).cast("int")
    met = members.withColumn("_own", own).withColumn("_met", F.explode(F.sequence(F.lit(0), tiles - 1)))
    side = F.when(F.col("_own") == F.col("_met"), 2).when(F.col("_own") < F.col("_met"), 0).otherwise(1)
    return met.select("*", F.least("_own", "_met").alias("i"), F.greatest("_own", "_met").alias("j"), side.cast("int").alias("side")).drop("_own", "_met", "tiles")
