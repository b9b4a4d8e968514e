"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Normalised vectors of cosine c lie sqrt(2 - 2c) apart. A hash is floor((a.x + b) / w) for Gaussian a; k of them make a bucket, and a
label, so that vectors of other labels never meet. k follows from the number of vectors and from how near unrelated ones of a label lie
(measured on ``PROBES`` vectors at most, against the same vectors), so that a vector meets at most ``MEETINGS`` unrelated ones by chance
over all tables together: below one, so that chance never joins candidates into ever larger groups. The number of tables follows from k, so
that a pair right at the threshold is missed in all tables with a chance of at most ``MISS``. Buckets connect groups of candidates; within a
group all pairs are compared exactly, tile by tile, and only counts and spanning links leave a task, never the pairs.

Equal vectors are one class from the start, compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, have no links and are
their own component; vectors of different length never link; repeated rows count as vectors of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import runs, settle, table, width
from folium.llm.graph import components, dealt_pairs, forest
from folium.llm.shingles import mix

COSINE = 0.98
CELL = 1.2  # w: six times the distance at the threshold
MISS = 1e-4
MEETINGS = 0.1  # unrelated vectors that a vector meets in all tables, on average at most
MOST_HASHES = 48  # beyond, unrelated vectors lie too near for hashing to tell them apart
PROBES = 2000
TILE = 1024
SEED = 20260101


def same_cell(distance: float, w: float = CELL) -> float:
    """The chance that one hash of two points at a distance is the same."""
    u = w / distance
    phi = 0.5 * math.erfc(u / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def plan(n: int, cosine: float = COSINE, meet: Callable[[int], float] | None = None) -> tuple[int, int]:
    """Hashes in a bucket's key, and tables, for n vectors; ``meet(k)``: the chance that two unrelated ones share a bucket."""
    far, near = same_cell(math.sqrt(2)), same_cell(math.sqrt(2 - 2 * cosine))
    k = 4
    while True:
        tables = math.ceil(math.log(MISS) / math.log1p(-(near**k)))
        if k >= MOST_HASHES or n * tables * (meet(k) if meet else far**k) <= MEETINGS:
            return k, tables
        k += 1


def nearness(classes: DataFrame, cosine: float = COSINE) -> Callable[[int], float] | None:
    """The mean chance of two unlinked vectors of a label to share a bucket of k hashes, from a bounded sample of classes."""
    n = classes.count()
    share = F.lit(1_000_000 if n <= PROBES else max(1, PROBES * 1_000_000 // n))
    rows = classes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < share).select("label", "embedding").limit(4 * PROBES).collect()
    chances = []
    total = 0
    for label, length in {(r["label"], len(r["embedding"])) for r in rows}:
        x = np.array([r["embedding"] for r in rows if r["label"] == label and len(r["embedding"]) == length])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = (x @ x.T)[np.triu_indices(len(x), 1)]
        chances.append(c[c < cosine])
    total = len(rows) * (len(rows) - 1) // 2
    c = np.concatenate(chances) if chances else np.zeros(0)
    if not len(c):
        return None
    # Cosines in a hundred cells: each cell's chance by its upper end.
    cells, counts = np.unique(np.ceil(np.clip(c, -1, 1) * 50) / 50, return_counts=True)
    same = np.array([same_cell(math.sqrt(max(2 - 2 * min(v, cosine), 1e-6))) for v in cells.tolist()])
    return lambda k: float((counts * same**k).sum() / total)


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    return [None if v is None else np.array([np.nan if x is None else x for x in v], float) for v in column.to_pylist()] if column.null_count or column.flatten().null_count else _rows(column)


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_pylist()
        node = []
        for x, k in zip(_matrix(batch.column(2)), label, strict=True):
            ok = k is not None and x is not None and len(x) and np.isfinite(x).all() and x.any()
            node.append(int.from_bytes(hashlib.blake2b(str(k).encode() + b":" + (x + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(node, pa.int64())], names=["vec_id", "label", "embedding", "node"])


def _bucketed(k: int, tables: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = _rows(batch.column(2))
            length = np.array([len(r) for r in rows])
            for d in np.unique(length).tolist():
                if d not in known:
                    rng = np.random.default_rng([SEED, d])
                    known[d] = rng.standard_normal((d, k * tables)), rng.uniform(0, CELL, k * tables)
                a, b = known[d]
                own = np.flatnonzero(length == d)
                for part in np.array_split(own, max(1, len(own) * k * tables // 2_000_000)):
                    x = np.stack([rows[i] for i in part])
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    cells = np.floor((x @ a + b) / CELL).astype(np.int64).view(np.uint64).reshape(len(part), tables, k)
                    key = mix(np.arange(tables, dtype=np.uint64) * np.uint64(7919) + np.uint64(d))[None, :] ^ mix(label[part].astype(np.int64).view(np.uint64))[:, None]
                    for j in range(k):
                        key = mix(key + cells[:, :, j])
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node[part], tables))], names=["key", "node"])

    return go


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: each node with the first of its bucket."""
    last, first = None, None
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        start = np.concatenate([[True], key[1:] != key[:-1]])
        lead = node[np.flatnonzero(start)[np.cumsum(start) - 1]]
        if key[0] == last:
            lead[: int(np.argmax(start[1:]) + 1) if start[1:].any() else len(key)] = first
        last, first = key[-1], lead[-1]
        far = lead != node
        if far.any():
            a, b = forest(lead[far], node[far])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _compared(cosine: float):
    def go(r: dict) -> dict | None:
        node, side, size, label = r["node"], r["side"], r["held"], r["label"]
        length = np.array([len(e) for e in r["embedding"]])
        links, a, b = np.zeros(len(node), np.int64), [], []
        for d in np.unique(length).tolist():
            own = np.flatnonzero(length == d)
            x = np.array([r["embedding"][i] for i in own], float)
            norm = np.linalg.norm(x, axis=1)
            close = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
            close &= label[own][:, None] == label[own][None, :]
            s = side[own]
            # Tiles i and j meet here; pairs within a tile meet where the tile meets itself.
            close &= (s[:, None] == 2) | (s[:, None] != s[None, :])
            np.fill_diagonal(close, False)
            links[own] += close @ size[own]
            p, q = np.nonzero(np.triu(close))
            a.append(node[own[p]])
            b.append(node[own[q]])
        x, y = forest(np.concatenate(a), np.concatenate(b)) if sum(map(len, a)) else (np.zeros(0, np.int64),) * 2
        some = links > 0
        root = dict(zip(x.tolist(), y.tolist(), strict=True))
        return {"node": node[some], "links": links[some], "root": np.array([root.get(v, v) for v in node[some].tolist()], np.int64)}

    return go


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = settle(given.mapInArrow(_classed, "vec_id long, label long, embedding array<double>, node long"))
    classes = settle(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("held"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    k, tables = plan(classes.count(), cosine, nearness(classes, cosine))
    keys = classes.select("node", "label", "embedding").mapInArrow(_bucketed(k, tables), "key long, node long")
    edges = keys.repartition(width(vectors.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long")
    groups = components(edges).withColumnRenamed("root", "grp")
    dealt = settle(dealt_pairs(groups, "grp", "node", TILE)).join(classes, "node")
    found = settle(runs(dealt.select("grp", "i", "j", "side", "node", "held", "label", "embedding"), ["grp", "i", "j"], [], "node long, links long, root long", _compared(cosine)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    about = settle(classes.select("node", "held").join(links, "node", "left").join(roots, "node", "left").select("node", (F.col("held") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    placed = settle(rows.select("vec_id", "node").join(about, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"))
    least = settle(placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")))
    out = placed.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op9_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
}
QUERIES = {"op9_vector_dedup": op9_vector_dedup}
