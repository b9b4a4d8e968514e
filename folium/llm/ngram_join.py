"""Exact Jaccard self-join over five-word shingles: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

1. Every text becomes a sorted array of 64-bit shingle hashes. Texts with the same set share a node: the set's own hash.
2. Sizes fall into bands of ratio 1/t. Two sets of similarity t are in the same band or in neighbours, and differ in at most
   K = U * (1 - t) / t elements for the lower band's upper size U. The hash range is cut into more than K segments, so
   one non-empty segment at least is the same in both. (band, segment, its content) is the key of a tile.
   For large sets fewer segments do: their number is the least for which the chance that differences hit every segment of a
   pair just at the threshold is under ``MISS``.
3. Within a tile all pairs of fitting size are compared by bitmaps: |x & y| <= |x| - bits of x that y lacks, and the same
   with x and y exchanged. Tiles larger than ``TILE`` meet pair of subtiles by pair of subtiles.
4. The pairs left connect small groups; in these the arrays themselves are intersected, pairs already connected excepted.
   Connected components of the verified links give the result.

Nothing of the size of a group of copies meets in one task, and no list of pairs within a group is made.

Defined results: null, empty and blank texts have no shingles and no links; repeated rows are members of one component; a
text of which no row has a doc_id links with its equals only, and a null doc_id is never a component's id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import free_name, runs, settle, table, width
from folium.llm.graph import components, dealt_pairs, forest
from folium.llm.shingles import mix, pieces, shingles

NUMBER, OF = 4, 5  # similarity 4/5 or more
MISS = 1e-12
TILE = 1024
LEAST_BITS, MOST_BITS = 512, 1 << 17
#: Ids up to this many may be broadcast (about 32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
RATIO = OF / NUMBER


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * shared >= NUMBER * (a + b - shared)


def band(n: int) -> int:
    """The smallest k with n <= RATIO**k."""
    k = max(0, math.ceil(math.log(n) / math.log(RATIO)) - 1)
    while RATIO**k < n:
        k += 1
    return k


@lru_cache(None)
def segments(k: int) -> tuple[int, int, bool]:
    """For pairs whose smaller set is in band k: the number of segments, how many may be hit, and whether some are always left."""
    upper = math.floor(RATIO**k)
    # |x - y| + |y - x| <= (1 - t) |x + y| and |x + y| <= min / t.
    hits = upper * (OF - NUMBER) // NUMBER
    exact = hits + 2 + upper // 32
    m = 8
    while m < exact and m * math.log1p(-math.exp(-hits / m) * (1 - math.exp(-NUMBER * hits / m))) > math.log(MISS):
        m += 1 + m // 50
    return min(m, exact), hits, m >= exact


def tile_keys(s: np.ndarray) -> np.ndarray:
    """Keys of all tiles that a sorted set of hashes belongs to."""
    n = len(s)
    out = []
    own = band(n)
    content = mix(s)
    for k in (own, own - 1):
        if k < 0 or math.floor(RATIO**k) * RATIO < n:
            continue
        m, hits, sure = segments(k)
        if not hits:
            continue  # so small that only equal sets link
        seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        label = np.uint64(k * 1_000_003 + 17)
        out.append(mix(np.add.reduceat(content, first) + mix(seg[first] + (label << np.uint64(24)))))
        if sure and len(first) <= hits:
            # So uneven that all segments alike may be empty ones: those are keys too.
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), seg[first])
            out.append(mix(mix(empty + (label << np.uint64(24))) ^ np.uint64(1)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A hashed bitmap with about two bits an element at least."""
    w = LEAST_BITS
    while w < 2 * len(s) and w < MOST_BITS:
        w *= 2
    at = (s & np.uint64(w - 1)).astype(np.int64)
    bits = np.zeros(w, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def bounded_pairs(n: np.ndarray, maps: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes and bitmaps allow a link. side: 0 and 1 only meet each other, 2 meets all."""
    order = np.argsort(n, kind="stable")
    n, side = n[order], side[order]
    width_ = min(len(maps[i]) for i in order)
    all_maps = np.stack([_folded(maps[i], width_) for i in order])
    left, right = [], []
    # Those of at most RATIO times the size stand in one run after each.
    stop = np.searchsorted(n, np.floor(n * OF / NUMBER), side="right")
    for i in range(len(n)):
        j = np.arange(i + 1, stop[i])
        j = j[(side[j] == 2) | (side[i] == 2) | (side[j] != side[i])] if side[i] != 2 else j
        if not len(j):
            continue
        mine, theirs = all_maps[i], all_maps[j]
        shared = np.bitwise_count(mine & theirs).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[i] - (np.bitwise_count(mine).sum(dtype=np.int64) - shared), n[j] - (np.bitwise_count(theirs).sum(axis=1, dtype=np.int64) - shared))
        j = j[linked(most, n[i], n[j])]
        left.append(np.full(len(j), i))
        right.append(j)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return order[np.concatenate(left)], order[np.concatenate(right)]


SETS = "doc_id long, row_key long, row_check long, n long, node long, bits binary, keys array<long>"


def node_of(s: np.ndarray) -> int | None:
    """The hash of a whole set; None for an empty one."""
    if not len(s):
        return None
    total = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ np.uint64(len(s))
    return int((mix(np.array([total], np.uint64)) ^ np.bitwise_xor.reduce(s)).view(np.int64)[0])



def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[int] = set()
        for part in pieces(batch, "text"):
            h, at = shingles(part.column(3))
            nodes, maps, keys = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                s = h[a:b]
                node = node_of(s)
                nodes.append(node)
                if node is None or node in seen:  # copies within a batch bring their keys once
                    maps.append(None)
                    keys.append(None)
                else:
                    seen.add(node)
                    maps.append(bitmap(s).tobytes())
                    keys.append(tile_keys(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(at)), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[c.split()[0] for c in SETS.split(", ")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and node: members of the tiles that two nodes share. Tiles with the same members are one tile.

    A tile is named by its members while they are few and by its key beyond that, so a long one is passed on as it comes.
    """
    names: set[int] = set()
    last, run, long_run = None, [], False
    out_t: list[np.ndarray] = []
    out_n: list[np.ndarray] = []

    def close() -> None:
        if run and not long_run and len(run) > 1:
            nodes = np.array(run, np.int64)
            name = int(mix(np.array([np.add.reduce(mix(nodes.view(np.uint64)))], np.uint64)).view(np.int64)[0])
            if name not in names:
                if len(names) < 1_000_000:
                    names.add(name)
                out_t.append(np.full(len(nodes), name))
                out_n.append(nodes)

    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[fresh], node[fresh]
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        stop = np.concatenate([start[1:], [len(key)]])
        # Runs of one row concern us only at the ends of a batch.
        keep = np.flatnonzero((stop - start > 1) | (start == 0) | (stop == len(key)))
        for a, b in zip(start[keep].tolist(), stop[keep].tolist(), strict=True):
            if key[a] != last:
                close()
                last, run, long_run = key[a], [], False
            more = node[a:b].tolist()
            if run and more and run[-1] == more[0]:
                more = more[1:]
            if long_run or len(run) + len(more) > TILE:
                rows = np.array(more if long_run else run + more, np.int64)
                out_t.append(np.full(len(rows), last))
                out_n.append(rows)
                long_run, run = True, more[-1:] or run[-1:]
            else:
                run += more
        if sum(map(len, out_t)) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t)), pa.array(np.concatenate(out_n))], names=["tile", "node"])
            out_t, out_n = [], []
    close()
    if out_t:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t)), pa.array(np.concatenate(out_n))], names=["tile", "node"])


def _by_bitmap(r: dict) -> dict | None:
    nodes = r["node"]
    a, b = bounded_pairs(r["n"], [np.frombuffer(x, np.uint64) for x in r["bits"]], r["side"])
    if not len(a):
        return None
    x, y = forest(nodes[a], nodes[b])
    return {"a": x, "b": y}


def _by_arrays(r: dict) -> dict | None:
    sets = [np.frombuffer(x, np.uint64) for x in r["items"]]
    n, nodes = np.array([len(s) for s in sets]), r["node"]
    a, b = bounded_pairs(n, [bitmap(s) for s in sets], r["side"])
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept_a, kept_b = [], []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p == q:
            continue
        small, large = (sets[i], sets[j]) if n[i] < n[j] else (sets[j], sets[i])
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        shared = int((large[at] == small).sum())
        if linked(shared, n[i], n[j]):
            parent[max(p, q)] = min(p, q)
            kept_a.append(nodes[i])
            kept_b.append(nodes[j])
    return {"a": np.array(kept_a, np.int64), "b": np.array(kept_b, np.int64)} if kept_a else None


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # repeated rows bring their set once a task
    for batch in batches:
        for part in pieces(batch, "text"):
            h, at = shingles(part.column(batch.schema.get_field_index("text")))
            sets = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # A row's key is a hash: only the text whose set the node stands for is taken.
            same = []
            for k, (s, node) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)):
                if node not in seen and node_of(s) == node:
                    same.append(k)
                    if len(seen) < 1_000_000:
                        seen.add(node)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same, pa.int64())), part.column(1).take(pa.array(same, pa.int64())), pa.array([sets[k].tobytes() for k in same], pa.binary())], names=["node", "grp", "items"])


ROW = ("row_key", "row_check")


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """128 bits that tell rows apart by id and text, nulls included."""
    own = [F.col(id_col).cast("long"), F.col(text_col).cast("string")]
    return [F.xxhash64(*own, F.lit(k)).alias(name) for k, name in enumerate(ROW)]


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written: doc_id, the row's keys, n_shingles, and the root that its component's rows share (null: no words)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    sets = settle(texts.mapInArrow(_sets, SETS))

    # Tiles that two nodes share.
    keys = sets.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    met = keys.repartition(width(docs.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(_met, "tile long, node long")
    members = settle(met.dropDuplicates(["tile", "node"]))

    # Bitmaps bound each pair of a tile.
    signed = sets.where("bits is not null").select("node", "n", "bits")
    dealt = settle(dealt_pairs(members, "tile", "node", TILE)).join(signed.dropDuplicates(["node"]), "node")
    near = components(runs(dealt.select("tile", "i", "j", "side", "node", "n", "bits"), ["tile", "i", "j"], [], "a long, b long", _by_bitmap))

    # Arrays verify what is left: one text for each node of a group.
    first = sets.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"))
    wanted = settle(first.join(near.withColumnRenamed("root", "grp"), "node"))
    small = wanted.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(wanted) if small else wanted, "row_key").select("node", "grp", "text").mapInArrow(_items, "node long, grp long, items binary")
    checked = dealt_pairs(settle(found), "grp", "node", TILE // 4)
    links = runs(checked.select("grp", "i", "j", "side", "node", "items"), ["grp", "i", "j"], [], "a long, b long", _by_arrays)
    roots = components(links)

    # Joins read written tables, so that Spark may split the rows of a hot node.
    plain = sets.select("doc_id", *ROW, F.col("n").alias("n_shingles"), "node")
    return settle(plain.join(roots, "node", "left").select("doc_id", *ROW, "n_shingles", F.coalesce("root", "node").alias("root")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included)."""
    placed = similar_rows(docs, id_col, text_col)
    least = settle(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component: that of the smallest id, rows without an id last; rows without words all stay.

    Rows are told apart by id and text, so rows that share an id but not a text are judged each by its own; of rows equal in both
    one stays.
    """
    placed = similar_rows(docs, id_col, text_col).where("root is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    best = settle(placed.groupBy("root").agg(F.min(rank).alias("best")))
    marked = settle(placed.join(best, "root").select(*ROW, (F.struct(*ROW) == F.struct(*[f"best.{c}" for c in ROW])).alias("stays")))

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    gone = settle(marked.where(~F.col("stays")).select(*ROW).distinct())
    several = settle(marked.where("stays").groupBy(*ROW).count().where("count > 1").select(*ROW))
    names = [free_name(docs.columns, c) for c in ROW]
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_keys(id_col, text_col), names, strict=True)])
    same = lambda rows: rows.toDF(*names)
    kept = keyed.join(same(sent(gone)), names, "left_anti").select(*keyed.columns)
    if several.limit(1).count():
        again = sent(same(several))
        once = kept.join(again, names, "left_semi").dropDuplicates(names).select(*keyed.columns)
        kept = kept.join(again, names, "left_anti").select(*keyed.columns).unionByName(once)
    return kept.select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
SQL = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(sh)
"""
}
