"""The prefix trie of conversations, rolled up by centroid decomposition.

A conversation is a sequence of turns (role, text). Every distinct sequence of first turns is a node; a conversation is a member of each of its prefixes.

1. Texts are read once, where they lie: a turn becomes a digest (BLAKE2b, 16 bytes) of its role and text and the number of its words; texts are not shuffled. Groups
   of twenty ids are dealt out, sorted by id and turn, and stream: the opening conversation's first turns are held for those that take them over, and each prefix gets an
   identity from its parent's and its last turn's digest. No conversation is gathered; all its turns pass through one task one after the other, as any digest of a
   sequence asks. Only where turns of one number and role differ do their texts say their order; these conversations alone are read and dealt with their texts.
2. Nodes are groups of equal prefixes (members counted with a map-side combine); the edges to their parents make a forest below the root. What is below a node of
   one member is the rest of that conversation: one leaf, nothing saved. So only nodes of two members and more take the steps that follow.
3. The forest is split into components of bounded size. A node's tier is the number of digits of its members' count in base ``FAN_OUT``; it never grows
   downwards, so the nodes of one tier that hang together are a component with one top, of at most ``FAN_OUT`` nodes at each depth.
4. Tier by tier from below, each component is rolled up in one task: split at its centroid again and again, the totals of the parts aggregated, and the
   centroid's total added to all on the path from it to the part's top (``rollup``). Each node is visited once for each of about log2(size) splits, whatever the
   shape: long chains cost no more than bushes. The tops' totals go to their parents in the tier above, added up by Spark: there are about log(members) tiers.

Defined results: null roles and texts are empty; turns of one number stand in order of role and text, a null number first; repeated
rows are turns of their own; a negative id belongs to the group of twenty that begins below it; rows without a conv_id belong to no conversation; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import runs, settle, table, text_of, width
from folium.llm.manifest import crc_sql

#: Base of the tiers: a component has at most as many nodes at one depth.
FAN_OUT = 256
ROOT = b"\0" * 16
#: So many ids share the first turns of the one that opens them.
GROUP = 20
SPACE = "[^\\x20\\x09-\\x0D]+"


TURNS = "conv_id long, turn long, role string, tie string, said binary, words long"
WALKS = "conv_id long, depth long, node binary, parent binary, words long, ends boolean, tied boolean"
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _words(texts: pa.Array) -> np.ndarray:
    """How many words each text has: the bytes of all texts are looked at together."""
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(len(texts), np.int64)
    word = ~GAPS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    first = at[:-1][at[1:] > at[:-1]]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[first] = word[first]
    return np.diff(np.searchsorted(np.flatnonzero(starts), at))


def _told(tied: bool):
    """Rows (conv_id, turn, role, text) as turns; ``tied`` keeps the text, to sort by it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TURNS.split(", ")]
        for batch in batches:
            if batch.num_rows:
                conv, turn, role, text = batch.columns
                said = []
                for r, t in zip(role.to_pylist(), text.cast(pa.large_binary()).to_pylist(), strict=True):
                    own = r.encode()
                    said.append(hashlib.blake2b(b"".join((len(own).to_bytes(8, "little"), own, t)), digest_size=16).digest())
                tie = text.cast(pa.string()) if tied else pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([conv, turn, role.cast(pa.string()), tie, pa.array(said, pa.binary()), pa.array(_words(text), pa.int64())], names=names)

    return go


def kept_head(conv_id: int) -> int:
    """How many first turns a conversation takes over."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of groups of ids as the prefixes of the conversations as they are rebuilt: conv_id, depth, node, parent, words of the last text, whether it is the conversation's
    last, and on that row whether turns of one number and role differ whose order the texts have to say. A conversation without turns ends at the root."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
    names = [f.split()[0] for f in WALKS.split(", ")]
    base, heads = None, []  # the first turns of the group's opening conversation
    conv, k, keep, tied = None, 0, 0, False
    turn_of, role_of, tie_of, said_of = None, None, None, None
    depth, node, held = 0, ROOT, None
    rows: list[tuple] = []

    def put(said: bytes, words: int) -> None:
        nonlocal depth, node, held
        if held is not None:
            rows.append((*held, False, False))
        parent, depth = node, depth + 1
        node = hashlib.blake2b(parent + said, digest_size=16).digest()
        held = (conv, depth, node, parent, words)

    def close() -> None:
        if conv is not None:
            rows.append((*(held or (conv, 0, ROOT, None, 0)), True, tied))

    for batch in batches:
        for c, turn, role, tie, said, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                close()
                conv, k, keep, tied, depth, node, held = c, 0, kept_head(c), False, 0, ROOT, None
                if c - c % GROUP != base:
                    base, heads = c - c % GROUP, []
                if c != base:
                    for h in heads[:keep]:
                        put(*h)
            elif turn == turn_of and role == role_of and tie == tie_of and said != said_of:
                tied = True
            turn_of, role_of, tie_of, said_of = turn, role, tie, said
            k += 1
            if c == base:
                put(said, words)
                if k <= 3:
                    heads.append((said, words))
            elif k > keep:
                put(said, words)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def walked(conversations: DataFrame) -> DataFrame:
    """Every prefix of every conversation as it is rebuilt (``WALKS``)."""
    spark = conversations.sparkSession
    given = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    turns = given.mapInArrow(_told(False), TURNS)

    def walk(rows: DataFrame) -> DataFrame:
        group = F.expr(f"conv_id div {GROUP} - if(conv_id % {GROUP} < 0, 1, 0)")
        dealt = rows.repartition(width(spark), group).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "tie")
        return settle(dealt.mapInArrow(_walk, WALKS))

    first = walk(turns)
    tied = first.where("tied").select("conv_id")
    if tied.isEmpty():
        return first
    texts = given.join(tied, "conv_id", "left_semi").mapInArrow(_told(True), TURNS)
    return walk(turns.join(tied, "conv_id", "left_anti").select(*texts.columns).unionByName(texts))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order: of each node the digest of its ids, comma-joined."""
    node, running = None, hashlib.sha256()
    for batch in batches:
        nodes, digests = [], []
        for at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(running.hexdigest())
                node, running = at, hashlib.sha256(str(conv).encode())
            else:
                running.update(b",%d" % conv)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests)], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])


def rollup(parent: list[int], values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of one component. ``parent`` (-1 for the top) stands before its children; ``values`` are integer arrays.

    Centroid decomposition: a part is a subtree that lacks what was split off below it. Its centroid is the lowest node that holds at least half of it. The subtrees
    of the centroid's children become parts of their own and so does what is left above; the centroid's total is its own value and theirs, and is
    added to every node from its parent up to the part's top.
    """
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        kids[parent[v]].append(v)
    total = [[int(x) for x in v] for v in values]
    cut = [False] * n  # split off together with its subtree
    splits: list[tuple[int, int]] = []  # a centroid and the top of the part that it splits
    parts = [0]
    size = [1] * n
    while parts:
        top = parts.pop()
        order = [top]
        for v in order:
            order.extend(k for k in kids[v] if not cut[k])
        for v in order:
            size[v] = 1
        for v in reversed(order[1:]):
            size[parent[v]] += size[v]
        half, c = (len(order) + 1) // 2, top
        while True:
            heavy = next((k for k in kids[c] if not cut[k] and size[k] >= half), None)
            if heavy is None:
                break
            c = heavy
        splits.append((c, top))
        below = [k for k in kids[c] if not cut[k]]
        parts.extend(below)
        for k in below:
            cut[k] = True
        if c != top:
            cut[c] = True
            parts.append(top)
    # A split's parts are split later, so backwards the tops of the parts below a centroid hold their totals by the time it is closed.
    closed = [False] * n
    for c, top in reversed(splits):
        for t in total:
            t[c] += sum(t[k] for k in kids[c] if closed[k])
        closed[c] = True
        v = c
        while v != top:
            v = parent[v]
            for t in total:
                t[v] += t[c]
    return [np.array(t, np.int64) for t in total]


def _component(rows: dict) -> dict:
    """One component, its nodes in the order of their depth."""
    nodes = rows["node"]
    if len(nodes) == 1:
        sums = [rows["leaves"], rows["saved"]]
    else:
        at = {x: k for k, x in enumerate(nodes)}
        sums = rollup([at.get(x, -1) for x in rows["parent"]], [rows["leaves"], rows["saved"]])
    return {"node": nodes, "parent": rows["parent"], "is_top": [a == b for a, b in zip(nodes, rows["top"], strict=True)], "n_leaves": np.asarray(sums[0], np.int64), "saved_tokens": np.asarray(sums[1], np.int64)}


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    walks = walked(conversations)
    # Parent, depth and words follow from the node.
    found = settle(walks.where("depth > 0").groupBy("node", "parent", "depth", "words").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("ends").alias("ended")))
    shared, single = found.where("n_convs > 1"), found.where("n_convs = 1")
    above = shared.select(F.col("node").alias("parent"), F.col("owner").alias("above"))
    # Nodes of one member: a parent that is none of the shared ones is the same conversation's.
    lone = single.where("depth > 1").select("parent", "depth", "owner", "ended").join(above, "parent", "left")
    lone = settle(lone.select(F.when(F.col("above").isNotNull(), F.col("parent")).alias("parent"), "depth", "owner", "ended", F.coalesce("above", "owner").alias("above")))
    kids = lone.where("parent is not null").select(F.col("parent").alias("node"), F.lit(1).alias("lone")).unionByName(shared.where("depth > 1").select(F.col("parent").alias("node"), F.lit(0).alias("lone")))
    kids = kids.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("lone").alias("lone"))
    tier = F.lit(0)
    for k in range(1, 6):
        tier = F.when(F.col("n_convs") >= FAN_OUT**k, k).otherwise(tier)
    # On each conversation's way down the first node of a tier is the top of its component; the node's smallest member says so for the node.
    met = settle(walks.where("depth > 0").select("conv_id", "depth", "node", "ends").join(shared.select("node", "parent", "words", "owner", "n_convs", tier.alias("tier")), "node"))
    way = Window.partitionBy("conv_id", "tier").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = met.withColumn("top", F.first("node").over(way)).where(F.col("owner") == F.col("conv_id")).join(kids, "node", "left").fillna(0, ["n_children", "lone"])
    nodes = settle(placed.select("node", "parent", "top", "tier", "depth", "conv_id", "n_convs", "n_children", "lone", ((F.col("n_convs") - 1) * F.col("words")).alias("own")))
    done: DataFrame | None = None
    for t in range((nodes.agg(F.max("tier")).first()[0] or 0) + 1):
        own = nodes.where(F.col("tier") == t).select("node", "parent", "top", "depth", (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("leaves"), F.col("own").alias("saved"))
        if done is not None:
            lower = done.where("is_top").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            own = own.join(lower, "node", "left").select("node", "parent", "top", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        rolled = settle(runs(own, ["top"], ["depth"], "node binary, parent binary, is_top boolean, n_leaves long, saved_tokens long", _component))
        done = rolled if done is None else done.unionByName(rolled)
    told = settle(nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children").join(done.select("node", "n_leaves", "saved_tokens"), "node"))
    # The rows of the root are one row each.
    first = told.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    alone = single.where("depth = 1").agg(F.count("*").alias("lone"))
    root = walks.where("ends").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").join(first).join(alone)
    leaves = F.coalesce("n_leaves", F.lit(0)) + F.col("lone")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", (F.col("n_children") + F.col("lone")).alias("n_children"), F.greatest(leaves, F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    root = settle(root)
    last = met.where("ends").select("node", "conv_id").unionByName(walks.where("depth = 0").select("node", "conv_id"))
    ends = last.repartition(width(spark), "node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed, "node binary, ends_sha256 string")
    least, nothing = (root.first() or {"conv_id": None})["conv_id"], F.lit(hashlib.sha256().hexdigest())
    first = F.lit(least).cast("long")
    top = told.unionByName(root).join(above, "parent", "left").join(ends, "node", "left").select(
        "conv_id", "depth", F.when(F.col("depth") == 1, first).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rest = lone.select("depth", "owner", "ended", "above").unionByName(single.where("depth = 1").select("depth", "owner", "ended", first.alias("above")))
    rest = rest.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), one.alias("n_convs"), (~F.col("ended")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("ended"), F.sha2(F.col("owner").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return top.unionByName(rest)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {
    "op13_prefix_trie": rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT t.* FROM t JOIN c USING (conv_id) WHERE k > h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - (c.conv_id % 20 + 20) % 20 WHERE k <= h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, role, text FROM r),
p AS (SELECT conv_id, depth, text, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
q AS (SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '{SPACE}')) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n GROUP BY up),
b AS (SELECT DISTINCT x.node, y.node AS below FROM q x JOIN q y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
s AS (SELECT b.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(n.own) AS saved FROM b JOIN n ON n.node = b.below LEFT JOIN k ON k.node = b.below GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node"""
}
