"""A Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf. The leaves of a source, in the order of their ids, are the lowest nodes of a tree whose nodes have up to 16 children;
the sources' roots, in the order of their names, are the lowest nodes of another. H is the lowercase hex SHA-256 of its inputs, one after the other.

1. Leaves get their rank in their source from a sort by ranges: the place in a partition plus what is before it, so that no source is sorted by one task.
2. The rank's last two hexadecimal digits name a leaf's place in a block of ``BLOCK`` leaves. The digits are grouped away one after the
   other: 16 leaves nest in the struct of their parent, 16 parents in the struct of their block, each with its digest. A block is one bounded row.
3. The blocks' digests are the nodes of the next tier, rolled up the same way, until a source has one node left; the sources' roots follow.
4. Downwards, a block's row gets the path above it, by its own key; a transform over its nested structs writes each leaf's path (the run of
   digests at every level and the own place in it) and an explode emits the leaves. Past their ranks (one row a partition says what is before it),
   leaves and proofs take part in no join.

Defined results: rows without a source are a source of their own, the first; rows without an id come first in their source and are
never tampered with; repeated ids stand in the order of their leaves; repeated rows are leaves of their own; a null field is ``-``, an
empty one ``0:``; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import settle, table, width

FAN = 16
BLOCK = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<pos:int,run:array<string>>>"


def digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    told = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in told]), 256)


def of_run(digests: Column) -> Column:
    return F.sha2(F.concat_ws("", digests), 256)


def siblings(level: Column) -> Column:
    return F.concat(F.slice(level["run"], 1, level["pos"]), F.slice(level["run"], level["pos"] + 2, FAN))


def proof(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, siblings))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda at, level: F.sha2(F.concat(F.concat_ws("", F.slice(level["run"], 1, level["pos"])), at, F.concat_ws("", F.slice(level["run"], level["pos"] + 2, FAN))), 256))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Written rows with their rank ``r`` in their group and the group's number of rows ``n``."""
    dealt = rows.repartitionByRange(width(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = dealt.groupBy(group, "part").agg(F.count("*").alias("held"), F.min("at").alias("first_at"))
    # A group has one row here for each partition that holds rows of it.
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("part")
    held = settle(held.select(group, "part", (F.sum("held").over(before) - F.col("held") - F.col("first_at")).alias("move"), F.sum("held").over(whole).alias("n")))
    return dealt.join(held, [group, "part"]).withColumn("r", F.col("at") + F.col("move")).drop("part", "at", "move")


def nested(nodes: DataFrame) -> DataFrame:
    """Nodes (g, r, n, digest, held) as blocks (g, block, n, digest, kids), two digits of the rank grouped away."""
    at = F.col("r")
    dealt = nodes.select("g", "n", "digest", "held", F.floor(at / BLOCK).alias("block"), F.floor(at / FAN).cast("long").alias("above"), (at % FAN).cast("int").alias("d0"))
    dealt = dealt.withColumn("d1", (F.col("above") % FAN).cast("int")).drop("above").repartition("g", "block")
    kids = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))  # noqa: E731  16 at most
    names = lambda c: F.transform(c, lambda x: x["digest"])
    low = dealt.groupBy("g", "block", "d1").agg(F.first("n").alias("n"), kids("d0", "digest", "held").alias("kids"))
    low = low.withColumn("digest", F.when(F.col("n") > 1, of_run(names(F.col("kids")))).otherwise(F.col("kids")[0]["digest"]))
    high = low.groupBy("g", "block").agg(F.first("n").alias("n"), kids("d1", "digest", "kids").alias("kids"))
    return high.withColumn("digest", F.when(F.col("n") > FAN, of_run(names(F.col("kids")))).otherwise(F.col("kids")[0]["digest"]))


def spread(blocks: DataFrame) -> DataFrame:
    """Blocks that know the path above them, as their nodes: g, r, digest, held, top, root, path."""
    names = lambda c: F.transform(c, lambda x: x["digest"])
    none = F.array().cast(_PATH)

    def level(pos: Column, run: Column) -> Column:
        return F.array(F.struct(pos.alias("pos"), names(run).alias("run")))

    def leaf(x: Column, y: Column) -> Column:
        own = F.when(F.col("n") > 1, level(y["d0"], x["kids"])).otherwise(none)
        parent = F.when(F.col("n") > FAN, level(x["d1"], F.col("kids"))).otherwise(none)
        return F.struct((F.col("block") * BLOCK + x["d1"] * FAN + y["d0"]).alias("r"), y["digest"].alias("digest"), y["held"].alias("held"), F.concat(own, parent, F.col("path")).alias("path"))

    told = F.flatten(F.transform("kids", lambda x: F.transform(x["kids"], lambda y: leaf(x, y))))
    return blocks.select("g", "top", "root", F.inline(told))


def roll(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes of trees, of up to ``most`` nodes each, with their tree's top, the root and the path. ``crown`` adds (top, root, path) to the trees' last blocks."""
    blocks = settle(nested(nodes))
    if most > BLOCK:
        upper = blocks.select("g", F.col("block").alias("r"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest", F.lit(None).cast("int").alias("held"))
        upper = roll(upper, -(-most // BLOCK), crown).select("g", F.col("r").alias("block"), "top", "root", "path")
        return spread(blocks.join(upper, ["g", "block"]))
    return spread(crown(blocks))


def manifest(docs: DataFrame) -> DataFrame:
    """Each row's leaf with subroot, root and path, and the leaf ``tampered`` of the text in lower case where 5 divides the id's CRC-32."""
    own = [F.col(c) for c in FIELDS]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaf = digest(own)
    tampered = F.when(changed, digest([*own[:-1], F.translate("text", UPPER, LOWER)])).otherwise(leaf)
    # One text stands for a source, so that one without a name differs from one whose name is empty and comes first.
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = settle(docs.select(source.alias("g"), "doc_id", leaf.alias("digest"), tampered.alias("tampered")))
    nodes = settle(ranked(leaves, "g", ["doc_id", "digest"]).select("g", "r", "n", "digest", F.struct("doc_id", "tampered").alias("held")))
    most = nodes.agg(F.max("n")).first()[0] or 0

    def one_root(blocks: DataFrame) -> DataFrame:
        return blocks.select("*", F.col("digest").alias("top"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))

    def under_sources(blocks: DataFrame) -> DataFrame:
        """The last block of each source, under the tree of sources."""
        tops = settle(blocks.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest"))
        tops = settle(ranked(tops, "g", ["source"]).select("g", "r", "n", "digest", F.struct("source").alias("held")))
        over = roll(tops, tops.agg(F.max("n")).first()[0] or 0, one_root).select(F.col("held.source").alias("g"), "root", "path")
        return blocks.withColumn("top", F.col("digest")).join(over, "g")

    told = roll(nodes, most, under_sources)
    return told.select(F.col("held.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("held.tampered").alias("tampered"), F.col("top").alias("subroot"), "root", "path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = manifest(table(spark, sf_dir, "documents"))
    back = folded(F.col("tampered"), F.col("path"))
    told = told.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL spells out: sources of up to 16 ** LEVELS rows, and as many sources.
LEVELS = 5
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({c}::VARCHAR) + 1), lambda i: ascii(substr({c}::VARCHAR, i::INT, 1))::BIGINT)),
lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def crc_sql(column: str) -> str:
    """CRC-32 of a column's decimal digits in DuckDB, which has no function for it."""
    return _CRC.replace("{c}", column)


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    parts = [
        f"""WITH l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM (
SELECT coalesce('=' || source, '') AS g, doc_id, sha256({head} || {field("text")}) AS digest, sha256({head} || {field(low)}) AS lowered, {crc_sql('doc_id')} % 5 = 0 AS hit FROM documents))"""
    ]
    # Up a source's tree, then up the tree of sources: nodes of level k with their run and place.
    for k in range(LEVELS):
        source = f"l{k}"
        parts.append(f"""m{k} AS (SELECT g, r // 16 AS p, list(digest ORDER BY r) AS run, any_value(n) AS n FROM {source} GROUP BY ALL)""")
        parts.append(f"""l{k + 1} AS (SELECT g, p AS r, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM m{k})""")
    parts.append(f"t0 AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n, digest FROM l{LEVELS})")
    for k in range(LEVELS):
        parts.append(f"""u{k} AS (SELECT r // 16 AS p, list(digest ORDER BY r) AS run, any_value(n) AS n FROM t{k} GROUP BY ALL)""")
        parts.append(f"""t{k + 1} AS (SELECT p AS r, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM u{k})""")
    cols, joins = [], []
    for k in range(LEVELS):
        joins.append(f"JOIN m{k} ON m{k}.g = a.g AND m{k}.p = a.r // {16 ** (k + 1)}")
        cols.append((f"m{k}.run", f"(a.r // {16**k}) % 16", f"m{k}.n > 1"))
    joins.append("JOIN t0 ON t0.g = a.g")
    for k in range(LEVELS):
        joins.append(f"JOIN u{k} ON u{k}.p = t0.r // {16 ** (k + 1)}")
        cols.append((f"u{k}.run", f"(t0.r // {16**k}) % 16", f"u{k}.n > 1"))
    sets = ", ".join(f"{run} AS run{i}, {pos} AS pos{i}, {on} AS on{i}" for i, (run, pos, on) in enumerate(cols))
    parts.append(f"e AS (SELECT a.doc_id, a.digest AS leaf, lowered, hit, t0.digest AS subroot, (SELECT digest FROM t{LEVELS}) AS root, {sets} FROM l0 a {' '.join(joins)})")
    steps, last = [], "e"
    for i in range(len(cols)):
        now = "CASE WHEN coalesce(hit, FALSE) THEN lowered ELSE leaf END" if not i else "f"
        side = f"array_to_string(run{i}[1:pos{i}], '')", f"array_to_string(run{i}[pos{i} + 2:16], '')"
        acc = "''" if not i else "s"
        steps.append(f"e{i} AS (SELECT * {'EXCLUDE (f, s)' if i else ''}, CASE WHEN on{i} THEN sha256({side[0]} || {now} || {side[1]}) ELSE {now} END AS f, {acc} || CASE WHEN on{i} THEN {side[0]} || {side[1]} ELSE '' END AS s FROM {last})")
        last = f"e{i}"
    parts += steps
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": _sql()}
