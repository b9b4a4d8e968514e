"""Full-text search: postings in blocks of falling impact, the best chunks by BM25 from the first blocks alone, snippets of the best.

An index is a folder of segments and a manifest of those that count. A segment holds postings (place, term, key.., tf, length) in a file of each task that made
them, sorted by place, and a dictionary (code, term, blocks). A posting's level is its BM25 weight (without idf) in ``LEVELS`` steps from the highest
down, and its place is the term's hash with the level as the last digits; all of one term and level are a block, which the files' statistics find, and the dictionary
knows the size and the highest weight of each file's part of it. Nothing is shuffled. ``append_index`` adds a segment and
``merge_index`` makes one of all; both write a new manifest last, so that a search sees either the old segments or the new ones.

``search`` reads the first blocks of each word, completes what it found there, and knows the score to beat. It then reads only so much further that a
chunk that it has not met cannot reach that score, whatever blocks remain (a threshold algorithm). ``search_once`` is for a corpus without an index.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folium.sources.io import narrow_batches, settled, short_batches

K1, B = 1.2, 0.75
#: Levels fill the last eight bits of a place.
LEVELS = 256
#: Signs that a word takes, about; it only scales the levels of new postings, whose blocks are right by any scale.
SIGNS = 6
#: So many signs of a text are cut into words at once, and so many postings are told to the dictionary at once.
PIECE, STRETCH = 1_000_000, 100_000
#: A first look takes so many postings of each word for each chunk asked for.
FIRST = 4
#: Up to so many chunks are looked up by their keys as literals, which reach the files' statistics; more by a join.
LOOKED_UP = 1000
WORD = "[a-z0-9]+"


def words_of(body: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))


def terms_of(query: str | list[str]) -> list[str]:
    """The words of a query as the index has them: lower case, each once, in order; what is no word is left out."""
    return list(dict.fromkeys(re.findall(WORD, (query if isinstance(query, str) else " ".join(query)).lower())))


def postings(chunks: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(term, *key, tf, length): one row a term and chunk."""
    rows = chunks.select(*key, words_of(body).alias("words")).select(*key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return rows.groupBy(*key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


#: Each byte as it stands in a word, or a space.
_IN_WORDS = bytes(c if re.match(rf"{WORD}$", chr(c)) else 32 for c in range(256))


def _words_in(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, cut from pieces of bounded length."""
    plain, at = text.translate(_IN_WORDS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (key.., lower-case text as bytes) as postings (key.., length, term, tf)."""
    for batch in batches:
        terms, tfs, held, lengths = [], [], [], []
        for body in batch.column(batch.num_columns - 1).to_pylist():
            told: Counter[bytes] = Counter()
            for words in _words_in(body or b""):
                told.update(words)
            terms += told.keys()
            tfs += told.values()
            held.append(len(told))
            lengths.append(told.total())
        rows = np.repeat(np.arange(len(held)), held)
        cells = {f.name: batch.column(i).take(pa.array(rows)) for i, f in enumerate(batch.schema) if i < batch.num_columns - 1}
        yield pa.RecordBatch.from_pydict(cells | {"length": pa.array(np.array(lengths, "int32")[rows], pa.int32()), "term": pa.array(terms, pa.string()), "tf": pa.array(tfs, pa.int32())})


def _made(chunks: DataFrame, key: list[str], body: str) -> DataFrame:
    """Postings of chunks of distinct keys, made within the chunk's task: no count meets another one."""
    short_batches(chunks.sparkSession)
    kind = StructType(chunks.select(*key).schema.fields).add("length", "integer").add("term", "string").add("tf", "integer")
    return chunks.select(*key, F.lower(body).cast("binary").alias("_low")).mapInArrow(_counted, kind)


def _code(term: Column) -> Column:
    """Where a term's blocks begin."""
    return F.xxhash64(term).bitwiseAND(F.lit(-LEVELS))


def _codes(spark: SparkSession, words: list[str]) -> dict[str, int]:
    return {r["term"]: r["code"] for r in spark.createDataFrame([(t,) for t in words], "term string").select("term", _code(F.col("term")).alias("code")).collect()}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (place, term, best) in order of their places as words' blocks (code, term, blocks): of a word or block that stretches cut, each tells its part."""
    held: list[pa.RecordBatch] = []

    def begun(differs: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.flatnonzero(differs) + 1))

    def told() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks() if held else None
        held.clear()
        if whole is None or not whole.num_rows:
            return
        place, term, best = whole.column(0).to_numpy(), whole.column(1).combine_chunks(), whole.column(2).to_numpy()
        other = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        block = begun((place[1:] != place[:-1]) | other)
        word = begun(((place[1:] ^ place[:-1]) >= LEVELS) | ((place[1:] ^ place[:-1]) < 0) | other)
        parts = pa.StructArray.from_arrays([pa.array((place[block] % LEVELS).astype("int32")), pa.array(np.diff(block, append=len(place))), pa.array(np.maximum.reduceat(best, block))], ["level", "n", "best"])
        ends = np.append(np.searchsorted(block, word), len(block)).astype("int32")
        yield pa.RecordBatch.from_arrays([pa.array(place[word] & -LEVELS), term.take(pa.array(word)), pa.ListArray.from_arrays(pa.array(ends), parts)], ["code", "term", "blocks"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STRETCH:
            yield from told()
    yield from told()


def weight(mean: float | Column) -> Column:
    """A posting's part of the score, without idf; below K1 + 1."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class Segment:
    name: str
    n: int
    words: int

    @property
    def mean(self) -> float:
        return self.words / self.n if self.words else 1.0


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """Those of the latest manifest."""
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    return [Segment(*s) for s in last["segments"]]


def _key_of(spark: SparkSession, path: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()["key"]))


def _publish(spark: SparkSession, path: str, version: int, live: list[Segment], key: StructType) -> None:
    row = (version, [(s.name, s.n, s.words) for s in live], key.json())
    spark.createDataFrame([row], "version long, segments array<struct<name:string,n:long,words:long>>, key string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _write_segment(p: DataFrame, code: Column, key: list[str], path: str, n: int, scale: float) -> Segment:
    """Postings as a segment; its levels are those of a mean length of ``scale`` words."""
    spark, name = p.sparkSession, f"seg-{uuid.uuid4().hex}"
    level = F.least(F.lit(LEVELS - 1), F.floor((1 - weight(scale) / (K1 + 1)) * LEVELS))
    rows = p.select((code + level).alias("place"), "term", *key, "tf", "length")
    # Each task writes what it has: neither a word that every chunk holds nor a bucket of words is one task's to sort.
    rows.sortWithinPartitions("place").write.parquet(f"{path}/{name}/postings")
    back = spark.read.schema(rows.schema).parquet(f"{path}/{name}/postings")
    seg = Segment(name, n, back.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])
    with narrow_batches(spark):
        back.select("place", "term", weight(seg.mean).alias("best")).mapInArrow(_stretches, "code long, term string, blocks array<struct<level:int,n:long,best:double>>").write.parquet(f"{path}/{name}/terms")
    return seg


def _segment_of(chunks: DataFrame, key: list[str], path: str, body: str) -> Segment:
    n, signs = chunks.agg(F.count("*"), F.coalesce(F.sum(F.length(body)), F.lit(0))).first()
    return _write_segment(_made(chunks, key, body), _code(F.col("term")), key, path, n, max(1.0, signs / SIGNS / max(1, n)))


def write_index(chunks: DataFrame, key: list[str], path: str, body: str = "body") -> None:
    """An index of one segment."""
    _publish(chunks.sparkSession, path, 0, [_segment_of(chunks, key, path, body)], chunks.select(*key).schema)


def _version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0]


def append_index(chunks: DataFrame, key: list[str], path: str, body: str = "body") -> None:
    """Chunks of new keys as a segment more; one writer at a time."""
    spark = chunks.sparkSession
    live, version = segments(spark, path), _version(spark, path)
    _publish(spark, path, version + 1, [*live, _segment_of(chunks, key, path, body)], chunks.select(*key).schema)


def _postings(spark: SparkSession, path: str, live: list[Segment]) -> DataFrame:
    each = [spark.read.parquet(f"{path}/{s.name}/postings") for s in live if s.words]
    return reduce(DataFrame.unionByName, each)


def merge_index(spark: SparkSession, key: list[str], path: str) -> None:
    """All segments as one, levels by the mean of all; the old ones stay on disk for the searches that still read them."""
    live, version = segments(spark, path), _version(spark, path)
    if len(live) > 1 and any(s.words for s in live):
        n, words = sum(s.n for s in live), sum(s.words for s in live)
        one = _write_segment(_postings(spark, path, live), F.col("place").bitwiseAND(F.lit(-LEVELS)), key, path, n, words / n)
        _publish(spark, path, version + 1, [one], _key_of(spark, path))


@dataclass
class Lists:
    """The blocks of a query's words, best first: sizes, and the highest score in the blocks from each on."""

    size: dict[str, list[tuple[int, int]]]
    rest: dict[str, list[float]]

    def bound(self, depth: dict[str, int]) -> float:
        """What a chunk can score that no block read so far holds."""
        return sum(r[min(depth[t], len(r) - 1)] for t, r in self.rest.items())

    def read(self, depth: dict[str, int]) -> int:
        return sum(n for t, s in self.size.items() for _, n in s[: depth[t]])

    def spent(self, depth: dict[str, int]) -> bool:
        """Whether a word's list is read to its end: a chunk that was not met lacks the word."""
        return any(depth[t] >= len(s) for t, s in self.size.items())


def _lists(spark: SparkSession, path: str, live: list[Segment], codes: dict[str, int], n: int, mean: float) -> tuple[Lists, dict[str, float]] | None:
    words = list(codes)
    held: dict[str, dict[int, list[float]]] = {t: {} for t in words}
    dictionary = None
    for s in (s for s in live if s.words):
        # A chunk weighs more where the mean grows, by no more than the means' ratio.
        d = spark.read.parquet(f"{path}/{s.name}/terms").where(F.col("code").isin(*codes.values()) & F.col("term").isin(*words)).select("term", F.explode("blocks").alias("b"), F.lit(max(1.0, mean / s.mean)).alias("ratio"))
        dictionary = d if dictionary is None else dictionary.unionByName(d)
    if dictionary is None:
        return None
    blocks = dictionary.groupBy("term", "b.level").agg(F.sum("b.n").alias("n"), F.max(F.col("b.best") * F.col("ratio")).alias("best"))
    for r in blocks.collect():  # LEVELS rows a word at most
        held[r["term"]][r["level"]] = [r["n"], r["best"]]
    idf = {t: _idf(n, int(sum(b[0] for b in held[t].values()))) for t in words}
    size, rest = {}, {}
    for t in words:
        levels = sorted(held[t])
        size[t] = [(v, int(held[t][v][0])) for v in levels]
        tops = [idf[t] * held[t][v][1] for v in levels]
        rest[t] = [max(tops[k:], default=0.0) for k in range(len(tops) + 1)]
    return (Lists(size, rest), idf) if all(size.values()) else None


def _within(term: str, code: int, first: int, last: int) -> Column:
    """A word's postings of these levels, by what the files' statistics know; words of equal hashes are told apart."""
    return F.col("place").between(code + first, code + last) & (F.col("term") == term)


def _first_depth(lists: Lists, least: int) -> dict[str, int]:
    """Blocks that hold ``least`` postings of each word; if one word has no more than that, all of its list and nothing of the others."""
    rarest = min(lists.size, key=lambda t: sum(n for _, n in lists.size[t]))
    if sum(n for _, n in lists.size[rarest]) <= least:
        return {t: len(s) if t == rarest else 0 for t, s in lists.size.items()}
    depth = {}
    for t, s in lists.size.items():
        held = k = 0
        while held < least:
            held, k = held + s[k][1], k + 1
        depth[t] = k
    return depth


def _deeper(lists: Lists, depth: dict[str, int], goal: float) -> dict[str, int]:
    """Further blocks, always those that lower the bound most for a posting, until nothing unmet can reach ``goal``."""
    depth = dict(depth)
    while lists.bound(depth) >= goal and not lists.spent(depth):
        gain = lambda t: max((lists.rest[t][depth[t]] - lists.rest[t][k]) / sum(n for _, n in lists.size[t][depth[t] : k]) for k in range(depth[t] + 1, len(lists.rest[t])))  # noqa: B023, E731
        depth[max(lists.size, key=gain)] += 1
    return depth


@dataclass
class Reading:
    """How much a search read: postings of its words, of which so many in blocks and so many looked up."""

    total: int = 0
    blocks: int = 0
    looked_up: int = 0


def search(spark: SparkSession, path: str, query: str | list[str], key: list[str], limit: int = 20) -> DataFrame:
    """SRV3, SRT6: the best chunks that hold all words of the query (*key, score), best first, of equals the smallest key. No word, no chunk."""
    return search_read(spark, path, query, key, limit)[0]


def search_read(spark: SparkSession, path: str, query: str | list[str], key: list[str], limit: int = 20) -> tuple[DataFrame, Reading]:
    live, words = segments(spark, path), terms_of(query)
    n, mean = sum(s.n for s in live), sum(s.words for s in live) / max(1, sum(s.n for s in live))
    schema = _key_of(spark, path).add("score", "double")
    codes = _codes(spark, words) if words else {}
    known = _lists(spark, path, live, {t: codes[t] for t in words}, n, mean) if words and limit > 0 else None
    if known is None:
        return spark.createDataFrame([], schema), Reading()
    lists, idf = known
    all_of = _postings(spark, path, live).select(*key, "term", "place", (weight(mean) * sum((F.when(F.col("term") == t, F.lit(v)).otherwise(0.0) for t, v in idf.items()), F.lit(0.0))).alias("part"))
    parts = [F.max(F.when(F.col("term") == t, F.col("part"))).alias(f"s{i}") for i, t in enumerate(words)]
    depth, goal, reading = _first_depth(lists, FIRST * limit), -math.inf, Reading(lists.read({t: len(s) for t, s in lists.size.items()}))
    while True:
        inside, outside, most = F.lit(False), F.lit(False), F.lit(0.0)
        for i, t in enumerate(words):
            last = lists.size[t][depth[t] - 1][0] if depth[t] else -1
            inside = inside | _within(t, codes[t], 0, last)
            outside = outside | _within(t, codes[t], last + 1, LEVELS - 1)
            most = most + F.coalesce(f"s{i}", F.lit(lists.rest[t][depth[t]]))
        met = settled(all_of.where(inside).groupBy(*key).agg(*parts).where(most >= goal - 1e-6))
        lacking = met.where(F.greatest(*[F.col(f"s{i}").isNull().cast("int") for i in range(len(words))], F.lit(0)) == 1).select(*key)
        ids = lacking.limit(LOOKED_UP + 1).collect()
        rest = all_of.where(outside)
        if len(ids) <= LOOKED_UP:
            rest = rest.where(F.col(key[0]).isin(*{r[0] for r in ids}))
        rest = settled(rest.join(lacking, key, "left_semi").groupBy(*key).agg(*parts))
        reading.blocks = lists.read(depth)
        reading.looked_up += rest.select(sum((F.col(f"s{i}").isNotNull().cast("long") for i in range(len(words))), F.lit(0)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        whole = met.unionByName(rest).groupBy(*key).agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(words))])
        # Of sums in any order the last digits differ: one place each word keeps them in the query's order.
        hits = whole.select(*key, F.round(sum((F.col(f"s{i}") for i in range(1, len(words))), F.col("s0")), 6).alias("score")).where("score is not null")
        best = hits.orderBy(F.desc("score"), *key).limit(limit).collect()  # ``limit`` rows
        if lists.spent(depth) or len(best) == limit and lists.bound(depth) < best[-1]["score"] - 1e-6:
            return spark.createDataFrame(best, schema).orderBy(F.desc("score"), *key), reading
        if len(best) == limit:
            goal = best[-1]["score"]
            depth = _deeper(lists, depth, goal - 1e-6)
        else:
            # Too few hold all words yet: the rarest word's list has them all.
            depth = {t: len(s) if t == min(lists.size, key=lambda x: sum(k for _, k in lists.size[x])) else 0 for t, s in lists.size.items()}


def search_once(chunks: DataFrame, query: str | list[str], key: list[str], limit: int = 20, body: str = "body", marked: bool = True) -> DataFrame:
    """SRV3 without an index: one pass counts the query's words alone; with ``marked`` the best chunks bring a snippet of the first word."""
    words, low = terms_of(query), F.lower(body)
    # Numbers of matches, not arrays of words: of most chunks nothing else is asked. Words are letters and digits, so that they are safe in an expression.
    told = settled(chunks.select(*key, F.regexp_count(low, F.lit(WORD)).cast("long").alias("length"), *[F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).cast("long").alias(f"t{i}") for i, t in enumerate(words)]))
    n, mean, *df = told.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0)), *[F.count(F.when(F.col(f"t{i}") > 0, 1)) for i in range(len(words))]).first()
    held, score = F.lit(bool(words)), F.lit(0.0)
    for i in range(len(words)):
        held = held & (F.col(f"t{i}") > 0)
        part = _idf(n, df[i]) * (F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("length") / (mean or 1.0))))
        score = score + part if i else part
    best = told.where(held).select(*key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *key).limit(limit)
    if not marked:
        return best
    return best.join(chunks.select(*key, F.col(body).alias("_body")), key).select(*key, "score", snippet(F.col("_body"), words[0] if words else "").alias("excerpt"))


def snippet(body: Column, word: str, width: int = 18) -> Column:
    """``width`` words around the first hit, the hits in brackets."""
    plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(words, plain), word).cast("int")
    cut = F.slice(words, F.greatest(at - width // 2, F.lit(1)), width)
    return F.when(at > 0, F.array_join(F.transform(cut, lambda w: F.when(plain(w) == word, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " "))
