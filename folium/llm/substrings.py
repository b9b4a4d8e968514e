"""Substring deduplication by suffix automata of reference shards.

A window is ``length`` successive words of one document. A window whose words also start earlier (smaller id, or the same document and
an earlier start) is removed, with every word that it covers; windows are judged on the input.

1. Each window has an anchor: of its runs of ``GRAM`` words the one with the smallest hash, the leftmost of equals. Successive windows on
   one anchor make a piece. Equal windows have the same anchor in the same place, so they lie in pieces on equal anchors.
2. Tasks fold what they have read: a copy of a piece that a task has met before goes, all its windows, and one of each kind is dealt
   on to its anchor, where copies from other tasks meet. A piece that is alone on its anchor holds no repeated window and is done.
3. The distinct pieces of anchors with more than one are the reference. They are dealt by anchor into shards of about ``SHARD``
   pieces. A shard's pieces stream, in the order of their first place in the corpus, over the suffix automaton of those before:
   where the matching statistic reaches ``length`` a window ends that started earlier. What a piece adds is then entered into the automaton.
   All automata are thus built where their text arrives; a shard's size bounds them, and every piece meets the one that can hold its windows.
   (Sending each automaton to every document instead would cost shards times documents.)
4. An anchor with more pieces than a shard takes has its windows dealt one by one, by their own hash.

Anchors and pieces are told apart by 64-bit hashes within their anchor; windows are compared word by word in the automaton.

Defined results: a null or empty text has no words; a text of fewer words than a window loses none; rows of one id and one text are the
same document, and each gets its result; rows of one id with other texts are documents of their own, in the order of a hash of their
text; documents without an id come last; an empty table gives an empty result. All columns stay; new ones take a free name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import free_name, settle, table, text_of, width
from folium.llm.shingles import _BASE, _BYTE, _SPACE, _bytes, _power, give_back, mix, pieces

LENGTH, GRAM = 20, 6
#: Pieces of a shard's automaton, on average; an anchor with more is settled window by window.
SHARD = 2000
#: Pieces that a task folds at a time, and kinds of one anchor among them from which all are known to have rivals.
FOLD, MANY = 1 << 19, 64
PLACE = ["late", "doc", "tie", "start"]
KNOWN, RIVAL, WANTED, GONE = range(4)
_DEALT = pa.schema([("part", pa.int64()), ("a", pa.int64()), ("d", pa.int64()), ("late", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("kind", pa.int32())])
_FOUND = "kind int, a long, late boolean, doc long, tie long, start int, n int"
_SPANS = "late boolean, doc long, tie long, start int, n int"
_RUNS = pa.schema([("late", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Cut:
    """The pieces of some texts: document, first word, number of windows, hash of the anchor and of the whole piece."""

    def __init__(self, texts: pa.Array, length: int):
        self.length = length
        data, offsets = _bytes(texts)
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        n = len(data)
        space, edge = _SPACE[data], np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        begin, end = np.flatnonzero(~space & (before | edge[:n])), np.flatnonzero(~space & (after | edge[1:])) + 1
        self.data, self.begin, self.end = data, begin, end
        self.at = np.searchsorted(begin, offsets)
        back, total = _power("inverse", pow(_BASE, -1, 2**64), n + 1), np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("base", _BASE, n + 1)[:n], out=total[1:])
        h = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
        m = len(h)
        self.back, self.total = _power("inverse", pow(_BASE, -1, 2**64), m + 1), np.zeros(m + 1, np.uint64)
        np.cumsum(h * _power("base", _BASE, m + 1)[:m], out=self.total[1:])
        windows = np.maximum(np.diff(self.at) - (length - 1), 0)
        held = int(windows.sum())
        self.doc = self.start = self.n = np.zeros(0, np.int64)
        self.anchor = self.piece = np.zeros(0, np.uint64)
        if not held:
            return
        grams = self.hash(np.arange(m - GRAM + 1), GRAM)
        least = self._leftmost_least(grams, length - GRAM + 1)
        first = np.repeat(self.at[:-1], windows) + (np.arange(held) - np.repeat(np.cumsum(windows) - windows, windows))
        doc, place = np.repeat(np.arange(len(windows)), windows), least[first]
        new = np.ones(held, bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        self.n, self.doc = np.diff(np.append(head, held)), doc[head]
        word = first[head]
        self.start, self.anchor, self.piece = word - self.at[self.doc], grams[place[head]], self.hash(word, self.n + length - 1)

    def hash(self, word: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of ``n`` words from each given word on."""
        return mix((self.total[word + n] - self.total[word]) * self.back[word] + np.asarray(n).astype(np.uint64))

    def _leftmost_least(self, values: np.ndarray, wide: int) -> np.ndarray:
        """Of each ``wide`` successive values the place of the smallest, the leftmost of equals."""
        got, span = np.arange(len(values)), 1
        while span < wide:
            step = min(span, wide - span)
            a, b = got[: len(got) - step], got[step:]
            got, span = np.where(values[b] < values[a], b, a), span + step
        return got

    def words(self, doc: int, start: int, n: int) -> bytes:
        """``n`` words of a document, one space between them."""
        k = int(self.at[doc]) + start
        raw = self.data[self.begin[k] : self.end[k + n - 1]].tobytes()
        return b" ".join(raw.split())


def _fold(length: int):
    def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        late, doc, tie, start, n, a, d = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((start, tie, doc, late, d, a))
        late, doc, tie, start, n, a, d = (x[order] for x in (late, doc, tie, start, n, a, d))
        new_a, new_d, new = np.ones(len(a), bool), np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_d[1:] = new_a[1:] | (d[1:] != d[:-1])
        new[1:] = new_d[1:] | (late[1:] != late[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1])
        kind = np.where(new_d, KNOWN, GONE).astype(np.int32)
        run = np.cumsum(new_a) - 1
        many = np.bincount(run[new_d], minlength=int(run[-1]) + 1 if len(run) else 0) >= MANY
        kind[new_d & many[run]] = WANTED
        kind[new_a & many[run]] = RIVAL
        part = a.astype(np.int64)
        passing = kind >= WANTED
        part[passing] = mix((doc * 1_000_003 + start).astype(np.uint64)[passing]).astype(np.int64)
        cols = [part, a.astype(np.int64), d.astype(np.int64), late, doc, tie, start.astype(np.int32), n.astype(np.int32), kind]
        return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in cols], schema=_DEALT)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            late, doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            done = 0
            for part in pieces(batch, 3):
                cut = Cut(part.column(3), length)
                rows = cut.doc + done
                done += part.num_rows
                held.append((late[rows].astype(bool), doc[rows], tie[rows], cut.start, cut.n, cut.anchor, cut.piece))
                count += len(rows)
                if count >= FOLD:
                    yield emit(held)
                    held, count = [], 0
        if count:
            yield emit(held)
        give_back()

    return go


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt by anchor and sorted by it, the piece and its place: copies of a piece go, first ones are wanted where the anchor has others."""
    names = _DEALT.names
    tail: list[np.ndarray] | None = None
    told = rivals_told = False

    def out(cols: list[np.ndarray], keep: np.ndarray, kind: int) -> pa.RecordBatch:
        by = dict(zip(names, cols, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int32)), *[pa.array(by[c][keep]) for c in ("a", "late", "doc", "tie", "start", "n")]], names=["kind", "a", "late", "doc", "tie", "start", "n"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kind = cols[8]
        for passing in (WANTED, GONE):
            if (kind == passing).any():
                yield out(cols, kind == passing, passing)
        own = kind < WANTED
        if not own.any():
            continue
        cols = [c[own] for c in cols]
        if tail is not None:
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
        a, d, kind = cols[1], cols[2], cols[8]
        n = len(a)
        new_a, new_d, new = np.ones(n, bool), np.ones(n, bool), np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_d[1:] = new_a[1:] | (d[1:] != d[:-1])
        new[1:] = new_d[1:]
        for c in cols[3:7]:
            new[1:] |= c[1:] != c[:-1]
        run = np.cumsum(new_a) - 1
        rivals = np.bincount(run[new_d]) >= 2
        rivals |= np.bincount(run, weights=kind == RIVAL) > 0
        rivals[0] |= tail is not None and rivals_told
        wanted = new_d & rivals[run]
        if tail is not None and told:
            wanted[0] = False
        yield out(cols, wanted, WANTED)
        yield out(cols, new & ~new_d, GONE)
        rivals_told = told = bool(rivals[-1])
        last = int(np.flatnonzero(new_d)[-1])
        tail = [c[last : last + 1] for c in cols]


class Automaton:
    """A suffix automaton over several texts of words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def match(self, text: list[int], length: int) -> list[int]:
        """The last words (their places) of all windows of ``length`` words that the automaton holds."""
        nxt, link, size = self.next, self.link, self.size
        state = held = 0
        ends = []
        for k, c in enumerate(text):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                held = size[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                held += 1
                if held >= length:
                    ends.append(k)
        return ends

    def enter(self, text: list[int]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            p = last
            if q is None:
                cur = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur = -1
            twin = len(nxt)
            nxt.append(dict(nxt[q]))
            size.append(size[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = twin
                p = link[p]
            link[q] = twin
            if cur >= 0:
                link[cur] = twin
                last = cur
            else:
                last = twin


def _spans_of(ends: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of windows: the place of the first and their number."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and out[-1][0] + out[-1][1] == e - length + 1:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((e - length + 1, 1))
    return out


def _stream(length: int):
    """Pieces sorted by shard and place, matched with the automaton of those before and entered."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, None
        held, ids = Automaton(), {}
        for batch in batches:
            got: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != shard:
                    shard, held, ids, seen = row[0], Automaton(), {}, None
                place = row[1:5]
                if place == seen:
                    continue
                seen = place
                text = [ids.setdefault(w, len(ids)) for w in row[5].split(b" ")]
                ends = held.match(text, length)
                got.extend((*place[:3], place[3] + at, n) for at, n in _spans_of(ends, length))
                if len(ends) < len(text) - length + 1:
                    old = set(ends)
                    new = [e for e in range(length - 1, len(text)) if e not in old]
                    held.enter(text[new[0] - length + 1 : new[-1] + 1])
            if got:
                yield _batch(got, _RUNS)

    return go


def _texts(length: int, shards: int):
    """The words of wanted pieces, dealt to the shard of their anchor; of an anchor with too many, window by window, equal ones of a batch once."""
    schema = pa.schema([("shard", pa.int64()), ("late", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("n", pa.int32())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            done = 0
            first: dict[bytes, tuple] = {}
            for part in pieces(batch, 3):
                late, doc, tie = (part.column(k).to_pylist() for k in range(3))
                cut = Cut(part.column(3), length)
                for i, found in enumerate(part.column(4).to_pylist()):
                    for p in found:
                        if not p["hot"]:
                            rows.append((p["a"] % shards, late[i], doc[i], tie[i], p["start"], cut.words(i, p["start"], p["n"] + length - 1), 0))
                            continue
                        for k in range(p["start"], p["start"] + p["n"]):
                            text, own = cut.words(i, k, length), (late[i], doc[i], tie[i], k)
                            other = first.setdefault(text, own)
                            if other > own:
                                first[text], other, own = own, own, other
                            if other != own:
                                rows.append((-1, *own, b"", 1))
                done += part.num_rows
            for text, own in first.items():
                rows.append((int.from_bytes(_digest(text), "little", signed=True) % shards, *own, text, 0))
            if rows:
                for s in range(0, len(rows), 20_000):
                    yield _batch(rows[s : s + 20_000], schema)
        give_back()

    return go


def _digest(text: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(text, digest_size=8).digest()


def _without(length: int):
    """Rows with their text and the runs of repeated windows: the words that stay, and the spans of those that went."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                count, gone, kept, spans = [], [], [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    count.append(len(words))
                    if not runs:
                        gone.append(0)
                        kept.append(b" ".join(words).decode())
                        spans.append([])
                        continue
                    packed = np.array(runs, np.int64)
                    at, n = packed >> 32, packed & 0xFFFFFFFF
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + n + length - 1, -1)
                    stays = np.cumsum(depth[:-1]) == 0
                    step = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]]).astype(np.int8)))
                    gone.append(int((~stays).sum()))
                    kept.append(b" ".join(compress(words, stays.tolist())).decode())
                    spans.append([{"start": a, "end": b} for a, b in step.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["row", "n_words", "n_removed", "kept", "spans"],
                )

    return go


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with what orders them: late (no id), doc, and tie, a hash of the text where ids repeat."""
    again = docs.groupBy(F.col(id_col)).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    tie = F.xxhash64(F.col(text_col)) if again else F.lit(0).cast("long")
    return docs.select(F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc"), tie.alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def repeated_windows(source: DataFrame, length: int) -> DataFrame:
    """Of texts with their key: runs of ``n`` windows from a word ``start`` on, whose words all start earlier too."""
    spark, key = source.sparkSession, PLACE[:3]
    dealt = source.mapInArrow(_fold(length), "part long, a long, d long, late boolean, doc long, tie long, start int, n int, kind int")
    met = dealt.repartition(width(spark), "part").sortWithinPartitions("part", "a", "d", *PLACE).mapInArrow(_meet, _FOUND)
    met = settle(met)
    wanted = met.where(F.col("kind") == WANTED)
    many = settle(wanted.groupBy("a").agg(F.count("*").alias("held")).where(F.col("held") > SHARD).select("a", F.lit(True).alias("hot")))
    shards = max(1, (wanted.agg(F.sum("n")).first()[0] or 0) // (SHARD * (length - GRAM + 1) // 2))
    wanted = wanted.join(many, "a", "left").groupBy(*key).agg(F.collect_set(F.struct("start", "n", "a", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    texts = source.join(wanted, key).select(*key, "text", "found").mapInArrow(_texts(length, shards), "shard long, late boolean, doc long, tie long, start int, words binary, n int")
    texts = settle(texts)
    streamed = texts.where("shard >= 0").select("shard", *PLACE, "words").repartition(width(spark), "shard").sortWithinPartitions("shard", *PLACE)
    found = streamed.mapInArrow(_stream(length), _SPANS)
    return met.where(F.col("kind") == GONE).select(*PLACE, "n").unionByName(texts.where("shard < 0").select(*PLACE, "n")).unionByName(found)


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with n_words, n_removed, kept_text (what stays, single-spaced) and removed_spans (first word and the one after the last)."""
    if length < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    keyed, key = _keyed(docs, id_col, text_col), PLACE[:3]
    runs = repeated_windows(keyed.select(*key, text_of(f"row.`{text_col}`").alias("text")), length).select(*key, F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("run"))
    runs = runs.groupBy(*key).agg(F.collect_set("run").alias("runs"))
    kind = T.StructType([T.StructField("row", keyed.schema["row"].dataType), *T._parse_datatype_string("n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>").fields])
    told = keyed.join(runs, key, "left").select("row", text_of(f"row.`{text_col}`").alias("text"), "runs").mapInArrow(_without(length), kind)
    names = list(docs.columns)
    out = [F.col("row")[c].alias(c) for c in docs.columns]
    for new, c in (("n_words", "n_words"), ("n_removed", "n_removed"), ("kept_text", "kept"), ("removed_spans", "spans")):
        names.append(free_name(names, new))
        out.append(F.col(c).alias(names[-1]))
    return told.select(*out)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op11_substring_dedup": op11_substring_dedup}
SQL = {
    "op11_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS k FROM s),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""
}
