"""Byte-level BPE with the merge ranks of a public vocabulary: encoding and decoding by DuckDB within Spark's partitions.

A text is cut into words by the vocabulary's pattern. The distinct words of a piece of a partition that the vocabulary does
not hold whole become rows (word, position, token), one a byte. A recursive query joins neighbours with the merge table and
contracts, in each word, the leftmost pair of the least rank; words without a pair left are done. Decoding joins the ids with
the vocabulary and gathers the bytes in order of position.

Cutting is done for all texts of a piece at once: runs of letters, numbers, other signs and white space, a space that joins
what follows, and the contractions; this is what the pattern ``PATTERN`` of the vocabulary says. Words met before are
remembered, up to a bound.

Defined results: a null text is the empty text, with no ids; repeated rows each get a result; an empty table gives an empty one; a
text is never cut short, however long.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession

from folium.llm.common import free_name, table, text_of
from folium.llm.shingles import _BASE, _bytes, _power, give_back, mix, pieces

#: The pattern that this module follows; a vocabulary with another one is not for it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered in a task, rows that a query makes at most, and bytes of a word beyond which a heap takes it.
REMEMBERED = 500_000
ROWS = 500_000
LONG = 1000
SPACE, LETTER, NUMBER, OTHER = range(4)
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: A row's spot is its word's number and its first byte's place in it; stop is the spot after its last byte.
ENCODE = """
WITH RECURSIVE step(spot, stop, tok, turn) AS (
  SELECT spot, spot + 1, tok, 0 FROM given
  UNION ALL
  (WITH pair AS (
     SELECT a.spot >> 32 AS word, (rank::BIGINT << 32) | (a.spot & 4294967295) AS k, a.stop AS mid, b.stop AS stop
     FROM step a JOIN step b ON b.spot = a.stop JOIN merges ON merges.pair = ((a.tok::BIGINT << 32) | b.tok)),
   best AS MATERIALIZED (SELECT word, min(k) AS k, arg_min(mid, k) AS mid, arg_min(stop, k) AS stop FROM pair GROUP BY word)
   SELECT s.spot, CASE WHEN s.stop = best.mid THEN best.stop ELSE s.stop END, CASE WHEN s.stop = best.mid THEN (best.k >> 32)::INT ELSE s.tok END, turn + 1
   FROM step s JOIN best ON s.spot >> 32 = best.word WHERE s.spot <> best.mid)),
done AS (SELECT spot >> 32 AS word, max(turn) AS turn FROM step GROUP BY spot >> 32)
SELECT done.word, list(tok ORDER BY spot) AS toks FROM step JOIN done ON step.spot >> 32 = done.word AND step.turn = done.turn GROUP BY done.word ORDER BY done.word
"""
DECODE = "SELECT doc, string_agg(hex, '') AS hex FROM (SELECT doc, pos, hex FROM ids JOIN vocab USING (tok) ORDER BY doc, pos) GROUP BY doc ORDER BY doc"

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        out = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                out[c] = LETTER
            elif kind == "N":
                out[c] = NUMBER
        out[list(WHITE)] = SPACE
        _classes.append(out)
    return _classes[0]


def cuts(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of several texts, the texts beginning at ``starts`` (sorted, each holding some)."""
    n = len(code)
    kind = classes()[code]
    head = np.zeros(n + 1, bool)
    head[starts] = True
    head[n] = True
    edge = head.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    at = edge[:n].copy()
    space = kind == SPACE
    # The last of several white spaces before something else stands apart.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    at |= last
    # One space belongs to what follows it.
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (code[:-1] == 32)
    at &= ~joined
    # An apostrophe alone, and not after a joined space, takes a contraction's letters.
    mark = np.flatnonzero((code == 39) & edge[:n] & edge[1:] & at)
    if len(mark):
        wide = np.concatenate([code, [0, 0]])
        one, two = wide[mark + 1], wide[mark + 2]
        same = np.concatenate([edge, [True]])
        ends = head[mark + 1]
        single = ~ends & np.isin(one, [ord(c) for c in "stmd"])
        double = ~ends & ~same[np.minimum(mark + 2, n + 1)] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for chosen, length in ((single, 1), (double, 2)):
            m = mark[chosen]
            at[m + 1] = False
            rest = m + 1 + length
            rest = rest[rest < n]
            at[rest] = True  # the rest of the letters, or what begins there anyway
            # A joined space's follower begins at the space: only letters that go on begin here.
            back = rest[joined[rest]]
            at[back] = False
    return np.flatnonzero(at)


def hashes(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs code[begin:end]."""
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, len(code)), out=total[1:])
    back = _power("inverse", pow(_BASE, -1, 2**64), len(code) + 1)
    return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


class Coder:
    """A vocabulary in DuckDB, and the words met so far."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "autoinstall_known_extensions": False, "temp_directory": ""})
        self.db.register("v", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.db.unregister("v")
        # Every way to cut a token in two tokens is a pair that merges into it.
        self.db.execute("""CREATE TABLE merges AS SELECT (a.tok::BIGINT << 32) | b.tok AS pair, v.tok AS rank
            FROM vocab v, unnest(range(2, length(v.hex), 2)) AS u(cut) JOIN vocab a ON a.hex = v.hex[1:cut] JOIN vocab b ON b.hex = v.hex[cut + 1:]""")
        self.pairs: dict[int, int] = {}
        # Words that the vocabulary holds whole are known from the start.
        whole = []
        for t, r in ranks.items():
            try:
                whole.append((np.array([ord(c) for c in t.decode("utf-8")], np.int64), r))
            except UnicodeDecodeError:
                continue
        ends = np.cumsum([len(c) for c, _ in whole])
        h = hashes(np.concatenate([c for c, _ in whole]), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        self.first = h[order], np.arange(len(h))[order], np.array([r for _, r in whole], np.int32)
        self.forget()

    def forget(self) -> None:
        """Sorted hashes of the words known, the slot of each, and where the slots' ids begin."""
        self.hash, self.slot, self.ids = self.first
        self.begin = np.arange(len(self.ids) + 1)

    def contract(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[begin:end], one after the other, and their numbers, by the recursive query."""
        length = end - begin
        if (length > LONG).any():
            # The recursive query keeps every step of a word: the square of its length.
            parts = [self.heap(data[a:b]) if b - a > LONG else None for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            short = length <= LONG
            ids, counts = self.contract(data, begin[short], end[short]) if short.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            rest = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            parts = [next(rest) if x is None else x for x in parts]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        ids, counts, low = [], [], 0
        # A bounded number of rows a query: a word has one for each byte and step.
        upto = np.cumsum(length * (length + 1) // 2)
        while low < len(length):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ROWS, side="right")))
            n = length[low:high]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = data[np.repeat(begin[low:high], n) + place]
            self.db.register("given", pa.table({"spot": (np.repeat(np.arange(len(n)), n) << 32) | place, "tok": self.byte[flat]}))
            toks = self.db.sql(ENCODE).to_arrow_table().column("toks").combine_chunks()
            self.db.unregister("given")
            ids.append(toks.flatten().to_numpy())
            counts.append(toks.value_lengths().to_numpy())
            low = high
        return np.concatenate(ids).astype(np.int32), np.concatenate(counts).astype(np.int64)

    def heap(self, word: np.ndarray) -> np.ndarray:
        """The same contraction of one very long word, by a heap of its pairs."""
        import heapq

        if not self.pairs:
            self.pairs = dict(self.db.sql("SELECT pair, rank FROM merges").fetchall())
        tok = self.byte[word].tolist()
        after, before = [*range(1, len(tok)), -1], list(range(-1, len(tok) - 1))
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (r := self.pairs.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue
            tok[i], tok[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := self.pairs.get(tok[x] << 32 | tok[y])) is not None:
                    heapq.heappush(heap, (k, x, tok[x], tok[y]))
        return np.array([t for t in tok if t >= 0], np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the offsets of each text's ids."""
        data, offsets = _bytes(texts)
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        point = np.searchsorted(byte_at, offsets)
        begin = cuts(code, np.unique(point[:-1][point[:-1] < point[1:]]))
        end = np.append(begin[1:], len(code))
        distinct, first, which = np.unique(hashes(code, begin, end), return_index=True, return_inverse=True)
        if len(self.hash) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.hash, distinct)
        new = self.hash[np.minimum(spot, len(self.hash) - 1)] != distinct
        if new.any():
            j = first[new]
            ids, counts = self.contract(data, byte_at[begin[j]], byte_at[end[j]])
            self.slot = np.insert(self.slot, spot[new], len(self.begin) - 1 + np.arange(len(j)))
            self.hash = np.insert(self.hash, spot[new], distinct[new])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
            spot = np.searchsorted(self.hash, distinct)
        slot = self.slot[spot][which]
        start = self.begin[slot]
        length = self.begin[slot + 1] - start
        stop = np.cumsum(length)
        out = self.ids[np.repeat(start - (stop - length), length) + np.arange(stop[-1])]
        return out, np.concatenate([[0], stop])[np.searchsorted(begin, point)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        count = np.diff(at)
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "tok": ids.astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(count)
        for d, x in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True):
            out[d] = bytes.fromhex(x)
        return out


@contextlib.contextmanager
def coder(path: str) -> Iterator[Coder]:
    """A coder for one task: workers live on, and what they hold is the executor's."""
    own = Coder(path)
    try:
        yield own
    finally:
        own.db.close()
        del own
        give_back()


def encode(docs: DataFrame, path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Adds n_tokens and ids (array<int>), or with ``digests`` ids_sha256 and decoded_sha256 after a full round trip.

    ``path`` is the vocabulary's place on every executor.
    """
    given = [c for c in docs.columns if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    held = free_name(docs.columns, "_text")
    kept = docs.withColumn(held, text_of(text_col)).select(*[c for c in given if not (digests and c == text_col)], held)
    given = kept.columns[:-1]  # with digests nobody reads the text again
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>"
    schema = T.StructType([*kept.schema.fields[:-1], *T._parse_datatype_string(added).fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path) as own:
            yield from coded(own, batches)

    def coded(own: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, 1 << 19):
                ids, at = own.encode(part.column(part.num_columns - 1))
                n = pa.array(np.diff(at))
                if digests:
                    raw = ids.astype("<u4").tobytes()
                    sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [n, pa.array(sha, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, at)], pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    cols, names = [n, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*given, *names])

    return kept.mapInArrow(go, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids (a null list is empty)."""
    given = [c for c in rows.columns if c != out]
    schema = T.StructType([*rows.select(*given).schema.fields, T.StructField(out, T.BinaryType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path) as own:
            yield from decoded(own, batches)

    def decoded(own: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = part.column(part.schema.get_field_index(ids_col))
                length = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bytes_ = own.decode(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(length)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bytes_, pa.binary())], names=[*given, out])

    return rows.select(*given).mapInArrow(go, schema)


def vocabulary() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the vocabulary cuts words by another pattern")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), digests=True)


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
