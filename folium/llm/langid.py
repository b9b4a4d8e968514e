"""Language identification of mixed-language text.

Each word is scored for each language: the log-likelihoods of its character n-grams (with its edges) under counts that Spark
gathers from labelled documents. The scripts of a word's letters narrow the candidates first: a language whose training text
hardly uses a script cannot label words of it. A Viterbi pass over the words, with a penalty for each switch, labels spans;
the language that holds most letters is the document's, and its share of the letters, times its mean posterior there, the score.

All documents train, or a bounded sample by the caller's choice; n-grams are hashed into ``CELLS`` counters a language, so the model's size
is ``CELLS`` floats for each language that the labels name; ``most`` lets a caller keep those with most documents only.

Defined results: a null text, and one without letters, is ``und`` with score 0; with nothing to learn from all texts are ``und``;
repeated rows each get a result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import table
from folium.llm.shingles import _LOWER, _SPACE, _bytes, mix, pieces

CELLS = 1 << 16
ORDERS = (1, 2, 3, 4)
SWITCH = 6.0
UNKNOWN = "und"
#: First code points of the script blocks told apart, in order; everything between two belongs to the earlier one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
NAMES = sorted({n for _, n in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS])
_KIND = np.array([NAMES.index(n) for _, n in SCRIPTS])
_STEP = np.random.default_rng(77).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """The distinct words of a batch of texts, and where they stand."""

    which: np.ndarray  # of each word in order, its place among the distinct ones
    at: np.ndarray  # offsets of each text's words
    letters: np.ndarray  # of each distinct word
    script: np.ndarray  # a bit for each script of its letters
    cells: np.ndarray  # n-gram counters of all distinct words
    cell_at: np.ndarray  # and their offsets


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD7A4 <= c < 0x20000:
            out[c] = chr(c).isalpha()
        else:
            out[c] = c < 0xD800 or c >= 0x20000 and c < 0x323B0
    return out


_IS_LETTER: list[np.ndarray] = []


def is_letter(code: np.ndarray) -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    return _IS_LETTER[0][code]


def words_of(texts: pa.Array) -> Words:
    """Words of all texts: runs of bytes without white space, A-Z lower-cased; ASCII digits and signs count as edges."""
    from folium.llm.shingles import words

    data, offsets = _bytes(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = _LOWER[data[low:high]], offsets - low
    h, at = words(texts)
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not len(h):
        return Words(empty, at, empty, empty, empty, np.zeros(1, np.int64))
    space = _SPACE[data]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    prev, nxt = np.ones(n, bool), np.ones(n, bool)
    prev[1:], nxt[:-1] = space[:-1], space[1:]
    begin = np.flatnonzero(~space & (prev | inner[:n]))
    end = np.flatnonzero(~space & (nxt | inner[1:])) + 1
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    # Code points of the distinct words, each with an edge before and after.
    joined = b" ".join(data[a:b].tobytes() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)).decode("utf-8", "replace")
    code = np.frombuffer((" " + joined.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    code = np.where(is_letter(code), code, 32)
    # Lower-casing may lengthen a word but never adds a space: words stay apart by the spaces that were put in.
    gap = np.frombuffer((" " + joined.lower() + " ").encode("utf-32-le", "replace"), np.uint32) == 32
    owner = np.cumsum(gap) - 1
    owner = np.minimum(owner, len(first) - 1)
    letter = code != 32
    count = np.bincount(owner[letter], minlength=len(first))
    kind = _KIND[np.searchsorted(_FIRST, code, side="right") - 1]
    script = np.zeros(len(first), np.int64)
    np.bitwise_or.at(script, owner[letter], 1 << kind[letter])
    cells, owners = [], []
    key = np.zeros(len(code), np.uint64)
    middle = np.ones(len(code), bool)
    for k in range(max(ORDERS)):
        m = max(len(code) - k, 0)
        key = key[:m] + mix(code[k:].astype(np.uint64) + _STEP[k])
        # An n-gram may begin and end with an edge; what stands between are letters of one word.
        if k >= 2:
            middle = middle[:m] & letter[k - 1 : k - 1 + m]
        if k + 1 in ORDERS:
            start, stop = letter[:m], letter[k:]
            inside = start if k == 0 else middle[:m] & (start | stop if k == 1 else True)
            own = np.where(start, owner[:m], owner[min(k, 1) : m + min(k, 1)])
            cells.append((mix(key + np.uint64(k))[inside] % np.uint64(CELLS)).astype(np.int64))
            owners.append(own[inside])
    cells, owners = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return Words(which, at, count, script, cells[order], np.searchsorted(owners[order], np.arange(len(first) + 1)))


# ---- learning

#: Documents of a language that train it, about; None for all.
SAMPLE = 4000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "text", 1 << 19):
            langs = part.column(1).to_pylist()
            w = words_of(part.column(0))
            for lang in set(langs):
                own = np.concatenate([np.arange(w.at[i], w.at[i + 1]) for i, v in enumerate(langs) if v == lang])
                times = np.bincount(w.which[own], minlength=len(w.letters)) if len(own) else np.zeros(len(w.letters), np.int64)
                held = cells.setdefault(lang, np.zeros(CELLS + len(NAMES), np.int64))
                held[:CELLS] += np.bincount(w.cells, weights=np.repeat(times, np.diff(w.cell_at)), minlength=CELLS).astype(np.int64)
                for b in range(len(NAMES)):
                    held[CELLS + b] += int((times * w.letters)[(w.script >> b) & 1 == 1].sum())
    for lang, held in cells.items():
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(held[some])], names=["lang", "cell", "n"])


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # (cells, languages): log-probabilities, divided by the number of orders
    scripts: np.ndarray  # of each language: the bits of its scripts


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int | None = SAMPLE, most: int | None = None) -> Model:
    """Counts of n-grams by language, gathered by Spark. ``sample`` bounds the documents of each language that are read.

    The driver gets one array a language. ``most`` bounds the languages; None learns all that the labels name.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col, lang_col).alias("draw")).where("text is not null and lang is not null")
    counts = sorted((r["lang"], r["count"]) for r in docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most or 2**31 - 1).collect())
    langs = [k for k, _ in counts]
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0, np.int64))
    share = F.lit(0)
    for k, n in counts:
        share = F.when(F.col("lang") == k, F.lit(1_000_000 if sample is None or n <= sample else max(1, sample * 1_000_000 // n))).otherwise(share)
    drawn = rows.where(F.pmod("draw", F.lit(1_000_000)) < share).select("text", "lang")
    got = drawn.mapInArrow(_counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = got.groupBy("lang").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))  # CELLS at most in each
    table_ = np.zeros((CELLS + len(NAMES), len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in got.toLocalIterator():
        table_[np.array(r["cell"]), place[r["lang"]]] += np.array(r["n"])
    cells, scripts = table_[:CELLS] + 0.5, table_[CELLS:]
    log = np.log(cells / cells.sum(axis=0)) / len(ORDERS)
    used = scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, log.astype(np.float32), (used * (1 << np.arange(len(NAMES)))[:, None]).sum(axis=0))


# ---- labelling


def scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: log-likelihoods by language, the scripts' candidates only, and posteriors."""
    n = len(w.letters)
    total = np.zeros((n, len(model.langs)), np.float32)
    has = np.flatnonzero(np.diff(w.cell_at))
    for part in np.array_split(has, max(1, len(w.cells) * len(model.langs) // 4_000_000)):
        if len(part):
            a, b = w.cell_at[part[0]], w.cell_at[part[-1] + 1]
            total[part] = np.add.reduceat(model.log[w.cells[a:b]], w.cell_at[part] - a, axis=0)
    fits = (w.script[:, None] & ~model.scripts[None, :]) == 0
    some = fits.any(axis=1) & (w.letters > 0)
    total = np.where(some[:, None], np.where(fits, total, total.min(axis=1, keepdims=True) - 30), 0).astype(np.float32)
    post = np.exp(total - total.max(axis=1, keepdims=True))
    return total, post / post.sum(axis=1, keepdims=True)


def viterbi(emit: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of all words of all texts: word by word, all texts that are long enough at once."""
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    begin, length = at[:-1][order], count[order]
    longest = int(length[0]) if len(length) else 0
    out = np.zeros(len(emit), np.int64)
    if not longest or emit.shape[1] < 2:
        return out
    live = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # texts with more than t words
    best = np.zeros(len(emit), np.int16)
    stay = np.zeros(emit.shape, bool)
    now = emit[begin[: live[0]]].copy()
    for t in range(1, longest):
        d = live[t]
        now = now[:d]
        place = begin[:d] + t
        top = now.max(axis=1)
        best[place] = now.argmax(axis=1)
        keeps = now >= (top - switch)[:, None]
        stay[place] = keeps
        now = np.where(keeps, now, (top - switch)[:, None]) + emit[place]
        out[place] = now.argmax(axis=1)  # right where the text ends here; put right below elsewhere
    first = begin[: live[0]]
    one = length[: live[0]] == 1
    out[first[one]] = emit[first[one]].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        d = live[t]
        place = begin[:d] + t
        mine = out[place]
        out[place - 1] = np.where(stay[place, mine], mine, best[place])
    return out


RESULT = "lang_pred string, score double, spans array<struct<first_word:long,words:long,lang:string>>"


SPAN = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])


def _labelled(model: Model, with_spans: bool):
    """Columns lang_pred, score and (on demand) spans of the texts of a batch."""
    names = pa.array([*model.langs, UNKNOWN], pa.string())
    n = len(model.langs)

    def decide(held: list[tuple[Words, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        emit = np.concatenate([s[w.which] for w, s, _ in held])
        shift = np.cumsum([0] + [len(w.which) for w, _, _ in held])
        at = np.concatenate([w.at[:-1] + o for (w, _, _), o in zip(held, shift, strict=False)] + [shift[-1:]])
        label = viterbi(emit, at)
        letters = np.concatenate([w.letters[w.which] for w, _, _ in held])
        sure = np.concatenate([p[w.which, label[o : o + len(w.which)]] for (w, _, p), o in zip(held, shift, strict=False)])
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        share = np.bincount(text * n + label, weights=letters, minlength=(len(at) - 1) * n).reshape(-1, n)
        belief = np.bincount(text * n + label, weights=letters * sure, minlength=(len(at) - 1) * n).reshape(-1, n)
        total, top = share.sum(axis=1), share.argmax(axis=1)
        some = total > 0
        told = np.where(some, top, n)
        score = np.where(some, np.minimum(1.0, belief[np.arange(len(top)), top] / np.maximum(total, 1)), 0.0)
        out = [names.take(pa.array(told)), pa.array(score)]
        if with_spans:
            # A span begins where a text does or the label changes; texts without a letter have none.
            first = np.zeros(len(label) + 1, bool)
            first[at] = True
            first[1:-1] |= label[1:] != label[:-1]
            begin = np.flatnonzero(first[:-1])
            begin = begin[some[text[begin]]]
            stop = np.append(np.flatnonzero(first[1:]) + 1, 0)
            length = stop[np.searchsorted(stop[:-1], begin, side="right")] - begin
            cols = [pa.array(begin - at[text[begin]]), pa.array(length), names.take(pa.array(label[begin]))]
            offsets = np.searchsorted(text[begin], np.arange(len(at)))
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(SPAN))))
        return out

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        told: list[list[pa.Array]] = []
        held: list[tuple[Words, np.ndarray, np.ndarray]] = []
        most, words = max(1, 4_000_000 // max(1, n)), 0
        for part in pieces(batch, 0, 1 << 19):
            w = words_of(part.column(0))
            if not model.langs:
                nothing = [pa.array([UNKNOWN] * part.num_rows, pa.string()), pa.array(np.zeros(part.num_rows))]
                told.append([*nothing, pa.array([[]] * part.num_rows, pa.list_(SPAN))] if with_spans else nothing)
                continue
            held.append((w, *scores(w, model)))
            words += len(w.which)
            if words > most:
                told.append(decide(held))
                held, words = [], 0
        if held:
            told.append(decide(held))
        return [pa.concat_arrays(c) for c in zip(*told, strict=True)]

    return of


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """The documents with lang_pred, score and (on demand) spans of words in one language.

    The model has ``CELLS`` floats a language and is sent to each executor once.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    given = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kept = docs.select(*given)
    result = RESULT if with_spans else RESULT.split(", spans")[0]
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(result).fields])
    at_text = given.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _labelled(sent.value, with_spans)
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at_text).cast(pa.large_string())], names=["text"])
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *of(plain)], names=[*given, "lang_pred", "score", "spans"][: len(given) + (3 if with_spans else 2)])

    return kept.mapInArrow(go, schema)


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def known(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: those with an id whose crc32 leaves another remainder than 2."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(known(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
