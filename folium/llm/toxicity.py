"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

The kernel of two strings is the sum over their common subsequences of four characters within a span of six; each occurrence counts
``DECAY`` to the power of the characters that it skips, times the rarity of the subsequence. So "id-iot", "idxiot" and "id iot"
stay close to "idiot". A sentence is a bag of short windows: its words (long ones in overlapping pieces), and pairs of neighbouring words where one
of them is partly like a landmark. Landmarks are windows of training sentences: those that set toxic texts apart, and common ones of
the others. A window's features are its kernel values with the landmarks, whitened (Nyström); a linear machine with a squared hinge is
trained on windows: labels belong to texts, so a clean text's sentences have clean windows only, while of a toxic text's sentences one
has one toxic window at least, its witness, which each round picks anew. A sentence is as toxic as its worst window and a text as its worst sentence. A logistic
curve, fitted on training texts and on toxic ones with their worst window bent by one inserted character, turns that into a probability.

As the kernel is a product of sparse feature vectors, the machine folds into one weight for each subsequence, and scoring a
text is a look-up per subsequence of its distinct windows. Runs of single characters ("i d i o t") are windows too.

Training reads at most about ``SAMPLE`` labelled rows of each class, of up to ``TRAIN_CHARS`` characters; scoring reads every whole text.

Defined results: null, empty and wordless texts score like a text whose words are unlike any landmark; without labels of both kinds all texts
score 0; repeated rows each get a result; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import free_name, table, text_of
from folium.llm.shingles import _LOWER, _SPACE, _bytes, mix, pieces

#: Offsets of a subsequence's later characters, and the weight of each character that it skips.
DECAY = 0.8
SPANS = tuple((i, j, k) for k in range(3, 6) for j in range(2, k) for i in range(1, j))
CELLS = 1 << 21
SAMPLE, TRAIN_CHARS = 4000, 8_000
LANDMARKS = 96  # of each kind
ROUNDS = 4
HARD = 2000  # clean words that a round adds at most
COST = 4.0
#: Of the texts that hold a word, or four characters that words share, so many must be toxic for it to be a toxic one's mark.
SURE = 0.5
#: How much a toxic text weighs against a clean one when the threshold is set: to leave clean texts alone counts for more.
CAUGHT = 0.35
#: Characters of a window at most; a longer word gives windows that overlap by half.
WINDOW = 24
#: A word is looked at together with its neighbours from this share of the way to the threshold on.
LOOK = 0.25
_STEP = np.random.default_rng(99).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Units:
    """The distinct words of texts, and their occurrences in order."""

    which: np.ndarray  # of each occurrence, its place among the distinct words
    at: np.ndarray  # offsets of each text's occurrences
    words: list[str]
    last: np.ndarray  # of each distinct word: whether it ends a sentence


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts: runs without white space, A-Z lower-cased, and runs of three or more single characters joined."""
    data, offsets = _bytes(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = _LOWER[data[low:high]], offsets - low
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
    from folium.llm.shingles import words

    h, at = words(texts)
    if not len(h):
        return np.zeros(0, np.int64), at, []
    space = _SPACE[data]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    prev, nxt = np.ones(n, bool), np.ones(n, bool)
    prev[1:], nxt[:-1] = space[:-1], space[1:]
    begin = np.flatnonzero(~space & (prev | inner[:n]))
    end = np.flatnonzero(~space & (nxt | inner[1:])) + 1
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    distinct = [data[a:b].tobytes() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    # Spelled-out words: each becomes a word in the place of its last character.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = points[end] - points[begin] == 1
    if single.any():
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        cut = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (text[1:] != text[:-1])]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(single)], strict=True):
            if single[a] and b - a >= 3:
                distinct.append(b"".join(data[begin[k] : end[k]].tobytes() for k in range(a, b)))
                which[b - 1] = len(distinct) - 1
    return which, at, distinct


def subsequences(words: list[str], spans: tuple = SPANS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, cell and weight of each subsequence of the words."""
    joined = "\x00".join([*(f"\x02{w}\x03" if w else "" for w in words), ""]) + "\x00" * 5
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    stop = code == 0
    owner = np.cumsum(stop) - stop
    n = len(code) - 5
    ends = np.cumsum(stop)  # equal at two places: no end lies between
    key0 = mix(code + _STEP[0])
    key1, key2, key3 = (mix(code + _STEP[k]) for k in (1, 2, 3))
    owners, cells, weights = [], [], []
    for k in sorted({s[-1] for s in spans}):
        ok = np.flatnonzero(~stop[:n] & (ends[k : n + k] == ends[:n]))
        own, ends_key = owner[ok], key0[ok] ^ key3[ok + k]
        for i, j in (s[:2] for s in spans if s[-1] == k):
            key = ends_key + key1[ok + i] + (key2[ok + j] << np.uint64(1))
            cells.append(((key ^ (key >> np.uint64(29))) & np.uint64(CELLS - 1)).astype(np.int64))
            owners.append(own)
            weights.append(np.full(len(ok), DECAY ** (k - 3)))
    owners, cells, weights = map(np.concatenate, (owners, cells, weights))
    return owners, cells, weights


def unit(owner: np.ndarray, cell: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of strings whose kernel with themselves is 1; a subsequence that occurs twice counts as one of twice the weight."""
    both, where = np.unique(owner * CELLS + cell, return_inverse=True)
    total = np.bincount(where, weights=weight)
    norm = np.sqrt(np.bincount(both // CELLS, weights=total**2, minlength=n))
    return weight / np.maximum(norm, 1e-9)[owner]


def windows(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Windows of words, and the word of each."""
    out, owner = [], []
    for k, w in enumerate(words):
        for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
            out.append(w[i : i + WINDOW])
            owner.append(k)
    return out, np.array(owner, np.int64)


def cleaned(words: list[bytes]) -> list[str]:
    return [SPELLED.sub(lambda m: m[0].translate(_SIGNS), w) if "." in w or "-" in w or "*" in w or "_" in w else w for w in _plain(words)]


#: A word spelled with a sign between single characters is that word.
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[.*_-][^\W_]){2,}(?![^\W_])")
_SIGNS = {ord(c): None for c in ".*_-"}


def _plain(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace").lower().translate({0: None, 2: None, 3: None}).strip(".,;:!?\"'()[]{}<>|*#$%&-_=+/\\`~") for w in words]


def units(texts: pa.Array) -> Units:
    which, at, distinct = occurrences(texts)
    return Units(which, at, cleaned(distinct), np.array([w.endswith((b".", b"!", b"?", b"|", b";")) for w in distinct], bool))


@dataclass
class Model:
    weight: np.ndarray | None  # of each cell
    rarity: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.folded = None if self.weight is None else (self.weight * self.rarity).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word: that of its worst window."""
        out = np.full(len(words), self.bias)
        for k in range(0, len(words), 10_000):
            part, word = windows(words[k : k + 10_000])
            owner, cell, weight = subsequences(part)
            found = np.bincount(owner, weights=weight * self.folded[cell], minlength=len(part)) + self.bias
            np.maximum.at(out, k + word, found)
        return out

    def worst(self, u: Units) -> np.ndarray:
        """The value of each text's worst window; the bias without words."""
        n = len(u.at) - 1
        worst = np.full(n, self.bias)
        has = np.flatnonzero(np.diff(u.at))
        if not len(has):
            return worst
        found = self.scores(u.words)
        worst[has] = np.maximum(self.bias, np.maximum.reduceat(found[u.which], u.at[has]))
        # Pairs of neighbours in a sentence, one of them partly like a landmark, that make a short window together.
        half = -self.shift / self.slope if self.slope > 0 else np.inf
        size = np.array([len(w) or 99 for w in u.words])
        near = found > self.bias + LOOK * max(half - self.bias, 0.1)
        text = np.repeat(np.arange(n), np.diff(u.at))
        left, right = u.which[:-1], u.which[1:]
        pair = np.flatnonzero((text[1:] == text[:-1]) & (near[left] | near[right]) & ~u.last[left] & (size[left] + size[right] < WINDOW))
        if len(pair):
            key, where = np.unique(left[pair] * len(u.words) + right[pair], return_inverse=True)
            both = self.scores([f"{u.words[k // len(u.words)]} {u.words[k % len(u.words)]}" for k in key.tolist()])
            np.maximum.at(worst, text[pair], both[where])
        return worst

    def texts(self, u: Units) -> np.ndarray:
        """Probabilities: the worst window decides."""
        if self.weight is None:
            return np.zeros(len(u.at) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(u) + self.shift, -40, 40)))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge, by Newton steps; the last column is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.zeros(x.shape[1])
    ridge = np.eye(len(v))
    ridge[-1, -1] = 1e-4

    def cost(v: np.ndarray) -> float:
        slack = np.maximum(0, 1 - y * (x @ v))
        return 0.5 * v @ ridge @ v + COST * (weight * slack**2).sum()

    now = cost(v)
    for _ in range(60):
        slack = 1 - y * (x @ v)
        on = slack > 0
        grad = ridge @ v - 2 * COST * x[on].T @ (weight[on] * y[on] * slack[on])
        part = x[on] * np.sqrt(2 * COST * weight[on][:, None]).astype(x.dtype)
        step = np.linalg.solve(ridge + (part.T @ part).astype(float), grad)
        size = 1.0
        while size > 1e-6 and (then := cost(v - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9 * max(1.0, now):
            break
        v, now = v - size * step, then
    return v[:-1], float(v[-1])


def inserted(word: str) -> list[str]:
    """The word with one character put in at each inner place."""
    return [word[:k] + "-x*o."[k % 5] + word[k:] for k in range(1, len(word))] or [word]


def bent(word: str) -> list[str]:
    """The word with a sign between all its characters, in two parts, and with one character put in at each inner place."""
    return ["-".join(word), ".".join(word), *(word[:k] + " " + word[k:] for k in range(2, len(word) - 1, 2)), *inserted(word)]


def leaning(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of leaning to the second class, less what so many tries reach by chance; negative without it."""
    both, prior = np.maximum(count.sum(axis=0), 1), size[1] / size.sum()
    lean = sum(np.where(c > 0, c * np.log(np.maximum(c, 1) / (both * q)), 0) for c, q in ((count[1], prior), (count[0], 1 - prior)))
    return np.where(count[1] / both > prior, lean, -lean) - np.log(max(1, (count.sum(axis=0) > 0).sum()) / 0.05)


def stems(names: list[str], inside: list[np.ndarray], y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each word the leaning of the four successive characters in it that lean most."""
    cells, starts = [], [0]
    for k in range(0, len(names), 10_000):
        part = names[k : k + 10_000]
        o, c, _ = subsequences(part, SPANS[:1])
        order = np.argsort(o, kind="stable")
        cells.append(c[order])
        starts += (starts[-1] + np.cumsum(np.bincount(o, minlength=len(part)))).tolist()
    cell, start = np.concatenate(cells), np.array(starts)
    count = np.zeros((2, CELLS), np.int64)
    for own, kind in zip(inside, y.tolist(), strict=True):
        n = start[own + 1] - start[own]
        if n.sum():
            held = np.unique(cell[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            count[kind, held] += 1
    lean = np.where(count[1] >= SURE * count.sum(axis=0), leaning(count, size), -np.inf)[cell]
    out = np.full(len(names), -np.inf)
    has = np.flatnonzero(np.diff(start))
    out[has] = np.maximum.reduceat(lean, start[has])
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """The machine from labelled texts (a bounded sample)."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return Model(None, None, 0.0, 1.0, 0.0)
    # Words by number, and the numbers of each text; a few megabytes of text at a time.
    number: dict[str, int] = {}
    inside: list[np.ndarray] = []
    for part in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), "text", 1 << 21):
        which, at, distinct = occurrences(part.column(0))
        name = np.array([number.setdefault(w, len(number)) for w in cleaned(distinct)], np.int64)
        inside += [np.unique(name[which[i:j]]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    names = list(number)
    if not names:
        return Model(None, None, 0.0, 1.0, 0.0)
    # In how many texts of each kind a word stands.
    count = np.stack([np.bincount(np.concatenate([own for own, t in zip(inside, toxic, strict=True) if t == c]), minlength=len(names)) for c in (0, 1)])
    size = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((count[1] + 0.5) / (size[1] + 1)) - np.log((count[0] + 0.5) / (size[0] + 1))
    long_enough = np.array([len(w) >= 3 for w in names])
    # How far a word's texts lean to the toxic side beyond chance, over all words that were tried; and the same for the
    # characters that words share, so that a stem counts with all its endings.
    sure = leaning(count, size)
    stem = stems(names, inside, y, size)
    sure = np.maximum(sure, np.where(count[0] == 0, stem, -np.inf))
    odds = np.where((count[0] == 0) & (stem > 0), np.maximum(odds, 2.0), odds)
    bad = np.flatnonzero(long_enough & (sure > 0) & (odds > 1) & (count[1] >= SURE * count.sum(axis=0)))
    bad = bad[np.lexsort((-count[1][bad], -sure[bad]))][: 16 * LANDMARKS]
    common = np.flatnonzero(long_enough & (count[0] > 0) & (odds < 0.5))
    common = common[np.argsort(-count[0][common], kind="stable")]
    landmark = np.concatenate([bad[: 4 * LANDMARKS], common[:LANDMARKS]])
    if not len(bad):
        return Model(None, None, 0.0, 1.0, 0.0)
    # Landmarks' subsequences are the only ones with a weight.
    # A subsequence that many clean words share tells little: the kernel weighs it by its rarity.
    clean_words = [str(names[k]) for k in np.flatnonzero(count[0] > 0)]
    held = np.zeros(CELLS, np.int64)
    for k in range(0, len(clean_words), 10_000):
        o, c, _ = subsequences(clean_words[k : k + 10_000])
        held += np.bincount(np.unique(o * CELLS + c) % CELLS, minlength=CELLS)
    rarity = np.maximum(np.log((len(clean_words) + 1) / (held + 1)) / np.log(len(clean_words) + 2), 0.02).astype(np.float32) ** 2
    zo, zc, zw = subsequences([names[k][:WINDOW] for k in landmark])
    zw = unit(zo, zc, zw * rarity[zc], len(landmark))
    cells, local = np.unique(zc, return_inverse=True)
    z = np.zeros((len(cells), len(landmark)))
    np.add.at(z, (local, zo), zw)
    kernel = z.T @ z
    values, vectors = np.linalg.eigh(kernel + 1e-6 * np.eye(len(landmark)))
    white = z @ (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # cells x landmarks

    def features(chosen: list[str]) -> np.ndarray:
        out = np.zeros((len(chosen), len(landmark)), np.float32)
        for k in range(0, len(chosen), 200):
            o, c, w = subsequences([v[:WINDOW] for v in chosen[k : k + 200]])
            w = w * rarity[c]
            spot = np.minimum(np.searchsorted(cells, c), len(cells) - 1)
            hit = cells[spot] == c
            order = np.argsort(o[hit], kind="stable")
            rows, spot, w = o[hit][order], spot[hit][order], w[hit][order]
            if len(rows):
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                out[k + rows[first]] = np.add.reduceat(white[spot] * w[:, None], first, axis=0)
        return out

    # Clean texts' words are clean, each weighing by the texts it stands in; a toxic text needs one toxic word at least: its
    # witness. Each round adds the clean words that the machine takes for toxic, and witnesses like the known toxic words.
    clean_word = (count[0] > 0) & long_enough
    negative = np.flatnonzero(clean_word)
    negative = negative[np.argsort(-count[0][negative], kind="stable")][:HARD]
    positive = bad
    # Toxic words with gaps and with a character put in stay toxic.
    x_bent = features([v for k in bad[:LANDMARKS] for v in bent(str(names[k]))])
    for _ in range(ROUNDS):
        negative = np.setdiff1d(negative, positive)
        x = np.vstack([features([str(names[k]) for k in positive]), x_bent, features([str(names[k]) for k in negative])])
        t = np.concatenate([np.ones(len(positive) + len(x_bent)), -np.ones(len(negative))])
        more = max(1.0, np.sqrt(len(negative) / len(positive)))
        w = np.concatenate([np.sqrt(count[1][positive] + 1) * more, np.full(len(x_bent), more), np.sqrt(count[0][negative] + 1)])
        v, bias = _hinge(x, t, w)
        weight = np.zeros(CELLS)
        weight[cells] = white @ v
        machine = Model(weight, rarity, bias, 1.0, 0.0)
        found = machine.scores(names)
        found[~long_enough] = -9.0
        wrong = np.flatnonzero(clean_word & (found > -0.5))
        wrong = wrong[np.argsort(-(found + 0.5)[wrong] * np.sqrt(count[0][wrong]), kind="stable")][:HARD]
        witness = np.array([own[np.argmax(found[own])] for own, t in zip(inside, toxic, strict=True) if t and len(own)], np.int64)
        witness = np.unique(witness[(count[0][witness] == 0) & (found[witness] > 0.3)])
        if not len(np.setdiff1d(wrong, negative)) and not len(np.setdiff1d(witness, positive)):
            break
        negative, positive = np.union1d(negative, wrong), np.union1d(positive, witness)
    # The logistic curve over the texts' worst windows, and over those of toxic texts bent by one character.
    found = machine.scores(names)
    top = [int(own[np.argmax(found[own])]) if len(own) else -1 for own in inside]
    worst = np.array([max(bias, found[k]) if k >= 0 else bias for k in top])
    bent_of = {k: float(np.mean(machine.scores(inserted(names[k])))) for k in {k for k, t in zip(top, toxic, strict=True) if t and k >= 0 and count[0][k] == 0}}
    extra = np.array([bent_of[k] for k, t in zip(top, toxic, strict=True) if t and k in bent_of])
    worst, y = np.concatenate([worst, extra]), np.concatenate([y, np.ones(len(extra), int)])
    size = np.array([(y == 0).sum(), (y == 1).sum()])
    a, b, pull = 1.0, 0.0, 1e-3
    balance = np.where(y == 1, CAUGHT * len(y) / (2 * size[1]), len(y) / (2 * size[0]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        g = np.array([(balance * (p - y) * worst).sum() + pull * a, (balance * (p - y)).sum()])
        q = balance * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(q * worst**2).sum() + pull, (q * worst).sum()], [(q * worst).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return Model(weight.astype(np.float32), rarity, bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Train on about ``sample`` labelled texts of each class."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for k, n in sizes.items():
        share = F.when(F.col("toxic") == k, F.lit(1_000_000 if n <= sample else max(1, sample * 1_000_000 // n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(drawn), "doc_id")
    # Rows that share an id or a text may be many: of the same rows one trains, and the sample is a bound whatever ids are drawn.
    got = rows.select("doc_id", "text", "toxic").distinct().orderBy(F.xxhash64("doc_id", "text", F.lit(13)), "doc_id", "text").limit(4 * sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [int(r["toxic"] > 0) for r in got])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with score (0 to 1)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    given = [c for c in docs.columns if c != "score"]
    kept = docs.select(*given, text_of(text_col).alias(free_name(given, "_text")))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, 1 << 21):
                p = sent.value.texts(units(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64())], names=[*given, "score"])

    return kept.mapInArrow(go, schema)


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
