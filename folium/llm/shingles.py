"""Word shingles of whole batches of texts with numpy: 64-bit hashes of five successive words.

Words are runs of anything but white space (0x20, 0x09-0x0D); A-Z are lower-cased. A text with fewer words than a shingle
has one shingle, its whole sequence; one without words has none.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    p = _powers.get(name)
    if p is None or len(p) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if size <= 1 << 22:
            _powers[name] = p
    return p[:n]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words."""
    data, offsets = _bytes(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    data = _LOWER[data[low:high]]
    offsets = offsets - low
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    prev = np.ones(n, bool)
    prev[1:] = space[:-1]
    begin = np.flatnonzero(~space & (prev | inner[:n]))
    nxt = np.ones(n, bool)
    nxt[:-1] = space[1:]
    end = np.flatnonzero(~space & (nxt | inner[1:])) + 1
    # Polynomial hashes of all words at once: a prefix sum of byte values times powers of an odd base, shifted back.
    back = _power("inverse", pow(_BASE, -1, 2**64), n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("base", _BASE, n), out=total[1:])
    h = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, offsets)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets."""
    h, at = words(texts)
    count = np.diff(at)
    n = len(h)
    rows = np.repeat(np.arange(len(count)), count)
    got = np.zeros(n, np.uint64)
    for j in range(WORDS):
        got[: max(n - j, 0)] += mix(h[j:] + _STEP[j]) * _STEP[j + 5]
    place = np.arange(n) - at[rows]
    whole = place <= count[rows] - WORDS
    got, keep = mix(got[whole]), rows[whole]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            has = count[short] > j
            extra[has] += mix(h[at[short[has]] + j] + _STEP[j]) * _STEP[j + 5]
        got, keep = np.concatenate([got, mix(extra + count[short].astype(np.uint64))]), np.concatenate([keep, short])
    order = np.argsort(keep, kind="stable") if len(short) else slice(None)
    got, keep = got[order], keep[order]
    cut = np.searchsorted(keep, np.arange(len(count) + 1)).tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        got[a:b].sort()
    if len(got):
        first = np.ones(len(got), bool)
        first[1:] = (got[1:] != got[:-1]) | (keep[1:] != keep[:-1])
        got, keep = got[first], keep[first]
    return got, np.searchsorted(keep, np.arange(len(count) + 1))


def pieces(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, min(stop, batch.num_rows) - start)
        start = min(stop, batch.num_rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
