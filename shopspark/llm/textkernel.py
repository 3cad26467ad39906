"""Vectorised text primitives used inside Arrow tasks: words, hashes and window minimisers of a batch of texts.

All functions work on one bounded chunk of texts at a time (``chunks``), so that a task's memory doesn't
depend on the size of its partition; only a single very long text can make a chunk larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Unit positions that fit beside 37 bits of a hash into one sort key.
POSITIONS = 1 << 27


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, at least one row."""
    n, text = batch.num_rows, batch.column(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    off = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and each text's start plus the end of the last."""
    n = len(text)
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    off = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + n + 1].astype(np.int64)
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the word index at which each text begins (one more at the end)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off, "left")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("p")
    if have is None or len(have) < n + 1:
        m = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _tables[key] = np.multiply.accumulate(x)
        if m > 4 * CHUNK_BYTES:  # don't keep the tables of a rare very long text
            return _tables.pop("p"), _tables.pop("i")
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start:end, wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(buf))
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=s[1:])
    h = (s[end] - s[start]) * inv[start]
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n units (positions 0 .. len-n), from the units' hashes; crosses text boundaries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    k = np.uint64(0x2545F4914F6CDD1D)
    out = h[:m].copy()
    for j in range(1, n):
        out *= k
        out += h[j : j + m]
    return mix(out)


def byte_gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(buf))
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=s[1:])
    return mix((s[n:] - s[:m]) * inv[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values (block prefix and suffix minima: a fixed number of passes)."""
    n = len(x)
    m = n - w + 1
    if m <= 0:
        return x[:0]
    full = -(-n // w) * w
    y = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def _super_windows_by_parts(grams: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """super_windows() over parts of POSITIONS / 2 windows, which overlap by the units of a window less one.

    A run that passes the end of a part goes on as a second one with the same minimiser; each window stays in one run.
    """
    step = max(POSITIONS // 2, 1)
    found = []
    for a in range(0, int(bounds[-1]) - window + 1, step):
        own = np.clip(bounds - a, 0, step + window - 1)
        text, first, last, at, h = super_windows(grams[a : a + step + window - k], own, window, k)
        found.append((text, first + a, last + a, at + a, h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def super_windows(grams: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that share the position of their minimiser.

    grams: hash of the k units from each position; bounds: unit index where each text begins, and the end.
    A run has at most window-k+1 windows. A chunk of POSITIONS units and more (one very long text) is taken in parts. Returns text index, first and last window start, minimiser
    position (all as unit indexes of the chunk) and the minimiser's hash.
    """
    empty = np.zeros(0, np.int64)
    total = int(bounds[-1])
    if total < window or not len(grams):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    if total >= POSITIONS:
        return _super_windows_by_parts(grams, bounds, window, k)
    low = np.uint64(POSITIONS - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, window - k + 1) & low).astype(np.int64)  # equal hashes: the leftmost
    del key
    m = len(at)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:m]
    ok = np.arange(m) + window <= bounds[text + 1]
    new = np.ones(m, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.ones(m, bool)
    stop[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(stop & ok)
    return text[first], first, last, at[first], grams[at[first]]


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of True."""
    if not len(flag):
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n units the spans cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.minimum(start, n), 1)
    np.add.at(d, np.minimum(start + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32()), values)
