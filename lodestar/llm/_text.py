"""Vectorised text primitives over Arrow buffers: words, their hashes, word windows.

Everything works on the UTF-8 bytes of many texts at once; a text is never cut. Words are runs of
bytes other than space and \\x09-\\x0D, so multi-byte characters are never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Arrow batches are worked on in runs of texts of about this many bytes; a longer text is its own run.
RUN_BYTES = 1_000_000
#: Longer words and lines are hashed one by one: a polynomial mod 2^64 has regular collisions from some hundred bytes on.
POLYNOMIAL_BYTES = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def text_runs(batch: pa.RecordBatch, column: str = "text", limit: int = RUN_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive texts; null texts are empty. offsets has one more item than rows."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, marks, data = texts.buffers()
    offsets = np.frombuffer(marks, np.int64)[texts.offset : texts.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, end), bytes_[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text (one more item than texts)."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, RUN_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed public multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: a polynomial mod 2^64 read off one prefix sum, then mixed; XXH64 of long words."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = sums[1:]  # worked on in place: this is the largest array of a run
    terms[:] = data
    terms += np.uint64(1)
    terms *= _power("up", n)
    np.cumsum(terms, out=terms)
    raw = (sums[end] - sums[start]) * _power("down", n + 1)[start]
    out = mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(end - start > POLYNOMIAL_BYTES)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i : i + width] for every i that fits; windows may cross texts (callers mask those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[j : j + n]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[heads] = np.concatenate([[starts[0]], starts[1:] - (starts[:-1] + lengths[:-1] - 1)])
    return np.cumsum(out)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each of n nodes' connected component over the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    return label
