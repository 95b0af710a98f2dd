"""Line tables: every line of many whole texts as a row of numbers, computed on the byte buffer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestar.llm import _text

#: Fixed values of the word and line statistics.
SYMBOLS = b"#*$%&|<>"
STOPS = b".!?"
MARKS = b".,;:!?"

OWN = (
    "bias", "log_bytes", "upper", "digit", "symbol", "mark", "space", "word_length", "echo", "copied", "windowed", "short",
    "stopped", "begins_upper", "wide",
)
NEAR = ("symbol", "echo", "copied", "upper", "windowed", "short")
FEATURES = OWN + tuple(f"{side}_{n}" for side in ("before", "after") for n in NEAR) + ("first", "last")


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _STOP, _MARK, _DIGIT, _UPPER = _kind(SYMBOLS), _kind(STOPS), _kind(MARKS), _kind(b"0123456789"), _kind(bytes(range(65, 91)))
_LETTER = _UPPER | _kind(bytes(range(97, 123))) | _kind(bytes(range(0xC3, 0xF5)))
_WIDE, _POINT = _kind(bytes(range(0xC2, 0xF5))), ~_kind(bytes(range(0x80, 0xC0)))


@dataclass
class Lines:
    """features: one row per line; first: the first line of each text; weight: bytes of each line's words."""

    features: np.ndarray
    first: np.ndarray
    weight: np.ndarray
    stats: dict[str, np.ndarray]


def _repeats(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item: whether its (group, value) occurs again, and whether it did before."""
    key = _text.mix(values ^ _text.mix(groups.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def line_table(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines (split at \\n) and text statistics of consecutive texts; an empty text has one empty line."""
    n_texts, n = len(offsets) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    text_of = np.concatenate([np.arange(n_texts), np.searchsorted(offsets, breaks, "right") - 1])[order]
    swap = np.lexsort((starts, text_of))
    starts, text_of = starts[swap], text_of[swap]
    first = np.searchsorted(text_of, np.arange(n_texts + 1))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(kind, out=sums[1:])
        return sums

    def within(sums: np.ndarray, lo=starts, hi=ends) -> np.ndarray:
        return (sums[hi] - sums[lo]).astype(float)

    space = _text.SPACE[data]
    word_start, word_end, _ = _text.word_bounds(data, offsets)
    hashes = _text.word_hashes(data, word_start, word_end)
    line_of = np.maximum(np.searchsorted(starts, word_start, "right") - 1, 0)
    # Empty lines and texts may share a start; the word belongs to the last line that begins there.
    words = np.bincount(line_of, minlength=len(starts)).astype(float)
    echo = np.zeros(len(starts))
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
        echo = np.bincount(line_of[1:][again], minlength=len(starts)).astype(float)
    text_of_word = text_of[line_of] if len(line_of) else line_of
    windowed = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = text_of_word[2:] == text_of_word[:-2]
        at = np.flatnonzero(whole)
        twice, _ = _repeats(text_of_word[at], _text.window_hashes(hashes, 3)[at])
        for j in range(3):
            windowed[at[twice] + j] = True
    line_hash = _text.word_hashes(data, starts, ends) if n else np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(words > 0)
    copied = np.zeros(len(starts), bool)
    copied[some] = _repeats(text_of[some], line_hash[some])[1]

    size = np.maximum(ends - starts, 1).astype(float)
    letters, points = np.maximum(within(count(_LETTER[data])), 1), count(_POINT[data] & ~space)
    symbols = count(_SYMBOL[data])
    n_words = np.maximum(words, 1)
    last = np.where(ends > starts, data[np.minimum(ends - 1, n - 1)] if n else 0, 0).astype(int)
    head = np.where(ends > starts, data[np.minimum(starts, n - 1)] if n else 0, 0).astype(int)
    in_windows = np.bincount(line_of[windowed], minlength=len(starts)).astype(float)
    columns = {
        "bias": np.ones(len(starts)), "log_bytes": np.log1p(ends - starts) / 8, "upper": within(count(_UPPER[data])) / letters, "digit": within(count(_DIGIT[data])) / size,
        "symbol": within(symbols) / size * 4, "mark": within(count(_MARK[data])) / size * 4, "space": within(count(space)) / size, "word_length": np.minimum(within(points) / n_words / 10, 3),
        "echo": echo / n_words, "copied": copied.astype(float), "windowed": in_windows / n_words, "short": (words < 4).astype(float),
        "stopped": _STOP[last].astype(float), "begins_upper": _UPPER[head].astype(float), "wide": within(count(_WIDE[data])) / size * 4,
    }
    is_first, is_last = np.zeros(len(starts)), np.zeros(len(starts))
    is_first[first[:-1]] = 1
    is_last[first[1:] - 1] = 1
    near = []
    for side, edge in ((1, is_first), (-1, is_last)):
        near += [np.where(edge > 0, 0.0, np.roll(columns[name], side)) for name in NEAR]
    features = np.column_stack([columns[name] for name in OWN] + near + [is_first, is_last])

    per_text = lambda x: np.bincount(text_of, weights=x, minlength=n_texts).astype(np.int64)
    stats = {
        "n_words": per_text(words), "word_chars": per_text(within(points)), "n_symbols": within(symbols, offsets[:-1], offsets[1:]).astype(np.int64),
        "n_dup_lines": per_text(copied.astype(float)), "n_repeat_words": per_text(in_windows),
    }
    return Lines(features, first, within(points), stats)
