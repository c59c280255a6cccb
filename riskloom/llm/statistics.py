"""Statistics of whole texts for the quality classifier, for all texts of an Arrow column at once."""

from __future__ import annotations

import numpy as np

from riskloom.llm.common import RangeHash, flat, is_space

#: Byte classes counted per text.
_CLASSES = ["other", "lower", "upper", "digit", "space", "newline", "symbol", "exclamation", "stop", "comma", "punctuation", "quote", "wide"]
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("newline", (10,)), ("symbol", b"#*$%&|<>"), ("exclamation", b"!?"), ("stop", b"."), ("comma", b","), ("punctuation", b"():;-_/\\[]{}=+@^~`"), ("quote", b"\"'"), ("wide", range(128, 256))):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

NAMES = [f"share_{c}" for c in _CLASSES] + ["log_bytes", "log_words", "word_bytes", "log_lines", "line_words", "short_words", "long_words", "distinct_words", "distinct_windows", "top_word", "distinct_lines", "upper_words", "marked_words"]


def _bounds(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True, cut at the offsets of texts: starts and ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    prev = np.concatenate([[False], mask[:-1]])
    nxt = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~prev | edge[:-1])), np.flatnonzero(mask & (~nxt | edge[1:])) + 1


def _kinds(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct hashes, and the largest count of one."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size, owner = np.diff(np.concatenate([first, [len(key)]])), (key[first] >> np.uint64(42)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=rows).astype(float), top.astype(float)


def statistics(column) -> np.ndarray:
    """One row of len(NAMES) numbers for each text; an empty or null text has zeros."""
    data, at = flat(column)
    rows, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * len(_CLASSES) + _CLASS[data], minlength=rows * len(_CLASSES)).reshape(rows, -1).astype(float) if rows else np.zeros((0, len(_CLASSES)))
    n = np.maximum(size, 1)
    start, end = _bounds(~is_space(data), at)
    owner = row[start] if len(start) else np.zeros(0, np.int64)
    words = np.bincount(owner, minlength=rows).astype(float)
    w, length = np.maximum(words, 1), end - start
    per = lambda mask: np.bincount(owner[mask], minlength=rows) / w
    hashes = RangeHash(data)
    h = hashes(start, end)
    kinds, top = _kinds(owner, h, rows)
    three = (owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, bool)
    mix = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) + h[2:] if len(h) > 2 else h[:0]
    windows = np.bincount(owner[2:][three], minlength=rows) if len(three) else np.zeros(rows)
    window_kinds = _kinds(owner[2:][three], mix[three], rows)[0] if len(three) else np.zeros(rows)
    line_start, line_end = _bounds(data != 10, at)
    line_owner = row[line_start] if len(line_start) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=rows).astype(float)
    line_kinds = _kinds(line_owner, hashes(line_start, line_end), rows)[0]
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == _CLASSES.index("upper"))])
    marked = np.concatenate([[0], np.cumsum((_CLASS[data] == _CLASSES.index("symbol")) | (_CLASS[data] == _CLASSES.index("exclamation")))])
    ups = upper[end] - upper[start] if len(start) else np.zeros(0)
    extra = [np.log1p(size), np.log1p(words), np.bincount(owner, weights=length, minlength=rows) / w, np.log1p(lines), words / np.maximum(lines, 1), per(length <= 2), per(length >= 12), kinds / w, window_kinds / np.maximum(windows, 1), top / w, line_kinds / np.maximum(lines, 1), per(ups >= 2), per((marked[end] > marked[start]) if len(start) else np.zeros(0, bool))]
    return np.concatenate([counts / n[:, None], np.stack(extra, 1)], 1).astype(np.float32) if rows else np.zeros((0, len(NAMES)), np.float32)
