"""Dense text features computed on byte arrays, whole texts, many documents at once."""

from __future__ import annotations

import numpy as np

from riskloom.llm.common import IS_SPACE, U64, document_of, span_hashes, sums_by, word_spans


def byte_set(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWERCASE, DIGIT = byte_set(range(65, 91)), byte_set(range(97, 123)), byte_set(range(48, 58))
HIGH = byte_set(range(128, 256))
STOP = byte_set(b".,;:")
CALL = byte_set(b"!?")
MARK = byte_set(b"#$%&*^~|<>\\{}[]")
LETTER = UPPER | LOWERCASE | HIGH


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each document."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def distinct_by(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its most frequent one."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]))
    times = np.diff(np.append(first, len(rows)))
    most = np.zeros(n)
    np.maximum.at(most, rows[first], times)
    return sums_by(rows[first], n).astype(float), most


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: shares of character classes, word shapes, repetition and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends = word_spans(data, offsets)
    rows = document_of(starts, offsets)
    words = sums_by(rows, n).astype(float)
    keys = span_hashes(data, starts, ends, lower=True)

    def inside(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]

    length = ends - starts
    letters, upper = inside(LETTER[data]), inside(UPPER[data])
    marks, stops, calls = inside(MARK[data]), inside(STOP[data]), inside(CALL[data])
    of_words = lambda flags: share(sums_by(rows, n, flags.astype(float)), words)
    same = np.zeros(len(rows), bool)
    if len(rows) > 1:
        same[1:] = (rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1])
    kinds, most = distinct_by(rows, keys, n)
    # lines: runs between line feeds
    feed = np.concatenate([[True], data[:-1] == 10]) if len(data) else np.zeros(0, bool)
    line = feed.copy()
    line[offsets[:-1][size > 0]] = True
    at = np.flatnonzero(line)
    line_rows = document_of(at, offsets)
    line_ends = np.append(at[1:], len(data)) if len(at) else at
    line_kinds, _ = distinct_by(line_rows, span_hashes(data, at, line_ends), n)
    lines = sums_by(line_rows, n).astype(float)
    chars = per_document(~IS_SPACE[data], offsets)
    return np.stack([
        np.log1p(words), np.log1p(share(chars, words)),
        share(per_document(UPPER[data], offsets), chars), share(per_document(DIGIT[data], offsets), chars),
        share(per_document(MARK[data], offsets), chars), share(per_document(CALL[data], offsets), chars),
        share(per_document(STOP[data], offsets), chars),
        of_words((upper >= 2) & (upper >= 0.9 * letters)), of_words(marks > 0), of_words(calls > 0),
        of_words(letters + inside(DIGIT[data]) == 0), of_words((marks >= 3) & (letters > 0)), of_words(stops > 0),
        of_words(length > 25), of_words(same),
        share(np.log1p(kinds), np.log1p(words)), share(most, words),
        1 - share(line_kinds, lines), np.log1p(share(words, lines)),
    ], axis=1)


SHAPE = ["log_words", "log_word_length", "upper", "digit", "mark", "call", "stop", "caps_words", "mark_words",
         "call_words", "bare_words", "marked_words", "stop_words", "long_words", "repeats",
         "distinct", "top_word", "repeated_lines", "log_line_words"]


def token_runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the bytes in ``member``; no run crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.concatenate([[True], ~word[:-1]])
    right = np.concatenate([~word[1:], [True]])
    return np.flatnonzero(word & (left | edge[:-1])), np.flatnonzero(word & (right | edge[1:])) + 1


def member_of(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)
    return sorted_set[at] == keys


def text_keys(words) -> np.ndarray:
    """Sorted hashes of literal words (bytes), as ``span_hashes`` gives them."""
    parts = list(words)
    if not parts:
        return np.zeros(0, U64)
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    return np.unique(span_hashes(data, ends - [len(p) for p in parts], ends))
