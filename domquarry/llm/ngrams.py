"""Character n-grams of words, hashed to buckets, in array operations over slices of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices, span_hash, word_spans

#: Marks that end words; other signs (``@ $ * 0`` in misspellings) belong to them.
MARKED = np.ones(256, bool)
MARKED[[ord(c) for c in " \t\n\x0b\x0c\r.,;:?!\"'()[]{}<>|/\\"]] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def lower(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.utf8_lower(column.cast(pa.large_string()))


class Words:
    """The words of a slice of lower-cased rows: distinct ones, and for each place which."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
        start, end, self.first = word_spans(data, off, is_word)
        _, at, self.which = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        self.data, self.start, self.end = data, start[at], end[at]

    def ngrams(self, sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the distinct words' n-grams, with ``<`` and ``>`` at the ends, and where each word's begin."""
        n = len(self.start)
        size = self.end - self.start + 2
        begin = np.cumsum(size) - size
        source = np.arange(size.sum()) - np.repeat(begin - self.start + 1, size)
        text = self.data[np.clip(source, 0, max(0, len(self.data) - 1))] if n else np.zeros(0, np.uint8)
        text[begin] = ord("<")
        text[begin + size - 1] = ord(">")
        parts, counts = [], []
        for k in sizes:
            m = np.maximum(size - k + 1, 0)
            at = np.arange(m.sum()) + np.repeat(begin - (np.cumsum(m) - m), m)
            parts.append(span_hash(text, at, at + k))
            counts.append(m)
        if whole:
            parts.append(span_hash(text, begin, begin + size, 1))
            counts.append(np.ones(n, np.int64))
        word = np.concatenate([np.repeat(np.arange(n), m) for m in counts])
        order = np.argsort(word, kind="stable")
        bucket = (np.concatenate(parts)[order] & np.uint64(buckets - 1)).astype(np.int32)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(sum(counts), out=first[1:])
        return bucket, first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows of values between bounds; empty ones are 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.maximum(first[1:] - first[:-1], 1)
    return sums(values, first) / (n if values.ndim == 1 else n[:, None])


def word_slices(column: pa.Array, is_word: np.ndarray):
    for a, b, data, off in slices(lower(column)):
        yield a, b, Words(data, off, is_word)
