"""Vectorised text helpers that run inside tasks: byte-bounded pieces, words, shingles, hashes.

Nothing here holds more than one piece (about ``PIECE_BYTES`` of text, or one longer row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21
#: The white space of ``[^\x20\x09-\x0D]+``.
SPACES = (9, 10, 11, 12, 13, 32)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = U64(0xD6E8FEB86659FD93)
_POWERS = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(1023, _BASE, U64)]))


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the hash base; grows with the longest row seen."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(2 * n, _BASE, U64)]))
    return _POWERS


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of ``text`` or a single row."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after the other, and the row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: White space and ASCII punctuation, for words without their commas and stops.
PUNCTUATED = _IS_SPACE.copy()
PUNCTUATED[33:48] = PUNCTUATED[58:65] = PUNCTUATED[91:97] = PUNCTUATED[123:127] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    space = gaps[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = ~space[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, side="right")


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word; ``lower`` folds A-Z."""
    starts, ends, rows = word_spans(data, offsets, gaps)
    if not len(starts):
        return np.empty(0, U64), rows
    size = ends - starts
    inner = data[~gaps[data]]
    head = np.cumsum(size) - size
    place = np.arange(len(inner)) - np.repeat(head, size)
    table = _BYTE_LOWER if lower else _BYTE
    h = np.add.reduceat(table[inner] * powers(int(size.max()))[place], head)
    return mix64(h + size.astype(U64) * U64(0x2545F4914F6CDD1D)), rows


def word_and_stem_hashes(
    data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...], gaps: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-case word, and of its first ``n`` bytes for each ``n`` in ``stems`` it is longer than."""
    starts, ends, rows = word_spans(data, offsets, gaps)
    if not len(starts):
        return np.empty(0, U64), rows
    size = ends - starts
    inner = data[~gaps[data]]
    head = np.cumsum(size) - size
    place = np.arange(len(inner)) - np.repeat(head, size)
    value = _BYTE_LOWER[inner] * powers(int(size.max()))[place]
    found, owner = [mix64(np.add.reduceat(value, head) + size.astype(U64) * U64(0x2545F4914F6CDD1D))], [rows]
    for n in stems:
        longer = np.flatnonzero(size > n)
        total = np.zeros(len(longer), U64)
        for i in range(n):
            total += value[head[longer] + i]
        found.append(mix64(total ^ U64(n)))
        owner.append(rows[longer])
    return np.concatenate(found), np.concatenate(owner)


def row_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles.

    A row with fewer words gives its whole word sequence as one shingle; a row without words none.
    """
    words, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    begin = np.searchsorted(rows, np.arange(n + 1))
    out: list[np.ndarray] = []
    if len(words) >= k:
        width = len(words) - k + 1
        run = np.zeros(width, U64)
        for i in range(k):
            run = run * U64(0x9FB21C651E98DF25) + words[i : i + width]
        run = mix64(run)
    for i in range(n):
        a, b = int(begin[i]), int(begin[i + 1])
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            h = U64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U64(0xC2B2AE3D27D4EB4F) + w
            out.append(mix64(np.array([h], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark longs."""
    return np.ascontiguousarray(values, U64).view(np.int64)
