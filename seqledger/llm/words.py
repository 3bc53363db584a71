"""Words of whole texts as numpy arrays, taken straight from Arrow buffers.

The helpers see a batch as one byte buffer with row offsets. Rows are handled in chunks of
about ``CHUNK`` bytes (a longer text is a chunk of its own), so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
PIECE = 1 << 18
#: Rows of a batch that are handled, and told of, at a time.
PART = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}

#: ASCII white space of the word patterns, and the lower-casing of A-Z alone.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters a-z, digits and every byte of a non-ASCII character (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``PART`` rows; after each batch Arrow gives back what it holds unused."""
    for batch in batches:
        for low in range(0, batch.num_rows, PART):
            yield batch.slice(low, PART)
        del batch
        pa.default_memory_pool().release_unused()


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the runs of bytes in ``inside``; none crosses a row."""
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = m.copy()
    begin[1:] &= ~m[:-1] | edge[1:-1]
    end = m.copy()
    end[:-1] &= ~m[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial taken from running sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        at = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        size = int(ends[high - 1] - at)
        up, down = _tables(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[at : at + size].astype(np.uint64) + np.uint64(1)) * up[:size], dtype=np.uint64, out=total[1:])
        s, e = starts[low:high] - at, ends[low:high] - at
        out[low:high] = (total[e] - total[s]) * down[s]
        low = high
    return mix(out)


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (k up to 8); empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _STEP[0]
    for i in range(1, k):
        total = total + hashes[i : i + n] * _STEP[i]
    return mix(total + np.uint64(k))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A row of fewer than
    ``k`` words has its whole sequence as one shingle; a row without words, or null, has none.
    """
    for low, _, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, NOT_SPACE)
        hashes = word_hashes(data, starts, ends)
        whole = chain(hashes, k)
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                part = np.sort(whole[a : b - k + 1])
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                yield low + i, part[keep]
            elif b > a:
                yield low + i, chain(hashes[a:b], b - a)
            else:
                yield low + i, np.zeros(0, np.uint64)
