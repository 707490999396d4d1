"""Numpy kernels over Arrow text columns: words, shingles and fingerprints of many documents in one pass.

Nothing here knows Spark. A text is seen as its UTF-8 bytes; all word classes used have ASCII separators only, so
bytes above 0x7F always belong to words. Polynomial hashes are taken modulo 2**64 with an odd base: the hash of any
span comes from two prefix sums and the inverse power of the base. `mixed` spreads them before they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
SLICE_BYTES = 1 << 20

SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def row_slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a single larger text stands alone."""
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > limit:
            yield at, i
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield at, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of row ranges of a batch; bounds what numpy needs at a time."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for a, b in row_slices(np.diff(offsets), limit):
        yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 sums; the span [a, b) hashes to (s[b] - s[a]) * BASE**-a."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) or 1)[0][:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all spans of this width."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * powers(len(sums))[1][:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by a sort: far faster on many different hashes than a table of them."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each text's words. `inside`: which bytes belong to words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    opens[edges] = word[edges]
    closes[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return mixed(span_hashes(prefix_hashes(LOWER[data] if lower else data), starts, ends))


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, with n + 1 offsets by text. A text with fewer words, but some, gives
    its whole sequence as one gram, told apart by its length."""
    counts = np.diff(bounds)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    sum_of = None
    full = max(len(words) - n + 1, 0)
    for j in range(n):
        part = words[j:j + full] * np.uint64(STEPS[j % len(STEPS)] + 2 * (j // len(STEPS)))
        sum_of = part if sum_of is None else sum_of + part
    sum_of = mixed(sum_of)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(grams)))
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], grams)
    short = np.repeat(counts < n, grams)
    whole = np.zeros(len(at), np.uint64)
    whole[~short] = sum_of[at[~short]]
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        h = int(counts[i])
        for w in words[bounds[i]:bounds[i + 1]].tolist():
            h = (h + w) * STEPS[0] & 0xFFFFFFFFFFFFFFFF
        whole[out_bounds[i]] = mixed(np.array([h], np.uint64))[0]
    return whole, out_bounds


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The text of each element, from the offsets by text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, with their offsets."""
    rows = rows_of(bounds)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[first], r[first]
    return v, np.searchsorted(r, np.arange(len(bounds)))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def release_memory() -> None:
    """Gives freed memory back to the system; a worker stays alive between tasks and shares its executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it
