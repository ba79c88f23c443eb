"""Arrow batches as numpy blocks of UTF-8 bytes, and words found and hashed over a whole block at once.

A block holds some rows of a batch: `buf` is their texts end to end and row i spans offs[i]:offs[i + 1].
Words never cross rows. Hashes are polynomials mod 2**64 with odd bases, then mixed, so that a hash of any
slice comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD_BASE = U64(0xD1342543DE82EF95)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... mod 2**64, n of them at least; kept per worker up to a block's length."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1024)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buf, offs) for runs of rows of about `limit` bytes; a longer text is a block of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = text_column(batch, text)
        at = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes within a row."""
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice's bytes and length."""
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * powers(BASE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(buf) + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on; the last n - 1 positions have none."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= WORD_BASE
        out += words[j : len(words) - n + 1 + j]
    return mix(out + U64(n))


def whole_windows(rows: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie in one row."""
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, of each of n rows."""
    return np.bincount(rows, weights, n).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before, in order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][ranked[1:] == ranked[:-1]]] = True
    return hit


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0


def table(byte_ranges: list[tuple[int, int]]) -> np.ndarray:
    """A lookup of bytes in the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in byte_ranges:
        out[a : b + 1] = True
    return out


#: Bytes of the words `[^\x20\x09-\x0D]+`.
SPACED = ~table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased.
PLAIN = table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and start, end and row of each word of PLAIN bytes."""
    low = LOWER[buf]
    return low, *spans(PLAIN[low], offs)
