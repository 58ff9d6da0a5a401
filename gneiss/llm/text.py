"""Vectorised byte and word primitives shared by the text operators.

Texts arrive as Arrow string arrays; everything here works on their UTF-8 buffer with numpy, a whole batch
at a time, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

#: The bytes that separate words for `[^\x20\x09-\x0D]+`.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

SLICE = 1 << 20  # bytes of a long text that are handled at a time
LONG = 256  # bytes up to which the polynomial hash is used: modulo 2**64, some patterned texts of a kilobyte collide

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD = np.ones(256, bool)
WORD[list(SPACE_BYTES)] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def lean(run):
    """A function of batches that gives memory back to the system when its task is over.

    Workers are used again by later tasks; what numpy and Arrow have freed would else stay with each of them.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # a C library without it
                pass

    return task


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the n+1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges whose texts hold about limit bytes each (at least one row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2**64, up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[0] = 0; range_hash() takes hashes of any byte range from it."""
    _, down = _powers(len(buf))
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * down[: len(buf)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end), equal for equal bytes wherever they stand."""
    up, _ = _powers(len(s))
    return mix((s[end] - s[start]) * up[end] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD):
    """Starts, ends and row of each word: a maximal run of bytes that table marks, within a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(buf)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of long byte ranges, one by one."""
    raw = memoryview(np.ascontiguousarray(buf))
    parts = (hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist()))
    return np.frombuffer(b"".join(parts), "<u8")


def _word_end(buf: np.ndarray, at: int, table: np.ndarray, step: int) -> int:
    """Where the word that reaches `at` ends."""
    while at < len(buf):
        out = np.flatnonzero(~table[buf[at : at + step]])
        if len(out):
            return at + int(out[0])
        at += step
    return len(buf)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD, limit: int = SLICE):
    """Hash and row of each lower-cased (A-Z) word.

    A longer buffer (of one long text) is handled in slices that end between words, so beside the result memory holds
    one slice. Words of more than LONG bytes are hashed apart, wherever they stand.
    """
    hashes, rows, a = [], [], 0
    while a < len(buf):
        b = min(len(buf), a + limit)
        if b < len(buf) and table[buf[b - 1]] and table[buf[b]]:
            out = np.flatnonzero(~table[buf[a:b]])
            b = a + int(out[-1]) + 1 if len(out) else _word_end(buf, b, table, limit)
        low = LOWER[buf[a:b]]
        i, j = np.searchsorted(offsets, [a, b], "right")
        cuts = np.concatenate([[0], offsets[i:j] - a, [b - a]])
        starts, ends, row = words(low, cuts, table)
        long = np.flatnonzero(ends - starts > LONG)
        h = np.zeros(1, np.uint64) if len(long) == len(starts) == 1 else range_hash(prefix_sums(low), starts, ends)
        h[long] = digests(low, starts[long], ends[long])
        hashes.append(h)
        rows.append(row + i - 1)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (hashes[0], rows[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(rows))


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int):
    """Distinct k-word shingle hashes of each row, sorted by (row, hash): hashes, rows.

    A row of fewer than k words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(counts) - counts
    out_h, out_r = [], []
    if len(h) >= k:
        n = len(h) - k + 1
        same = rows[: n] == rows[k - 1 :]
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = g * np.uint64(0xD1342543DE82EF95) + h[j : n + j]
        out_h.append(mix(g)[same])
        out_r.append(rows[:n][same])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            live = counts[short] > j
            g[live] = g[live] * np.uint64(0xD1342543DE82EF95) + h[begin[short[live]] + j]
        out_h.append(mix(g + (counts[short].astype(np.uint64) << np.uint64(56))))
        out_r.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hh, rr = np.concatenate(out_h), np.concatenate(out_r)
    order = np.lexsort((hh, rr))
    hh, rr = hh[order], rr[order]
    keep = np.ones(len(hh), bool)
    keep[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
    return hh[keep], rr[keep]
