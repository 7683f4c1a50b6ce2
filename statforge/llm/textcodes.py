"""Numpy helpers that turn a batch of texts into words, fingerprints and windows.

A batch is one byte buffer with document offsets, as Arrow lays it out, so that every step is a
handful of array passes. Fingerprints have 64 bits.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word separators: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `limit` bytes, one document at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many come before each document (offsets into them)."""
    inside = ~IS_SPACE[buf]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Ranges of more bytes are fingerprinted one by one.
LONG = 128


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def span_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of every byte range: eight bytes at a time go through mix(), which is not linear, so that no
    pattern of bytes makes unlike ranges alike; long ranges have a digest."""
    size = ends - starts
    code = mix(size.astype(np.uint64) + U64(BASE))
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        part = eight[at]
        short = left < 8
        if short.any():
            part[short] &= (U64(1) << (left[short].astype(np.uint64) * U64(8))) - U64(1)
        code[todo] = mix((code[todo] ^ mix(part)) * U64(0x9FB21C651E98DF25))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        code[i] = int.from_bytes(digest(buf[starts[i] : ends[i]]), "little")
    return code


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


class Windows:
    """Fingerprints of runs of symbols, from tables of power-of-two lengths up to `top`."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.table, size = {1: symbols}, 1
        while size * 2 <= top and len(symbols) >= size * 2:
            have = self.table[size]
            self.table[size * 2] = have[:-size] * U64(pow(BASE, size, 2**64)) + have[size:]
            size *= 2
        self.top = top

    def _pieces(self, length: int) -> list[int]:
        out = [self.top] * (length // self.top)
        return out + [1 << b for b in range(length.bit_length() - 1, -1, -1) if (length % self.top) >> b & 1]

    def all(self, length: int) -> np.ndarray:
        n = len(self.table[1]) - length + 1
        return self._joined(length, lambda size, off: self.table[size][off : off + n])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return self._joined(length, lambda size, off: self.table[size][places + off])

    def _joined(self, length, get):
        out, off = None, 0
        for size in self._pieces(length):
            part = get(size, off)
            out = part if out is None else out * U64(pow(BASE, size, 2**64)) + part
            off += size
        return out


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive symbols, at every start that has n."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    return mix(Windows(codes, 1 << (n.bit_length() - 1)).all(n))


def counts_between(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at every place of [0, n) that lies in one of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def batches(table: pa.Table | pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about `limit` bytes."""
    buf, offs = buffer_of(table.column(text))
    for lo, hi in slices(offs, limit):
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def trimmed(task):
    """For functions of a task's batches: at the end, freed memory goes back to the system, for the
    worker process stays and shares its executor's memory with the next task."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return run
