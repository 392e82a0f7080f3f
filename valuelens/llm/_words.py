"""Byte-level word tables for Arrow text batches (numpy, inside tasks).

UTF-8 keeps every ASCII byte out of multi-byte characters, so word classes whose
complement is ASCII can be cut on bytes.  All functions work on whole texts; a batch is
cut into slices of about ``SLICE_BYTES`` (never inside a document), and hashing walks a
long document in pieces, so memory follows the longest single document.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes of words `[^\x20\x09-\x0D]+`
PLAIN = ~SPACES
#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & 0xFFFFFFFFFFFFFFFF
    return x


class Hasher:
    """64-bit hashes of many byte ranges at once; ``seed`` gives independent ones.

    Words longer than ``span`` bytes have other hashes under another ``span``.
    """

    def __init__(self, seed: int = 1, span: int = 1 << 20) -> None:
        r = np.random.default_rng(seed)
        self.table = r.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        base = int(r.integers(2**62, 2**63, dtype=np.uint64)) | 5
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.full(span, base, np.uint64)]).cumprod(dtype=np.uint64)
            self.undo = np.concatenate([[np.uint64(1)], np.full(span, _inverse(base), np.uint64)]).cumprod(dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i, most = 0, len(self.power) - 1
        while i < len(starts):
            at = starts[i]
            j = int(np.searchsorted(ends, at + most, "right"))
            if j <= i:  # one word longer than the table: folded piece by piece
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for k in range(int(at), int(ends[i]), most):
                        piece = self.table[data[k : min(k + most, int(ends[i]))]]
                        h = mix(np.array([h], np.uint64))[0] + (piece * self.power[: len(piece)]).sum(dtype=np.uint64)
                out[i] = h
                i += 1
                continue
            with np.errstate(over="ignore"):
                span = self.table[data[at : ends[j - 1]]]
                total = np.concatenate([[np.uint64(0)], (span * self.power[: len(span)]).cumsum(dtype=np.uint64)])
                s, e = starts[i:j] - at, ends[i:j] - at
                out[i:j] = (total[e] - total[s]) * self.undo[s]
            i = j
        with np.errstate(over="ignore"):
            return mix(out + (ends - starts).astype(np.uint64) * _M2)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive values that start at each place (the last n-1 have none)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _M1 + h[k : len(h) - n + 1 + k]
            if k % 4 == 3:
                out = mix(out)
    return mix(out)


def spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of words; document d has words first[d] to first[d+1]."""
    m = is_word[data]
    if not len(m):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    inner = bounds[(bounds > 0) & (bounds < len(m))]
    s[inner] = m[inner]
    e[inner - 1] = m[inner - 1]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, bounds)


def release() -> None:
    """Hand freed memory back to the machine: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text bytes, document bounds) for runs of rows with about ``limit`` bytes; null text is empty."""
    yield from _slices(batches, column, limit)
    release()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        if not len(col):
            continue
        bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


def covered(flag: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places within any window of n that starts at a flagged place."""
    step = np.zeros(total + n + 1, np.int32)
    at = np.flatnonzero(flag)
    step[at] += 1
    step[at + n] -= 1
    return step.cumsum()[:total] > 0


def per_doc(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value over each document's words."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
