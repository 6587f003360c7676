"""Vectorised text primitives for Arrow batches: documents as byte runs, word boundaries,
rolling hashes and minimiser runs.

A *token* is a byte or a word, here a 64-bit value. A *window* is `width` consecutive tokens of
one document. The *anchor* of a window is its gram of `gram` tokens with the least hash (the
leftmost of equals); equal windows have equal anchors at equal offsets, so windows only need to
be compared within an anchor. A *run* is a maximal series of windows of a document that share
an anchor occurrence: runs are the unit of shuffling, some 1 / (width - gram) of the tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ..functions.memory import lean

U = np.uint64
CHUNK_BYTES = 1 << 20
SLICE = 1024  # rows of a batch of texts that are worked on together
POS_BITS = U(28)  # a chunk, and so a document, has fewer tokens than 2^28
POS_MASK = (U(1) << POS_BITS) - U(1)
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def sliced(go: Callable) -> Callable:
    """As lean, and batches come in slices: for functions that treat rows one by one."""

    @lean
    @wraps(go)
    def run(*args) -> Iterator[pa.RecordBatch]:
        *rest, batches = args
        yield from go(*rest, (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)))

    return run


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, U(base), U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_BASE), series(_BASE_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 4096
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(32)
    return h


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values end to end as bytes, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary()), "" if not pa.types.is_binary(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents of about `limit` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and len + 1 offsets of documents in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = word[edge]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = word[edge]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE_CODES[data] * up[:-1], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


class Rolling:
    """Hashes of any span of a series of token codes."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        up, self.down = powers(self.n + 1)
        self.total = np.zeros(self.n + 1, U)
        np.cumsum(codes * up[:-1], out=self.total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U))

    def all(self, width: int) -> np.ndarray:
        """The hash of every span of `width` tokens."""
        if self.n < width:
            return np.zeros(0, U)
        return mix((self.total[width:] - self.total[:-width]) * self.down[: self.n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(x) - width + 1], out[width - size :])


def window_docs(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every whole window, and its document."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(count.sum()) - first[doc] + offsets[:-1][doc], doc


def anchor_runs(codes: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Runs of windows: document, first window (token position in the series), windows, hash of the
    anchor, hash of the run's tokens together with the anchor's offset."""
    if len(codes) > int(POS_MASK):
        raise ValueError("a text has fewer tokens than 2^28")
    at, doc = window_docs(offsets, width)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U), np.zeros(0, U)
    roll = Rolling(codes)
    grams = roll.all(gram)
    order = (mix(grams) & ~POS_MASK) | np.arange(len(grams), dtype=U)
    pos = (sliding_min(order, width - gram + 1)[at] & POS_MASK).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    windows = np.diff(np.append(i, len(at)))
    start = at[i]
    anchor = grams[pos[i]]
    run = roll.spans(start, start + windows + width - 1) ^ mix((pos[i] - start).astype(U))
    return doc[i], start, windows, anchor, run
