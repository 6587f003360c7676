"""Sequences as Arrow batches: codes of bases, rolling k-mers, canonical forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DNA = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    DNA[_c] = DNA[_c + 32] = _i
LETTERS = np.full(256, 255, np.uint8)
for _i in range(26):
    LETTERS[65 + _i] = LETTERS[97 + _i] = _i % 4
ALPHABETS = {"dna": (DNA, b"\n\r"), "letters": (LETTERS, b" \n")}


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and their bounds."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def kmers(raw: np.ndarray, off: np.ndarray, width: int, alphabet: str = "dna") -> tuple[np.ndarray, np.ndarray]:
    """(row, 2-bit code) of every window of `width` valid bases; separators are skipped, any other
    byte ends a run, and so does a row."""
    table, skip = ALPHABETS[alphabet]
    keep = ~np.isin(raw, np.frombuffer(skip, np.uint8))
    bases = table[raw[keep]]
    bounds = np.r_[0, np.cumsum(keep)][off]
    n = len(bases)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, size = (bases & 3).astype(np.int64), 1
    done, have = np.zeros(n - width + 1, np.int64), 0
    while True:  # spans double; those that width is made of are put together
        if width & size:
            done = (done << (2 * size)) | code[have : have + n - width + 1]
            have += size
        if size * 2 > width:
            break
        code = (code[: len(code) - size] << (2 * size)) | code[size:]
        size *= 2
    bad = np.r_[0, np.cumsum(bases == 255)]
    ok = bad[width:] == bad[:-width]
    row = np.searchsorted(bounds, np.arange(n - width + 1), "right") - 1
    ok &= np.arange(n - width + 1) + width <= bounds[row + 1]
    return row[ok], done[ok]


def reverse_complement(u: np.ndarray, width: int) -> np.ndarray:
    x, out = ~u, np.zeros_like(u)
    for _ in range(width):
        out = (out << 2) | (x & 3)
        x >>= 2
    return out


def canonical(u: np.ndarray, width: int) -> np.ndarray:
    return np.minimum(u, reverse_complement(u, width))
