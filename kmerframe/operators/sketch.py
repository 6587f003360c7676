"""Sketches: (gid, code[, cnt]) from (gid, seq).

Windowing, canonical form, sampling and recoding are one pass over Arrow batches in which rows are
already counted per batch, followed by one shuffle on (gid, code)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..plans.params import SketchParams
from ..plans.session import ship

CEILING = 65535  # fixed value: largest count
PART = 1 << 20


def encode(u: np.ndarray, p: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    """Which canonical k-mers are sampled, and the codes of those that are."""
    dims, ranks = p.permutation()
    dim = (u >> (2 * p.outer)) & (p.dims - 1)
    at = np.minimum(np.searchsorted(dims, dim), len(dims) - 1)
    kept = dims[at] == dim
    u, rank = u[kept], ranks[at[kept]]
    side = (1 << (2 * p.outer)) - 1
    high, low = (u >> (2 * (p.k + p.subk))) & side, u & side
    return kept, ((((high << (2 * p.outer)) | low) << (4 * p.subk)) >> (4 * p.level)) + rank


def _parts(off: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PART, "right")) - 1)
        yield i, j
        i = j


def _scan(p: SketchParams, alphabet: str, keys: list[str], raw_kmers: bool, every: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = sq.values(b["seq"])
            for i, j in _parts(off):
                row, u = sq.kmers(data[off[i] : off[j]], off[i : j + 1] - off[i], p.width, alphabet)
                u = sq.canonical(u, p.width)
                if not raw_kmers:
                    kept, u = encode(u, p)
                    row = row[kept]
                if every:
                    n = np.ones(len(u), np.int64)
                else:
                    order = np.lexsort((u, row))
                    row, u = row[order], u[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (u[1:] != u[:-1])]) if len(u) else np.zeros(0, np.int64)
                    n = np.diff(np.r_[first, len(u)])
                    row, u = row[first], u[first]
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([*(b[k].take(at) for k in keys), pa.array(u), pa.array(n)], [*keys, "code", "cnt"])

    return go


def occurrences(seqs: DataFrame, p: SketchParams, alphabet: str = "dna", keys: tuple[str, ...] = ("gid",), raw_kmers: bool = False, every: bool = False) -> DataFrame:
    """(keys, code, cnt): codes as counted within a batch, or each occurrence by itself."""
    ship(seqs.sparkSession)
    d = seqs.select(*keys, F.col("seq").cast("string").alias("seq"))
    kinds = ", ".join(f"{n} {t}" for n, t in d.dtypes if n in keys)
    return d.mapInArrow(_scan(p, alphabet, list(keys), raw_kmers, every), f"{kinds}, code long, cnt long")


def counted(seqs: DataFrame, p: SketchParams, alphabet: str = "dna") -> DataFrame:
    """Abundance sketch; counts stop at CEILING."""
    return occurrences(seqs, p, alphabet).groupBy("gid", "code").agg(F.least(F.sum("cnt"), F.lit(CEILING)).alias("cnt"))


MOST_OCCURRENCES = 7  # fixed value


def codes(seqs: DataFrame, p: SketchParams, alphabet: str = "dna", drop_zero: bool = True) -> DataFrame:
    """Distinct codes. drop_zero: without code 0, as for FASTA."""
    out = occurrences(seqs, p, alphabet).select("gid", "code").distinct()
    return out.where("code <> 0") if drop_zero else out


def min_occurrence(seqs: DataFrame, p: SketchParams, least: int, alphabet: str = "dna") -> DataFrame:
    """Codes that occur `least` (1 to MOST_OCCURRENCES) times or more."""
    if not 1 <= least <= MOST_OCCURRENCES:
        raise ValueError(f"least must be from 1 to {MOST_OCCURRENCES}")
    return counted(seqs, p, alphabet).where(F.col("cnt") >= least).select("gid", "code")


def unrepeated(seqs: DataFrame, p: SketchParams, alphabet: str = "dna") -> DataFrame:
    """Codes that occur exactly once, without code 0."""
    return counted(seqs, p, alphabet).where("cnt = 1 and code <> 0").select("gid", "code")


def by_read(reads: DataFrame, p: SketchParams, alphabet: str = "dna") -> DataFrame:
    """(gid, read_no, code), a row per occurrence, code 0 included."""
    return occurrences(reads, p, alphabet, ("gid", "read_no"), every=True).drop("cnt")


def kmers(seqs: DataFrame, p: SketchParams, alphabet: str = "dna") -> DataFrame:
    """(gid, code, cnt): all canonical k-mers, unsampled, as 2-bit codes."""
    return occurrences(seqs, p, alphabet, raw_kmers=True).groupBy("gid", "code").agg(F.sum("cnt").alias("cnt"))


def _mask(batches: Iterator[pa.RecordBatch], least: int, mark: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seq, off = sq.values(b["seq"])
        qual, q_off = sq.values(b["qual"])
        if (off != q_off).any():
            raise ValueError("a sequence and its qualities differ in length")
        out = np.where(qual >= least, seq, np.uint8(ord(mark)))
        text = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n not in ("seq", "qual")), text.cast(pa.string())], [*(n for n in b.schema.names if n not in ("seq", "qual")), "seq"])


def mask_quality(reads: DataFrame, least: int, mark: str = "N") -> DataFrame:
    """Bases whose quality byte is under `least` become `mark`, which is no base; ASCII sequences."""
    ship(reads.sparkSession)
    kept = [f for f in reads.schema if f.name not in ("seq", "qual")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return reads.select(*(f.name for f in kept), "seq", "qual").mapInArrow(lambda it: _mask(it, least, mark), f"{schema}, seq string")


def component(code: Column, n: int) -> tuple[Column, Column]:
    """Component of a code and the code within it: a bucket column, not part of results."""
    return F.pmod(code, F.lit(n)), F.shiftright(code, int(n).bit_length() - 1)
