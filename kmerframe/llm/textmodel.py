"""Hashed byte n-grams of whole texts, and bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx

SIZES = (3, 4)
BITS = 14
BUCKETS = len(SIZES) << BITS
STRATA = 256  # values of a label that a model learns at most
SLACK = 4  # times its quota that of a stratum passes the first cut, by expectation


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the k-th kind of n-gram at each position."""
    n = SIZES[k]
    if len(data) < n:
        return np.zeros(0, np.int64)
    x = data[: len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        x = x | (data[i : len(data) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i))
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS)


def counts(offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    return np.maximum(sum(np.maximum(size - n + 1, 0) for n in SIZES), 1)


def means(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over a document's n-grams of the rows of `table` (BUCKETS x d)."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    for i, j in tx.chunks(offsets):
        o, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        for k, n in enumerate(SIZES):
            at = grams(part, k)
            if not len(at):
                continue
            s, e = np.minimum(o[:-1], len(at)), np.clip(o[1:] - n + 1, 0, len(at))
            e = np.maximum(s, e)
            for c, column in enumerate(columns):
                total = np.r_[0.0, np.cumsum(column[at])]
                out[i:j, c] += total[e] - total[s]
    return out / counts(offsets)[:, None]


def sparse(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each document's n-grams."""
    out = []
    total = counts(offsets)
    for d in range(len(offsets) - 1):
        part = data[offsets[d] : offsets[d + 1]]
        n = np.bincount(np.concatenate([grams(part, k) for k in range(len(SIZES))]), minlength=BUCKETS)
        at = np.flatnonzero(n)
        out.append((at, n[at] / total[d]))
    return out


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    share = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    return at, share, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


def sample(df: DataFrame, columns: tuple[str, ...], stratum: str, quota: Callable[[int, int], int], salt: int, strata: int = STRATA) -> DataFrame:
    """Of each value of `stratum` (of the `strata` most frequent) quota(rows of it, rows of all) rows at
    most: those whose `columns` have the least hash. Rows equal in them count once. First a share
    of each stratum by hash, then the exact number of what that leaves: no stratum is sorted whole."""
    counts = df.groupBy(stratum).count().orderBy(F.col("count").desc(), stratum).limit(strata).collect()
    total = sum(n for _, n in counts)
    table = [(s, quota(n, total), SLACK * quota(n, total) / n) for s, n in counts]
    kind = df.select(stratum).schema.fields[0].dataType
    quotas = df.sparkSession.createDataFrame(table, T.StructType([T.StructField(stratum, kind), T.StructField("__quota", T.LongType()), T.StructField("__share", T.DoubleType())]))  # `strata` rows
    few = df.join(F.broadcast(quotas), stratum).withColumn("__h", F.xxhash64(F.lit(salt), *columns))
    few = few.where(F.shiftrightunsigned("__h", 11) / F.lit(2.0**53) < F.col("__share")).dropDuplicates([stratum, "__h"])
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy("__h"))).where("__n <= __quota")
    return few.select(*df.columns)


def held(df: DataFrame, limit: int, salt: int) -> pa.Table:
    """The rows of `df`; of more than `limit` those with the least hash, equal rows once."""
    if df.count() > limit:
        h = F.xxhash64(F.lit(salt), *df.columns)
        last = df.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
        df = df.where(h <= F.lit(last)).withColumn("__h", h).dropDuplicates(["__h"]).drop("__h")
    rows = df.toArrow()
    return rows.sort_by([(c, "ascending") for c in df.columns])


def fold(key: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string")) % n
