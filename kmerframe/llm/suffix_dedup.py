"""Suffix-array dedup: long byte strings that occur more than once.

Method. Longest-previous-factor arrays. Suffixes are put in order by prefix tripling (ranks of 8, 24,
72, then `width` bytes), the common prefixes of neighbours follow from the ranks, and each suffix's
previous and next smaller positions in that order give its longest previous factor (truncated at
`width`) and where it stands. A string of `width` bytes goes if its longest previous factor reaches
`width`; with keep="none" the copy that was found goes too. Suffixes are ordered within anchors (see
repeats.py), since equal windows have equal anchors; this keeps a suffix array small whatever the
size of the corpus. Anchors with more than repeats.HOT kinds of run are compared by hashes of windows.

Edge cases: a null text counts as empty; texts under `width` bytes have no window and stay whole; a text
of 2^28 bytes or more raises; a null doc_id is kept and orders first; rows that share doc_id and text
each count as a place under keep="none" and as one document under keep="first"; unlike texts under
one id are documents of their own; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import NO_ID, own_names
from .repeats import covered, repeated, with_spans

WIDTH = 200
GRAM = 64


def _ranks(parts: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of tuples."""
    while len(parts) > 1:  # as many ranks as fit are packed into a word
        bits = max(int(p.max(initial=1)).bit_length() for p in parts)
        many = 64 // bits
        packed = parts[0].astype(np.uint64)
        for p in parts[1:many]:
            packed = (packed << np.uint64(bits)) | p.astype(np.uint64)
        parts = [packed if len(parts) <= many else _ranks([packed]), *parts[many:]]
    order = np.argsort(parts[0])
    x = parts[0][order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[False, x[1:] != x[:-1]])
    return out


def suffix_levels(data: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the strings of 8, 24, 72, ... bytes (up to width) that start at each position, in lexicographic order."""
    n = len(data)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    out = [(8, _ranks([np.ndarray(n, ">u8", wide.tobytes(), 0, (1,)).astype(np.uint64)]))]
    while out[-1][0] * 3 <= width:
        depth, rank = out[-1]
        ahead = lambda k: np.r_[rank[k:], np.zeros(min(k, n), np.int64)][:n]  # noqa: B023, E731
        out.append((depth * 3, _ranks([rank, ahead(depth), ahead(2 * depth)])))
    return out


def suffix_ranks(data: np.ndarray, at: np.ndarray, width: int, levels: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Ranks, in lexicographic order, of the strings of `width` (8 at least) bytes that start at `at`;
    equal strings have equal ranks."""
    depth, rank = (levels or suffix_levels(data, width))[-1]
    if depth == width:
        return _ranks([rank[at]])
    steps = [*range(0, width - depth, depth), width - depth]
    return _ranks([rank[at + k] for k in steps])


def neighbours_lcp(data: np.ndarray, order: np.ndarray, width: int, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For positions in suffix order: the common prefix of each with the one before it, `width` at most; 0 for the first."""
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        for _ in range(width // depth if depth == levels[-1][0] else 2):
            x = np.minimum(same, width - depth)
            same = np.where((same <= width - depth) & (rank[a + x] == rank[b + x]), same + depth, same)
    live = np.flatnonzero(same < width)
    for _ in range(7):
        live = live[same[live] < width]
        live = live[data[a[live] + same[live]] == data[b[live] + same[live]]]
        same[live] += 1
    return np.r_[0, same]


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it with a smaller position (-1: none) and the
    common prefix with it. Pointers jump over what is larger, all places at once."""
    n = len(position)
    to, common = np.arange(n) - 1, lcp.copy()
    live = np.arange(1, n)
    while len(live):
        live = live[to[live] >= 0]
        live = live[position[to[live]] > position[live]]
        over = to[live]
        common[live], to[live] = np.minimum(common[live], common[over]), to[over]
    return to, np.where(to >= 0, common, 0)


def previous_factors(data: np.ndarray, at: np.ndarray, position: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The array of longest previous factors (truncated at `width`) of the suffixes that start at `at`, where
    position tells which is earlier; and each one's previous and next smaller positions in suffix order as
    indices of `at` (-1: none), with the longest previous factor in either direction."""
    levels = suffix_levels(data, width)
    order = np.argsort(suffix_ranks(data, at, width, levels), kind="stable")
    lcp = neighbours_lcp(data, at[order], width, levels)
    p = position[order]
    before, left = nearest_smaller(p, lcp)
    after, right = nearest_smaller(p[::-1], np.r_[0, lcp[:0:-1]])
    after, right = np.where(after >= 0, len(p) - 1 - after, -1)[::-1], right[::-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    name = np.r_[order, -1]
    lengths = np.stack([left, right])[:, place]
    return lengths.max(0), np.stack([name[before], name[after]])[:, place], lengths, order


def lpf_matches(width: int):
    """Which windows repeat, from longest previous factors of at least `width`."""

    def matches(raw: np.ndarray, cut: np.ndarray, windows: np.ndarray, n: np.ndarray, position: np.ndarray):
        seg = np.repeat(np.arange(len(windows)), windows)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows) + cut[:-1][seg]
        lpf, smaller, lengths, _ = previous_factors(raw, at, position, width)
        first = np.arange(len(at))
        many = lpf >= width
        for to, length in zip(smaller, lengths, strict=True):
            found = length >= width
            first[found] = to[found]
            many[to[found]] = True
        while True:  # from an earlier copy to the earliest
            on = first[first]
            if np.array_equal(on, first):
                break
            first = on
        return first, many, np.zeros(len(at), bool)

    return matches


def _cut(width: int, digest: bool, carry: tuple[str, ...] = ("doc_id", "tag")):
    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b["text"])
            null = b["text"].is_null().to_numpy(zero_copy_only=False)
            ids, removed, spans, out = b["doc_id"], [], [], []
            for i, j in tx.chunks(off):
                o, part = off[i : j + 1] - off[i], data[off[i] : off[j]]
                gone = covered(o, b["spans"], i, j, width)
                if not digest:  # cut between characters: what is left of a span's first and last ones stays
                    inner = np.r_[(part & 0xC0) == 0x80, False]
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    for s, e in zip(edge[::2], edge[1::2], strict=True):
                        a, z = s, e
                        while a < e and inner[a]:
                            a += 1
                        while z > a and inner[z]:
                            z -= 1
                        gone[s:a] = gone[z:e] = False
                rise = np.r_[gone[:1], gone[1:] & ~gone[:-1]]
                starts = o[:-1][o[:-1] < len(part)]
                rise[starts] = gone[starts]
                total, rises = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(rise)]
                removed.append(np.diff(total[o]))
                spans.append(np.diff(rises[o]))
                for k in range(j - i):
                    x = part[o[k] : o[k + 1]]
                    if removed[-1][k]:
                        x = x[~gone[o[k] : o[k + 1]]]
                    x = x.tobytes()
                    out.append(hashlib.sha256(x).hexdigest() if digest else None if null[i + k] else x.decode("utf-8", "replace"))
            length = np.diff(off)
            z = np.zeros(0, np.int64)
            removed, spans = np.concatenate(removed or [z]), np.concatenate(spans or [z])
            if digest:
                yield pa.RecordBatch.from_arrays([ids, pa.array(length), pa.array(removed), pa.array(spans), pa.array(out, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), pa.array(removed), pa.array(out, pa.string())], [*carry, "n_removed", "text"])

    return go


def marked(docs: DataFrame, width: int = WIDTH, keep: str = "first") -> DataFrame:
    """Documents with the spans of bytes to remove. keep: "first" leaves the first copy by document
    and position, "none" takes all copies."""
    spans = repeated(docs, unit="byte", width=width, gram=min(GRAM, max(1, width * 8 // 25)), matches=lpf_matches(width), rule={"first": "first", "none": "all"}[keep])
    return with_spans(docs, spans.select("doc_id", "tag", "start", "len"))


def dedup(docs: DataFrame, width: int = WIDTH, keep: str = "first") -> DataFrame:
    """doc_id, tag (repeats.keyed), n_removed, text without its repeated strings, cut between characters."""
    return marked(docs, width, keep).mapInArrow(_cut(width, False), "doc_id long, tag long, n_removed long, text string").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = marked(docs, WIDTH, "none").mapInArrow(_cut(WIDTH, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose later copies of long strings; the first copy stays."""
    spans = repeated(docs, unit="byte", width=WIDTH, gram=GRAM, matches=lpf_matches(WIDTH), rule="first")
    by = spans.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("start", "len")).alias("__spans"))
    rows = own_names(docs).join(by, ["__id", "__tag"], "left")
    at = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    carried = [n for c, n in at.items() if c not in ("text", "n_chars")]
    rows = rows.select(*carried, F.col("__id").alias("doc_id"), F.col(at["text"]).cast("string").alias("text"), F.col("__spans").alias("spans"))
    out = rows.mapInArrow(_cut(WIDTH, False, tuple(carried)), T.StructType([*rows.select(*carried).schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*((new[c] if c in new else F.col(at[c])).alias(c) for c in docs.columns))
