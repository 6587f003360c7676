"""Substring dedup by de Bruijn compaction over words.

Method. The nodes of a de Bruijn graph are the sequences of width - 1 words, its edges the windows of
`width`. As in bucketed compaction, edges are dealt to buckets by their anchor (repeats.py), a series
of edges of one document under one anchor at a time. In a bucket the nodes are named by their words,
each edge gets its number of places and the first of them, and each node its degrees among repeated
edges; repeated edges that follow each other over a node with one way in and one way out, here
and where they came from, are compacted into a path, with the coordinates of its first source. Spark joins
bring the paths of all buckets to the documents that hold them; there paths that continue each
other in both documents are compacted again, into long spans. Each long span is verified: the
words at its source's coordinates are joined to it and compared by a 128-bit digest of their bytes, and
a span that differs (by a collision of 64-bit word codes) is taken back.

A word goes exactly if a window over it also starts in a document with a smaller doc_id.

Edge cases: a null text has no words; texts under `width` words stay whole; a text of 2^28 words or more
raises; a null doc_id orders first; rows that share a doc_id never remove from each other, repeated rows
neither; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import NO_ID, SMALL, keyed, release, written
from .repeats import repeated, with_spans
from .suffix_dedup import _ranks

WIDTH = 13
GRAM = 4
SPAN = ("start", "len", "fdoc", "ftag", "fstart")
CUT = "doc_id long, tag long, n_words long, n_removed long, kept string, verify array<struct<start: int, len: int, fdoc: long, ftag: long, fstart: int, digest: binary>>"
_VERIFY = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32()), ("digest", pa.binary())]))


def word_ranks(codes: np.ndarray, width: int) -> np.ndarray:
    """Dense ranks of the sequences of `width` codes that start at each position, by doubling."""
    ahead = lambda rank, k: np.r_[rank[k:], np.zeros(min(k, len(rank)), np.int64)]
    power, size, out, done = _ranks([codes]), 1, None, 0
    while True:
        if width & size:
            out, done = (power, size) if out is None else (_ranks([out, ahead(power, done)]), done + size)
        size *= 2
        if size > width:
            return out
        power = _ranks([power, ahead(power, size // 2)])


def graph(width: int):
    """matches (see repeats.repeated) by the edges and nodes of a bucket."""

    def matches(raw: np.ndarray, cut: np.ndarray, windows: np.ndarray, n: np.ndarray, position: np.ndarray):
        seg = np.repeat(np.arange(len(windows)), windows)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows) + (cut[:-1] // 8)[seg]
        nodes = word_ranks(raw.view(np.uint64), width - 1) if width > 1 else np.zeros(len(raw) // 8 + 1, np.int64)
        left, right = nodes[at], nodes[at + 1]
        edge = _ranks([left, right]) if width > 1 else _ranks([raw.view(np.uint64)[at]])
        count = int(edge.max(initial=-1)) + 1
        order = np.lexsort((position, edge))
        head = np.searchsorted(edge[order], np.arange(count))
        source = order[head]  # of each edge the first place
        many = np.bincount(edge, n[seg], count) > 1
        out, into = (np.bincount(x[source][many], minlength=len(nodes) + 1) for x in (left, right))
        # A path ends at a node with several ways in or out.
        branch = (out[left] != 1) | (into[left] != 1)
        return source[edge], many[edge], branch & many[edge]

    return matches


def marked(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return with_spans(docs, repeated(docs, unit="word", width=width, gram=min(GRAM, width), matches=graph(width), rule="smaller"))


def compacted(spans: np.ndarray) -> np.ndarray:
    """Paths of one document (start, len, fdoc, ftag, fstart) that continue each other, here and at their source, as one."""
    spans = np.unique(spans, axis=0)
    start, size, fdoc, ftag, fstart = spans.T
    new = np.r_[True, (start[1:] != start[:-1] + size[:-1]) | (fdoc[1:] != fdoc[:-1]) | (ftag[1:] != ftag[:-1]) | (fstart[1:] != fstart[:-1] + size[:-1])]
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out[:, 1] = np.add.reduceat(size, at)
    return out


def digest(words: list[bytes], start: int, windows: int, width: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start : start + windows + width - 1]))


def _span_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All spans of a batch as rows of numbers, and each document's bounds among them."""
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in SPAN], 1), np.r_[0, np.cumsum(size)]


def _trimmed(b: pa.RecordBatch, width: int, hashed: bool, back: bool = False):
    """Of each document its number of words and of removed ones, what is kept, and its long spans with their digests.
    back: without the spans in `wrong`."""
    data, off = tx.column_bytes(b["text"])
    rows, bounds = _span_rows(b["spans"])
    for k in range(b.num_rows):
        w = data[off[k] : off[k + 1]].tobytes().split()
        long = compacted(rows[bounds[k] : bounds[k + 1]]).tolist() if bounds[k + 1] > bounds[k] else []
        if back and long:
            wrong = {tuple(x[c] for c in SPAN) for x in b["wrong"][k].as_py() or ()}
            long = [s for s in long if tuple(s) not in wrong]
        x, removed = w, 0
        if long:
            edge = np.zeros(len(w) + 1, np.int32)
            for s in long:
                edge[s[0]] += 1
                edge[s[0] + s[1] + width - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed, x = int(gone.sum()), compress(w, (~gone).tolist())
        x = b" ".join(x)
        yield len(w), removed, hashlib.sha256(x).hexdigest() if hashed else x.decode("utf-8", "replace"), [(*s, digest(w, s[0], s[1], width)) for s in long]


def _cut(width: int, hashed: bool):
    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_trimmed(b, width, hashed))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256" if hashed else "text"])

    return go


def _cut_and_ask(width: int, hashed: bool, back: bool = False):
    """As _cut, with the long spans to be verified."""

    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_trimmed(b, width, hashed, back))
            asked = pa.array([[dict(zip((*SPAN, "digest"), s, strict=True)) for s in g[3]] for g in got], _VERIFY)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["tag"], *(pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))), asked], ["doc_id", "tag", "n_words", "n_removed", "kept", "verify"])

    return go


def _source(width: int):
    """Which of the digests asked for differ from the words at the source's coordinates."""

    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = (b["text"][k].as_py() or "").encode().split()
                bad = [s for s in b["asked"][k].as_py() if digest(words, s["fstart"], s["len"], width) != s["digest"]]
                rows = [{"fdoc": b["doc_id"][k].as_py(), "ftag": b["tag"][k].as_py(), **s} for s in bad]
                yield pa.RecordBatch.from_pylist(rows, schema=_WRONG)

    return go


_WRONG = pa.schema([("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32()), ("len", pa.int32()), ("digest", pa.binary())])


def cut(docs: DataFrame, width: int, hashed: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every document, all spans verified."""
    spans = marked(docs, width)
    kept = written(spans.mapInArrow(_cut_and_ask(width, hashed), CUT), "kept")
    release(docs.sparkSession)
    place = F.explode("verify").alias("v")
    asked = kept.select(place).select("v.fdoc", "v.ftag", "v.fstart", "v.len", "v.digest").distinct()  # copies of a passage ask once
    by = asked.groupBy(F.col("fdoc").alias("doc_id"), F.col("ftag").alias("tag")).agg(F.collect_list(F.struct("fstart", "len", "digest")).alias("asked"))
    by = written(by, "asked")
    keys = by.select("doc_id", "tag")
    sources = keyed(docs).join(F.broadcast(keys) if keys.count() <= SMALL else keys, ["doc_id", "tag"], "left_semi")
    wrong = written(sources.join(by, ["doc_id", "tag"]).mapInArrow(_source(width), "fdoc long, ftag long, fstart int, len int, digest binary"), "wrong")
    if wrong.limit(1).count():
        told = kept.select("doc_id", "tag", place).select("doc_id", "tag", "v.*").join(wrong, ["fdoc", "ftag", "fstart", "len", "digest"])
        told = told.groupBy("doc_id", "tag").agg(F.collect_set(F.struct(*SPAN)).alias("wrong"))
        kept = spans.join(told, ["doc_id", "tag"], "left").mapInArrow(_cut_and_ask(width, hashed, True), CUT)
    return kept.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words, joined by one space."""
    return cut(docs, width, False).withColumnRenamed("kept", "text")


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), WIDTH, True).withColumnRenamed("kept", "kept_sha256")
