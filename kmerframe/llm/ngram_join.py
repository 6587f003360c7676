"""N-gram Jaccard join: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Method. Bayesian candidate pruning. Texts with equal shingle sets become one class. MinHash bands
propose candidates, and every pair's MinHash values are compared a few at a time: with m of n equal,
the similarity has the posterior Beta(m + 1, n - m + 1), and a pair is dropped as soon as the chance that
it reaches the threshold is under `tolerance`. This is done first within the bands' buckets, on signatures
alone; what pairs are left there link into groups. (A bucket of more than BLOCK texts isn't compared
within itself: its texts are put into one group.) The members of a group then meet once, with
their shingle sets (in pairs of blocks of bounded size where the group is large); pairs that pass the same
pruning are verified exactly.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A text of one to four words has all its words as its one
shingle; a text without words has none and links with nothing.

Figures: a pair at the threshold meets in no band with a chance of (1 - 0.8^4)^24 = 3e-6, and is
dropped wrongly with a chance of `tolerance` (1e-6) a step at most.

Edge cases: null text counts as empty; rows that share a doc_id count as one document (in the stage each
is its own); a null doc_id is kept and orders first; the least id of a group is its class, whatever the order of
rows; a very long text is read whole, and one of 2^28 words or more raises; an empty table gives an empty result;
other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import NO_ID, SMALL, components, keyed, own_names, restored, ship, written
from .repeats import binary

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
BLOCK = 256  # texts of a bucket that are compared there
MEMBERS, MEMBER_BYTES = 1024, 8 << 20  # of a block of a group, about
_MINERS = np.random.default_rng(7).integers(0, 2**32, (2, HASHES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their bounds."""
    s, e, o = tx.words_of(data, offsets)
    codes = tx.word_codes(data, s, e)
    count = np.diff(o)
    at, doc = tx.window_docs(o, size)
    roll = tx.Rolling(codes)
    values = roll.all(size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        values = np.r_[values, roll.spans(o[:-1][short], o[1:][short])]
        doc = np.r_[doc, short]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (documents x HASHES, uint32); a document without shingles has the largest value."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            v = (x ^ _MINERS[0, k]) * _MINERS[1, k]
            v ^= v >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), bounds[:-1][full])
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("print", pa.binary()), ("size", pa.int64()), ("sig", pa.binary())])


@tx.sliced
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tx.column_bytes(b["text"])
        for i, j in tx.chunks(off):
            values, bounds = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sig = signatures(values, bounds)
            prints = [xxhash.xxh3_128_digest(values[s:e].tobytes()) if e > s else None for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["tag"].slice(i, j - i), pa.array(prints, pa.binary()), pa.array(np.diff(bounds)), binary(sig.view(np.uint8).reshape(-1), np.arange(j - i + 1) * HASHES * 4)], schema=_SIGNED)


@tx.lean
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, _ = tx.column_bytes(b["sig"])
        sig = raw.view(np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None], sig.shape[:2]).copy()
        for k in range(ROWS):
            h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["node"].to_numpy(), BANDS)), pa.array(h.reshape(-1).view(np.int64))], ["node", "band"])


@tx.sliced
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tx.column_bytes(b["text"])
        for i, j in tx.chunks(off):
            values, bounds = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cols = [b[c].slice(i, j - i) for c in ("node", "copies", "sig", "group", "blocks", "block")]
            yield pa.RecordBatch.from_arrays([*cols, binary(values.view(np.uint8), bounds * 8)], ["node", "copies", "sig", "group", "blocks", "block", "shingles"])


@lru_cache(maxsize=64)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least m of n equal values at which the posterior chance of reaching the threshold is
    `tolerance` or more (uniform prior: a Beta tail with whole parameters is a binomial sum)."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def candidates(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that Bayesian pruning leaves of all pairs of two blocks of signatures."""
    i, j = np.triu_indices(len(a), 1) if same else (x.reshape(-1) for x in np.indices((len(a), len(b))))
    return _passing(a, b, i, j, threshold, tolerance)


def _passing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    equal = np.zeros(len(i), np.int32)
    for n in range(STEP, a.shape[1] + 1, STEP):
        for c in range(n - STEP, n):
            equal += a[i, c] == b[j, c]
        keep = equal >= least_matches(n, threshold, tolerance)
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that edges lead to, of each of n."""
    name = np.arange(n)
    while len(i):
        low = np.minimum(name[i], name[j])
        np.minimum.at(name, i, low)
        np.minimum.at(name, j, low)
        name = name[name]
        live = name[i] != name[j]
        i, j = i[live], j[live]
    while not np.array_equal(name, name[name]):
        name = name[name]
    return name


def _prune(threshold: float, tolerance: float = TOLERANCE):
    """Sorted rows of buckets to links (a, b) that join all texts of a bucket that pairs join which pass the pruning."""

    def links(t: pa.Table) -> pa.RecordBatch:
        band, node = t["band"].to_numpy(), t["node"].to_numpy()
        sig = tx.column_bytes(t["sig"])[0].view(np.uint32).reshape(-1, HASHES)
        i, j, k = [], [], 1
        ahead = np.arange(len(band))
        while len(ahead):  # partners k places ahead
            ahead = ahead[: np.searchsorted(ahead, len(band) - k)]
            ahead = ahead[band[ahead] == band[ahead + k]]
            left, right = _passing(sig, sig, ahead, ahead + k, threshold, tolerance)
            i.append(left)
            j.append(right)
            k += 1
        name = joined(np.concatenate(i or [ahead]), np.concatenate(j or [ahead]), len(band))
        on = np.flatnonzero(name != np.arange(len(band)))
        return pa.RecordBatch.from_arrays([pa.array(node[name[on]]), pa.array(node[on])], ["a", "b"])

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            band = b["band"].to_numpy()
            cut = int(np.searchsorted(band, band[-1]))  # the last bucket may go on; none has more than BLOCK rows
            if cut or (kept and kept[-1]["band"][-1].as_py() != band[0]):
                yield links(pa.Table.from_batches([*kept, b.slice(0, cut)]))
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield links(pa.Table.from_batches(kept))

    return go


def shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections left[i] & right[j]."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    both = left + right
    value, name, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    often = count > 1
    col = (np.cumsum(often) - 1)[name]
    row, col = row[often[name]], col[often[name]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(often.sum()), 4096):
        s, e = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(both), 4096), np.float32)
        m[row[s:e], col[s:e] - c] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total[i, j].astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Indices of edges that join all that the edges join."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            out.append(k)
    return out


LINKS = "node long, other long, links long"


def tallies(a_node, a_copies, b_node, b_copies, i, j, same: bool) -> pa.Table:
    """For the linked pairs of two blocks: each member's count of links, and edges that span them."""
    la = np.bincount(i, b_copies[j], len(a_node)).astype(np.int64)
    lb = np.bincount(j, a_copies[i], len(b_node)).astype(np.int64)
    tree = forest(i, j if same else j + len(a_node), len(a_node) + (0 if same else len(b_node)))
    x, y = np.flatnonzero(la), np.flatnonzero(lb)
    node = np.r_[a_node[x], b_node[y], a_node[i[tree]]]
    other = np.r_[a_node[x], b_node[y], b_node[j[tree]]]
    return pa.table({"node": node.astype(np.int64), "other": other.astype(np.int64), "links": np.r_[la[x], lb[y], np.zeros(len(tree), np.int64)]})


def _compare(threshold: float):
    def go(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        block = t["block"].to_numpy()
        raw, cut = tx.column_bytes(t["shingles"])
        sets = [raw[s:e].view(np.uint64) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        sig = tx.column_bytes(t["sig"])[0].view(np.uint32).reshape(-1, HASHES)
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        a, b = np.flatnonzero(block == p), np.flatnonzero(block == q)
        i, j = candidates(sig[a], sig[b], p == q, threshold)
        left, right = [sets[k] for k in a], [sets[k] for k in b]
        size = np.array([len(s) for s in sets])
        si, sj = size[a][i], size[b][j]
        fit = np.minimum(si, sj) >= threshold * np.maximum(si, sj)
        i, j, si, sj = i[fit], j[fit], si[fit], sj[fit]
        both = shared(left, right, i, j)
        hit = both / np.maximum(si + sj - both, 1) >= threshold
        return tallies(node[a], copies[a], node[b], copies[b], i[hit], j[hit], p == q)

    return go


def block_pairs(members: DataFrame) -> DataFrame:
    """Adds p <= q for every pair of blocks of a group that a member belongs to."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.withColumn("_o", other).withColumn("p", F.least("block", "_o")).withColumn("q", F.greatest("block", "_o")).drop("_o")


def join(docs: DataFrame, threshold: float = THRESHOLD, repeats: bool = True) -> DataFrame:
    """doc_id, tag (repeats.keyed), class_id (least doc_id that links lead to), n_links (other
    documents linked directly, copies included), one row per document. repeats: rows may share a
    doc_id, and then are one document with all texts."""
    spark = docs.sparkSession
    ship(spark)
    d = keyed(docs)
    signed = written(d.mapInArrow(_sign, "doc_id long, tag long, print binary, size long, sig binary"), "signed")
    classes = written(
        signed.where("print is not null").groupBy("print").agg(F.min(F.struct("doc_id", "tag")).alias("f"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("sig").alias("sig")).select("print", F.xxhash64("print").alias("node"), "f.doc_id", "f.tag", "copies", "size", "sig"),
        "classes",
    )
    bands = classes.select("node", "sig").mapInArrow(_bands, "node long, band long")
    buckets = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(bands.join(buckets, "band"), "bands")
    small = met.where(F.col("size") <= BLOCK).select("node", "band").join(classes.select("node", "sig"), "node")
    pruned = small.repartition("band").sortWithinPartitions("band").mapInArrow(_prune(threshold), "a long, b long")
    groups = components(pruned.union(met.where(F.col("size") > BLOCK).select("a", F.col("node").alias("b"))))
    grouped = written(groups.withColumnRenamed("component", "group"), "groups")
    held = classes.join(grouped, "node")
    sizes = held.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("size") * 8 / MEMBER_BYTES)).cast("int").alias("blocks"))
    members = held.join(sizes, "group").withColumn("block", F.expr("pmod(xxhash64(node, tag), blocks)").cast("int"))
    keys = held.select("doc_id", "tag")
    texts = d.join(F.broadcast(keys) if grouped.count() <= SMALL else keys, ["doc_id", "tag"], "left_semi")
    members = members.join(texts, ["doc_id", "tag"]).dropDuplicates(["node"])
    sets = members.select("node", "copies", "sig", "group", "blocks", "block", "text").mapInArrow(_sets, "node long, copies long, sig binary, group long, blocks int, block int, shingles binary")
    links = written(block_pairs(sets).groupBy("group", "p", "q").applyInArrow(_compare(threshold), LINKS), "links")
    edges = links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if repeats:
        of = signed.where("print is not null").select("doc_id", F.xxhash64("print").alias("b"))
        several = of.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("doc_id", "a")
        edges = edges.union(of.join(several, "doc_id").where("a <> b").select("a", "b"))
    comp = components(edges)
    direct = links.groupBy("node").agg(F.sum("links").alias("links"))
    per = classes.select("print", "node", "doc_id", "copies").join(direct, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = per.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    per = per.join(least, "component").select("print", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "tag", "print").join(per, "print", "left")
    return out.select("doc_id", "tag", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    null = F.lit(NO_ID)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.nullif("class_id", null).alias("class_id"), "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies exactly one row stays, one with the least id (null
    orders first); rows that share an id are judged by themselves."""
    rows = written(own_names(docs).withColumn("__row", F.monotonically_increasing_id()), "rows")
    text = F.col(f"__{docs.columns.index('text')}")
    got = join(rows.select(F.col("__row").alias("doc_id"), text.alias("text")), repeats=False).select(F.col("doc_id").alias("__row"), "class_id")
    named = got.join(rows.select("__row", "__id"), "__row")
    first = named.groupBy("class_id").agg(F.min(F.struct("__id", "__row")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id", F.col("f.__row").alias("first"))
    later = written(named.join(first, "class_id").where("__row <> first").select("__row"), "later")
    return restored(rows.join(F.broadcast(later) if later.count() <= SMALL else later, "__row", "left_anti"), docs)
