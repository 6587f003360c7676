"""Benchmark decontamination by spaced-seed hashing.

Method. Words are runs of letters, digits and other non-ASCII characters but punctuation of the
lower-cased text. Each
fixed mask of at most SPAN positions hashes only the positions it selects, so that a word that was replaced
at another position doesn't matter. Hashes of all test windows meet those of all training windows;
a hit fixes how item and document lie against each other, and the words around it are compared
there: it counts if some `width` consecutive words (the whole item, if shorter) that cover the seed
agree in all but `slack` of them. The masks meet every such overlap of SPAN words or more, wherever
two words are replaced. Items of SHORTEST to SPAN - 1 words are sought whole, with replaced words in
the same proportion (one from 7 words on); their seeds are the runs of words of which one must be
left. Shorter ones are too short to tell and are left out.

Nothing grows with the test set in one place: its seed hashes meet those of the documents in a Spark
join. A Bloom filter of the test hashes, of at most 2^MOST_BITS bits, goes to all tasks first and
keeps back document hashes that can't meet any; what it lets through wrongly falls out of the join.
Each document is then verified against the items it met, those in blocks of about BLOCK_CHARS
characters. Results are the same whatever the sizes.

Edge cases: null texts are empty; a null doc_id or item_id is kept; items with equal text are all
reported, repeated rows of the test set too; rows that share a doc_id are judged by themselves (rows equal
in id and text are judged alike); a very long text is read whole; empty tables give no contamination; other
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import NO_ID, SMALL, columns_of, keyed, ship, without, written

MASKS = ("11000101111", "1101011011", "11101010101", "11011111", "111100111")  # of SPAN words with any two replaced, one mask meets none of the two
SPAN = 12
WIDTH = 13
SLACK = 2
SHORTEST = 5
BLOCK_CHARS = 16_000_000
LEAST_BITS, MOST_BITS = 20, 26

WORD = np.zeros(256, bool)
WORD[0x80:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    WORD[_c] = True


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


# Fixed values of UTF-8: first byte, possible second and last bytes, length of punctuation and spaces.
PUNCTUATION = (
    (0xC2, _bytes((0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF)), _bytes((0x80, 0xBF)), 2),
    (0xE2, _bytes((0x80, 0x81)), _bytes((0x80, 0xBF)), 3),  # U+2000 to U+207F
    (0xE3, _bytes((0x80, 0x80)), _bytes((0x80, 0x84), (0x88, 0x9F)), 3),  # U+3000 to U+301F
)
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with all but word characters as spaces."""
    data, off = tx.column_bytes(pc.utf8_lower(column))
    out = np.where(WORD[data], data, np.uint8(0x20))
    for lead, second, tails, size in PUNCTUATION:
        at = np.flatnonzero(data[: len(data) - size + 1] == lead)
        if len(at):
            at = at[(second[data[at + 1]]) & (tails[data[at + size - 1]])]
            for k in range(size):
                out[at + k] = 0x20
    return out, off


def coded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, o = tx.words_of(data, off)
    return tx.word_codes(data, s, e), o


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += codes[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))


def allowed(words: int, width: int, slack: int) -> int:
    return slack if words >= SPAN else slack * words // max(width, SPAN)


def plan(width: int, slack: int) -> dict[str, list[int]]:
    """The masks, and for items of which lengths (SPAN stands for that and more) each is used."""
    long = MASKS if width >= SPAN and slack <= 2 else ("1" * max(1, min(width, SPAN) // (slack + 1)),)
    out: dict[str, list[int]] = {m: [SPAN] for m in long}
    for n in range(SHORTEST, SPAN):
        out.setdefault("1" * (n // (allowed(n, width, slack) + 1)), []).append(n)
    return out


class TestSet:
    """The items of one block, and for each mask the sorted hashes of their windows."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, width: int, slack: int):
        self.ids, self.width, self.slack = ids, width, slack
        self.codes, self.off = coded(*plain(texts))
        self.index = []
        size = np.diff(self.off)
        item = np.repeat(np.arange(len(size)), size)
        for mask, sizes in plan(width, slack).items():
            h = seeds(self.codes, mask)
            at, doc = tx.window_docs(self.off, len(mask))
            at = at[np.isin(np.minimum(size[doc], SPAN), sizes)]
            if not len(at):
                continue
            order = np.argsort(h[at], kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h[at] >> np.uint64(44)).astype(np.int64)] = True
            self.index.append((mask, h[at][order], at[order], bits))
        self.item = item

    def allowed(self, words: int) -> int:
        """How many words of a stretch may be replaced."""
        return allowed(words, self.width, self.slack)

    def hits(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified (document, item, words that agree), each pair once."""
        places = []
        owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for mask, h, at, bits in self.index:
            x = seeds(codes, mask)
            i = np.flatnonzero(bits[(x >> np.uint64(44)).astype(np.int64)])
            i = i[owner[i] == owner[i + len(mask) - 1]] if len(i) else i
            lo, hi = np.searchsorted(h, x[i], "left"), np.searchsorted(h, x[i], "right")
            n = hi - lo
            i = np.repeat(i, n)
            j = at[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            places.append(np.c_[owner[i], self.item[j], i - (j - self.off[self.item[j]])])
        found: dict[tuple[int, int], int] = {}
        for d, t, start in np.unique(np.concatenate(places), axis=0).tolist() if places else ():
            a, z = self.off[t], self.off[t + 1]
            lo, hi = max(start, int(off[d])), min(start + int(z - a), int(off[d + 1]))
            same = codes[lo:hi] == self.codes[a + lo - start : a + hi - start]
            w = min(self.width, int(z - a))
            if len(same) < w:
                continue
            run = np.convolve(same, np.ones(w, np.int64), "valid")
            if run.max() >= w - self.allowed(w):
                found[d, t] = max(found.get((d, t), 0), int(same.sum()))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        d, t = np.array(list(found), np.int64).T
        return d, t, np.array(list(found.values()), np.int64)


def _found(test: TestSet, texts: pa.Array) -> tuple[list[list], np.ndarray]:
    """Each text's items, and its most words in common with one."""
    data, off = plain(texts)
    items, overlap = [[] for _ in range(len(texts))], np.zeros(len(texts), np.int64)
    for i, j in tx.chunks(off):
        codes, o = coded(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for d, t, n in zip(*test.hits(codes, o), strict=True):
            items[i + d].append(test.ids[t])
            overlap[i + d] = max(overlap[i + d], n)
    return items, overlap


def _sow(width: int, slack: int):
    """The distinct seed hashes of each item, with the number of the mask."""

    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = plain(b["text"])
            key = b["item"].to_numpy()
            for i, j in tx.chunks(off):
                codes, o = coded(data[off[i] : off[j]], off[i : j + 1] - off[i])
                size = np.minimum(np.diff(o), SPAN)
                for k, (mask, sizes) in enumerate(plan(width, slack).items()):
                    at, doc = tx.window_docs(o, len(mask))
                    use = np.isin(size[doc], sizes)
                    h, item = seeds(codes, mask)[at[use]], key[i:j][doc[use]]
                    first = np.unique(np.c_[h.view(np.int64), item], axis=0) if len(h) else np.zeros((0, 2), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(first[:, 0].copy()), pa.array(first[:, 1].copy()), pa.array(np.full(len(first), k, np.int32))], ["seed", "item", "mask"])

    return go


class Filter:
    """A Bloom filter with two bits a hash."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def passing(self, h: np.ndarray) -> np.ndarray:
        k = np.flatnonzero(self._has(h >> np.uint64(64 - self.bits)))
        return k[self._has(h[k] & np.uint64((1 << self.bits) - 1))]

    @staticmethod
    def of(sown: DataFrame, count: int) -> Filter:
        """Built in the cluster, in pieces; only the bits reach the driver."""
        bits = int(np.clip(np.ceil(np.log2(max(count, 1) * 64)), LEAST_BITS, MOST_BITS))
        piece = 1 << 16
        s = F.col("seed")
        places = sown.select(F.shiftrightunsigned(s, 64 - bits).alias("at")).union(sown.select(s.bitwiseAND((1 << bits) - 1).alias("at"))).distinct()

        def packed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            out = np.zeros(piece, np.uint8)
            out[t["at"].to_numpy() & (piece - 1)] = 1
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

        rows = places.withColumn("piece", F.shiftright("at", 16)).groupBy("piece").applyInArrow(packed, "piece long, bits binary").toArrow()
        data = np.zeros((1 << bits) // 8, np.uint8)
        for p, x in zip(rows["piece"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            data[p * piece // 8 : p * piece // 8 + len(x)] = np.frombuffer(x, np.uint8)
        return Filter(bits, data.tobytes())


def _probe(masks: list[str], known: Filter):
    """The distinct hashes of each document that may be those of an item."""

    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = plain(b["text"])
            for i, j in tx.chunks(off):
                codes, o = coded(data[off[i] : off[j]], off[i : j + 1] - off[i])
                owner = np.repeat(np.arange(j - i), np.diff(o))
                found = [np.zeros((0, 2), np.int64)]
                for mask in masks:
                    x = seeds(codes, mask)
                    k = known.passing(x)
                    k = k[owner[k] == owner[k + len(mask) - 1]]
                    found.append(np.c_[x[k].view(np.int64), owner[k]])
                both = np.unique(np.concatenate(found), axis=0)
                pick = pa.array(both[:, 1] + i)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), b["doc_id"].take(pick), b["tag"].take(pick)], ["seed", "doc_id", "tag"])

    return go


def _verify(width: int, slack: int):
    """Of the items that a document met, those that it holds a passage of."""

    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = b["met"]
            cut = met.offsets.to_numpy()
            flat = met.flatten()
            keys, texts = flat.field("item").to_numpy(), flat.field("text")
            _, first = np.unique(keys, return_index=True)
            test = TestSet(keys[first].astype(object), texts.take(pa.array(first)), width, slack)
            items, overlap = _found(test, b["text"])
            own = [set(keys[s:e].tolist()) for s, e in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)]
            items = [sorted(k for k in x if k in y) for x, y in zip(items, own, strict=True)]
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in items])
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pick), b["tag"].take(pick), pa.array([k for x in items for k in x], pa.int64()), pa.array(overlap[row], pa.int64())], ["doc_id", "tag", "item", "overlap"])

    return go


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int = SLACK) -> tuple[DataFrame, DataFrame, int]:
    """Written tables: (doc_id, tag, item, overlap) of keyed(docs) and distinct test texts, and (item, ids) of these;
    how many rows the first has."""
    ship(docs.sparkSession)
    b = columns_of(benchmark, item_id="long", text="string").where("text is not null")
    # A row per distinct text; its ids are reported, all of them.
    tests = written(b.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("item_id"))).alias("ids")).select(F.xxhash64("text").alias("item"), "text", F.col("ids.item_id").alias("ids")), "tests")
    sown = written(tests.select("item", "text").mapInArrow(_sow(width, slack), "seed long, item long, mask int"), "seeds")
    count, used = sown.count(), sorted(r[0] for r in sown.select("mask").distinct().collect())
    masks = [list(plan(width, slack))[k] for k in used]
    d = keyed(docs)
    known = Filter.of(sown, count)
    probed = d.mapInArrow(_probe(masks, known), "seed long, doc_id long, tag long") if count else d.select(F.lit(0).cast("long").alias("seed"), "doc_id", "tag").where("false")
    pairs = sown.select("seed", "item")
    if count <= SMALL:
        pairs = F.broadcast(pairs)
    met = written(probed.join(pairs, "seed").select("doc_id", "tag", "item").distinct(), "met")
    blocks = int((tests.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) + 1
    named = met.join(tests.select("item", "text"), "item").withColumn("block", F.pmod("item", F.lit(blocks)))
    lists = named.groupBy("doc_id", "tag", "block").agg(F.collect_list(F.struct("item", "text")).alias("met")).drop("block")
    keys = met.select("doc_id", "tag").distinct()
    asked = d.join(F.broadcast(keys) if met.count() <= SMALL else keys, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    found = written(asked.join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "met").mapInArrow(_verify(width, slack), "doc_id long, tag long, item long, overlap long"), "found")
    return found, tests.select("item", "ids"), found.count()


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """doc_id, n_items, overlap (most words in common with an item), items, contaminated; a row per document."""
    found, tests, n = hits(docs, benchmark, width, slack)
    per = found.join(tests, "item").groupBy("doc_id", "tag").agg(F.max("overlap").alias("overlap"), F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct(x.isNull().alias("last"), x.alias("id")))))).alias("items"))
    per = per.select("doc_id", "tag", "overlap", F.col("items.id").alias("items"))
    rows = keyed(docs).select("doc_id", "tag").join(F.broadcast(per) if n <= SMALL else per, ["doc_id", "tag"], "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    size = F.size(items).cast("long")
    return rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), size.alias("n_items"), F.coalesce("overlap", F.lit(0)).alias("overlap"), items.alias("items"), (size > 0).alias("contaminated"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a passage of the benchmark go."""
    found, _, n = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select("doc_id", "tag").distinct()
    return without(docs, F.broadcast(bad) if n <= SMALL else bad)
