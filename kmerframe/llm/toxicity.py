"""Toxicity by nearest labelled examples.

Method. Terms are the words (letters and digits, lower case) and their beginnings of PREFIX bytes.
Labelled examples (a bounded sample) and texts are TF-IDF vectors over all terms of the examples,
with idf counted over all documents. Terms of few examples have an inverted index, which gives their
part of all cosines; for the others an index over blocks of examples holds each block's largest
weight of a term. A block is visited only while the bound that these give can still beat the K-th
best cosine, so the K nearest are exact. Their votes, each weighted by its squared cosine, are
calibrated by logistic regression on leave-one-out votes, weighted back to the label rate of all
labelled rows. `evidence` has the ids of the nearest examples.

Edge cases: a null or empty text, or one without a term of the examples, gets the rate that such
examples have (the rate of all, if there are none); ties between examples go to the earlier in a fixed order; with no labels of both
kinds all scores are that label's rate (0 without labels); labels of absent documents don't count; a null
doc_id is never learned from nor held out; of rows equal in id, label and text one is learned from; a very
long text is counted whole; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textmodel as tm
from . import textops as tx
from .common import columns_of, filtered, ship
from .decontaminate import plain

SAMPLE = 1024  # labelled rows of each label
PREFIX = (4, 6, 8)
K = 128
PRIOR = 0.5  # votes of the closest example that each label has to begin with
BLOCK = 64
OFTEN = 1 / 16  # share of the examples from which a term is held by blocks
TOGETHER = 128  # texts whose nearest examples are sought together
COUNTED = 1 << 14  # terms whose counts are summed in one row
LOOK = 20  # bits of a hash by which a term is looked up
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Documents and distinct words of all occurrences of words; for each kind of term the hashes of
    the distinct words' terms, 0 where a word has none."""
    s, e, o = tx.words_of(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(o))
    if not len(s):
        return doc, doc, [np.zeros(0, np.uint64) for _ in (0, *PREFIX)]
    up, down = tx.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tx.byte_codes(data) * up[:-1], out=total[1:])

    def hashed(a: np.ndarray, z: np.ndarray, kind: int) -> np.ndarray:
        h = (total[z] - total[a]) * down[a] + np.uint64(kind + 1)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)

    whole = hashed(s, e, 0)
    _, first, word = np.unique(whole, return_index=True, return_inverse=True)
    a, z = s[first], e[first]
    return doc, word, [whole[first], *(np.where(z - a > p, hashed(a, np.minimum(a + p, z), p), np.uint64(0)) for p in PREFIX)]


def vocabulary(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All terms, sorted."""
    found = [np.zeros(0, np.uint64)]
    for i, j in tx.chunks(off):
        found.append(np.unique(np.concatenate(terms(data[off[i] : off[j]], off[i : j + 1] - off[i])[2])))
    names = np.unique(np.concatenate(found))
    return names[names != 0]


class Names:
    """Places of terms among the sorted hashes: by their first LOOK bits, then one after the other."""

    def __init__(self, names: np.ndarray):
        self.names = names
        top = (names >> np.uint64(64 - LOOK)).astype(np.int64)
        self.first = np.r_[0, np.cumsum(np.bincount(top, minlength=1 << LOOK), dtype=np.int32)[:-1]].astype(np.int32)
        self.most = int(np.bincount(top).max()) if len(names) else 0

    def places(self, h: np.ndarray) -> np.ndarray:
        """-1 for hashes that aren't names."""
        out = np.full(len(h), -1, np.int64)
        at, left = self.first[(h >> np.uint64(64 - LOOK)).astype(np.int64)], np.arange(len(h))
        for _ in range(self.most):
            ok = at < len(self.names)
            left, at = left[ok], at[ok]
            x = self.names[at]
            same = x == h[left]
            out[left[same]] = at[same]
            go = x < h[left]
            left, at = left[go], at[go] + 1
        return out


def counted(names: Names, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk i, j of documents: (document, place among the names) of its terms, sorted, and how often."""
    width = max(len(names.names), 1)
    for i, j in tx.chunks(off):
        got = [np.zeros(0, np.int64)]
        if len(names.names):
            doc, word, kinds = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for h in kinds:
                at = names.places(h)[word]
                k = np.flatnonzero(at >= 0)
                got.append(doc[k] * width + at[k])
        key = np.sort(np.concatenate(got))
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        doc, term = np.divmod(key[head], width)
        yield i, j, doc, term, np.diff(np.r_[head, len(key)])


def _frequencies(names: np.ndarray):
    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Names(names), np.zeros(len(names), np.int64)
        for b in batches:
            for k in range(0, b.num_rows, tx.SLICE):
                for _, _, _, term, _ in counted(table, *plain(b["text"].slice(k, tx.SLICE))):
                    total += np.bincount(term, minlength=len(names))
        for part, s in enumerate(range(0, len(names), COUNTED)):
            at = np.flatnonzero(total[s : s + COUNTED])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[s + at].astype("<i8").tobytes()], pa.binary())], ["part", "at", "n"])

    return go


def _sum(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    at, n = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("at", "<u2"), ("n", "<i8")))
    total = np.zeros(COUNTED, np.int64)
    np.add.at(total, at.astype(np.int64), n)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})


def frequencies(docs: DataFrame, names: np.ndarray) -> np.ndarray:
    """In how many documents each term is."""
    rows = docs.select("text").mapInArrow(_frequencies(names), "part int, at binary, n binary").groupBy("part").applyInArrow(_sum, "part int, n binary").toArrow()
    out = np.zeros(-(-len(names) // COUNTED) * COUNTED, np.int64)
    for part, n in zip(rows["part"].to_pylist(), rows["n"].to_pylist(), strict=True):
        out[part * COUNTED : (part + 1) * COUNTED] = np.frombuffer(n, np.int64)
    return out[: len(names)]


class Index:
    def __init__(self, ids: np.ndarray, texts: pa.Array, y: np.ndarray, rate: float, names: np.ndarray | None = None, found: np.ndarray | None = None, total: int = 0):
        """names: the vocabulary; found: in how many of `total` documents each of it is. Without them
        the examples are all documents."""
        data, off = plain(texts)
        self.terms = vocabulary(data, off) if names is None else names
        self.names = Names(self.terms)
        parts = [tuple(x.astype(np.int32) for x in (doc + i, term, n)) for i, _, doc, term, n in counted(self.names, data, off)]
        doc, term, n = (np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int32)]) for c in range(3))
        del parts
        if found is None:
            found, total = np.bincount(term, minlength=len(self.terms)), len(y)
        self.idf = np.log((total + 1) / (found + 1)) + 1
        n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
        weight = np.where(y == 1, rate / n1, (1 - rate) / n0)  # of a row, back to the rate of all rows
        size = np.bincount(doc, minlength=len(y))
        full, empty = np.flatnonzero(size), size == 0
        self.blank = float((weight[empty] * y[empty]).sum() / weight[empty].sum()) if empty.any() else rate
        # Examples with the same main term side by side: tighter bounds.
        often = np.bincount(term, minlength=len(self.terms)) >= BLOCK
        w = np.where(often[term], (1 + np.log(n)) * self.idf[term], 0)
        best = np.lexsort((-w, doc))
        main = np.zeros(len(y), np.int64)
        main[full] = term[best[(np.cumsum(size) - size)[full]]]
        full = full[np.argsort(main[full], kind="stable")]
        place = np.full(len(y), -1)
        place[full] = np.arange(len(full))
        self.ids, self.y = ids[full], y[full]
        order = np.lexsort((place[doc], term))
        self.cut = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.post, self.times = place[doc[order]].astype(np.int32), n[order].astype(np.int32)
        del doc, term, n, w, best, order
        self._prepare()
        self.line = np.array([0.0, 1.0])
        if len(full):
            votes, every = np.zeros(len(full)), zip(place.tolist(), self.vectors(data, off), strict=True)
            while some := list(islice(every, TOGETHER)):
                some = [(k, v) for k, v in some if k >= 0]
                for (k, _), got in zip(some, self.search([v for _, v in some], [k for k, _ in some]) if some else (), strict=True):
                    votes[k] = self.vote(*got)
            self.line = self._calibrate(votes, self.y, weight[full])

    def _prepare(self) -> None:
        """Weights of the postings, and the blocks of the terms of many examples."""
        examples, size = len(self.ids), np.diff(self.cut)
        term = np.repeat(np.arange(len(size)), size)
        w = (1 + np.log(self.times)) * self.idf[term]
        self.weight = w / np.sqrt(np.bincount(self.post, w**2, examples))[self.post]
        often = np.flatnonzero(size >= max(OFTEN * examples, 1))
        self.row = np.full(len(size), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.blocks = -(-examples // BLOCK)
        wide = np.zeros((len(often), self.blocks * BLOCK))
        k = np.flatnonzero(self.row[term] >= 0)
        wide[self.row[term[k]], self.post[k]] = self.weight[k]
        self.wide = wide.reshape(len(often), self.blocks, BLOCK)
        self.most = self.wide.max(2) if self.blocks else np.zeros((len(often), 0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("names", "weight", "row", "wide", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.names = Names(self.terms)
        self._prepare()

    @property
    def matrix(self) -> np.ndarray:
        """All weights, terms x examples: for small sets."""
        out = np.zeros((len(self.terms), len(self.ids)))
        out[np.repeat(np.arange(len(self.terms)), np.diff(self.cut)), self.post] = self.weight
        return out

    def vectors(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sparse unit TF-IDF vectors over the vocabulary."""
        for i, j, doc, term, n in counted(self.names, data, off):
            w = (1 + np.log(n)) * self.idf[term]
            w = w / np.sqrt(np.bincount(doc, w**2, j - i))[doc]
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            yield from ((term[s:e], w[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True))

    def nearest(self, term: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples and their cosines; of equal ones the earlier."""
        return next(self.search([(term, w)], [skip]))

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each vector, without the one to skip."""
        term, w = (np.concatenate([v[c] for v in vectors]) for c in (0, 1))
        doc = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        row = self.row[term]
        few, width = row < 0, self.blocks * BLOCK
        lo, n = self.cut[term[few]], self.cut[term[few] + 1] - self.cut[term[few]]
        k = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        # What is known of each cosine: first the part of the terms of few examples. It only grows.
        part = np.bincount(self.post[k] + np.repeat(doc[few] * width, n), self.weight[k] * np.repeat(w[few], n), len(vectors) * width).astype(float, copy=False).reshape(len(vectors), width)
        del k
        part[np.flatnonzero(np.array(skip) >= 0), [s for s in skip if s >= 0]] = -np.inf
        ask = np.zeros((len(vectors), len(self.wide)))
        ask[doc[~few], row[~few]] = w[~few]
        bound = part.reshape(len(vectors), self.blocks, BLOCK).max(2) + ask @ self.most
        seen = np.zeros(bound.shape, bool)
        k = min(K, width)
        kth = lambda: np.partition(part, width - k, 1)[:, width - k]
        least = kth() if self.blocks else np.zeros(len(vectors))
        for step, b in enumerate(np.argsort(-bound.sum(0), kind="stable").tolist()):
            if step in (4, 16):
                least = kth()
            seen[:, b] = (bound[:, b] > 0) & (bound[:, b] >= least - 1e-9)
            d = np.flatnonzero(seen[:, b])
            part[d, b * BLOCK : (b + 1) * BLOCK] += ask[d] @ self.wide[:, b]
        least = kth() if self.blocks else least
        for x, s, t in zip(part, seen, least, strict=True):
            at = np.flatnonzero((x >= t - 1e-12) & (x > 0))
            at = at[s[at // BLOCK]]
            best = at[np.lexsort((at, -np.round(x[at], 12)))[:K]]
            yield best, x[best]

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        """Log odds of the neighbours' labels, each weighted by closeness."""
        if not len(at):
            return 0.0
        w = sim**2
        yes = (w * self.y[at]).sum()
        return float(np.log((yes + PRIOR * w.max()) / (w.sum() - yes + PRIOR * w.max())))

    @staticmethod
    def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        X, b = np.c_[np.ones(len(x)), x], np.array([0.0, 1.0])
        w = weight / weight.mean()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
            g = X.T @ (w * (p - y)) + 0.1 * (b - [0, 1])
            H = (X * (w * p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
            step = np.linalg.solve(H, g)
            b = b - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        return b if b[1] > 0 else np.array([0.0, 1.0])

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        found = self.search(vectors, [-1] * len(vectors)) if len(self.ids) else ((np.zeros(0, np.int64), None) for _ in vectors)
        for at, sim in found:
            if not len(at):
                yield self.blank, []
                continue
            z = self.line[0] + self.line[1] * self.vote(at, sim)
            yield float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), self.ids[at[:3]].tolist()

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Scores and nearest examples of texts."""
        got = []
        for k in range(0, len(texts), tx.SLICE):
            every = self.vectors(*plain(texts.slice(k, tx.SLICE)))
            while some := list(islice(every, TOGETHER)):
                got += self.scores(some)
        return np.array([g[0] for g in got], float), [g[1] for g in got]

    @tx.sliced
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, near = self.judge(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])


def fitted(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None, folds: int = 5, limit: int = SAMPLE) -> Index | tuple[float, int]:
    """The index, or the score and prediction of all texts where there are no examples of both labels."""
    ship(docs.sparkSession)
    d = columns_of(docs, doc_id="long", text="string")
    source = d if examples is None else columns_of(examples, doc_id="long", text="string")
    y = columns_of(labels, doc_id="long", toxic="int").where(F.col("toxic").isin(0, 1) & (tm.fold("doc_id", folds) != 0))
    y = y.join(source.select("doc_id"), "doc_id", "left_semi")
    n1, n0 = y.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return (1.0, 1) if n1 else (0.0, 0)
    few = tm.sample(y, ("doc_id",), "toxic", lambda n, total: limit, 8)
    rows = tm.held(source.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text"), 2 * limit, 8)  # `few`: 2 * limit ids
    texts = rows["text"].combine_chunks()
    ids, y = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64)
    del rows
    names = vocabulary(*plain(texts))
    return Index(ids, texts, y, n1 / (n1 + n0), names, frequencies(d, names), d.count())


def scored(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None, folds: int = 5, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs. examples: where the labelled
    texts are, if not in docs."""
    index = fitted(docs, labels, examples, folds, limit)
    d = columns_of(docs, doc_id="long", text="string")
    ask = d.select("doc_id", "text", F.coalesce(tm.fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"))
    if isinstance(index, tuple):
        return ask.select("doc_id", "held_out", F.lit(index[0]).alias("score"), F.lit(index[1]).alias("predicted"), F.array().cast("array<long>").alias("evidence"))
    return ask.mapInArrow(index.__call__, SCHEMA)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that are predicted toxic go."""
    index = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if isinstance(index, tuple):
        return docs.where(F.lit(not index[1]))
    return filtered(docs, lambda texts: index.judge(texts)[0] < 0.5)
