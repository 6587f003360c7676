"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic
gradient descent in numpy, with calibrated rejection.

A text's vector is the mean embedding of all its (lower-case) byte 3- and 4-grams; the softmax is
linear in it. A temperature fitted on a part of the sample that isn't trained on makes the score a
probability; below the least score at which that part is right often enough, `rejected` is true.

Fitted on SAMPLE rows (LEAST of each of the most frequent languages at least) with a language whose
fold isn't the held-out one; applied to every whole text, however long; ties of classes go to the
first in order of names. Edge cases: a null text, or one without a letter, is `und` with score 0; with no row to
learn from all are `und`; a null doc_id is never trained on nor held out; repeated rows are
predicted alike; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textmodel as tm
from . import textops as tx
from .common import columns_of, ship

SAMPLE = 2048  # rows, LEAST of each language at least
LEAST = 64
DIMS = 16
EPOCHS = 6
RATE = 0.5
RIGHT = 0.98


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(rows: list, y: np.ndarray, classes: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases, by Adagrad-scaled stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (tm.BUCKETS, DIMS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMS, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen_e, seen_o, seen_b = np.full(tm.BUCKETS, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(classes, 1e-8, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), 32):
            b = order[k : k + 32]
            at, share, row = tm.stacked([rows[i] for i in b])
            x = np.zeros((tm.BUCKETS,), np.int64)
            u, name = np.unique(at, return_inverse=True)
            x = np.zeros((len(b), len(u)), np.float32)
            x[row, name] = share
            h = x @ emb[u]
            g = softmax(h @ out + bias)
            g[np.arange(len(b)), y[b]] -= 1
            g = g.astype(np.float32) / len(b)
            d_out, d_bias, d_emb = h.T @ g, g.sum(0), x.T @ (g @ out.T)
            seen_o += d_out**2
            seen_b += d_bias**2
            seen_e[u] += (d_emb**2).mean(1)
            out -= RATE * d_out / np.sqrt(seen_o)
            bias -= 0.1 * d_bias / np.sqrt(seen_b)
            emb[u] -= RATE * d_emb / np.sqrt(seen_e[u])[:, None]
    return emb, out, bias


class Model:
    def __init__(self, texts: pa.Array, langs: list[str]):
        self.names = sorted(set(langs))
        y = np.array([self.names.index(x) for x in langs], np.int64)
        data, off = tx.column_bytes(pc.utf8_lower(texts))
        rows = tm.sparse(data, off)
        check = np.arange(len(rows)) % 5 == 4
        fit = ~check if check.any() and (~check).any() else np.ones(len(rows), bool)
        emb, out, self.bias = train([r for r, f in zip(rows, fit, strict=True) if f], y[fit], len(self.names))
        # The mean of embeddings times the weights is the mean of their product: fewer columns to look up.
        self.table, self.out = (emb @ out, None) if len(self.names) <= DIMS else (emb, out)
        self.heat, self.floor = 1.0, 0.0
        if check.any():
            z = self.logits(data, off)[check]
            t = y[check]
            losses = {h: -np.log(np.maximum(softmax(z / h)[np.arange(len(t)), t], 1e-12)).mean() for h in np.geomspace(0.05, 20, 61)}
            self.heat = float(min(losses, key=losses.get))
            p = softmax(z / self.heat)
            order = np.argsort(-p.max(1))
            good = np.cumsum((p.argmax(1) == t)[order]) / np.arange(1, len(t) + 1) >= RIGHT
            self.floor = float(p.max(1)[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        m = tm.means(data, off, self.table)
        return (m if self.out is None else m @ self.out) + self.bias

    @tx.sliced
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(pc.utf8_lower(b["text"]))
            p = softmax(self.logits(data, off) / self.heat)
            ok = b["letters"].to_numpy(zero_copy_only=False)
            best, score = p.argmax(1), np.where(ok, p.max(1), 0.0)
            lang = pa.array([self.names[k] if o else "und" for k, o in zip(best, ok, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], lang, pa.array(score), pa.array(~ok | (score < self.floor))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, folds: int = 4, held: int = 2, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    ship(docs.sparkSession)
    d = columns_of(docs, doc_id="long", text="string", lang="string")
    learn = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (tm.fold("doc_id", folds) != held))
    rows = tm.held(tm.sample(learn, ("doc_id", "text"), "lang", lambda n, total: max(LEAST, limit * n // total), 6), limit + LEAST * tm.STRATA, 6)
    ask = d.select("doc_id", "text", F.coalesce(tm.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not rows.num_rows:
        return ask.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    model = Model(rows["text"].combine_chunks(), rows["lang"].to_pylist())
    return ask.mapInArrow(model.__call__, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
