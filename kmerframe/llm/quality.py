"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the shares of its hashed byte 3- and 4-grams (case kept); one weight each,
shared by all grades, gives a location f. With ordered thresholds t_1 < t_2 < ...,
P(grade <= k) = sigmoid(t_k - f). The expected grade and the tail probability P(grade >= cut), cut
by default the highest grade, serve for selection: a document is kept if its tail is 0.5 or more.

Fitted on SAMPLE labelled rows (LEAST of each grade at least) outside the held-out fold (crc32 of
doc_id modulo 5 is 0), applied to every whole text, however long. Labels of absent documents don't count. Edge cases: a null text counts as empty and gets the thresholds' own
distribution; with no labelled row, tail and grade are null and all are kept; with a single grade
every tail is 1; a null doc_id is never trained on nor held out; of rows equal in id, grade and
text one is learned from; equal texts are graded alike; an
empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textmodel as tm
from . import textops as tx
from .common import columns_of, ship

SAMPLE = 4096  # labelled rows, LEAST of each grade at least
LEAST = 64
EPOCHS = 12
RATE = 3.0
SCHEMA = "doc_id long, held_out boolean, expected_grade double, tail double, kept boolean"


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights w and thresholds t; t is a start and positive steps, so that it stays in order."""

    def __init__(self, rows: list, y: np.ndarray, grades: list[int], seed: int = 5):
        self.grades = np.array(grades, float)
        levels = len(grades)
        share = np.cumsum(np.bincount(y, minlength=levels))[:-1] / len(y)
        start = np.log(share / (1 - share)) if levels > 1 else np.zeros(0)
        a, steps = (start[:1], np.log(np.maximum(np.diff(start), 1e-2))) if levels > 1 else (np.zeros(0), np.zeros(0))
        w = np.zeros(tm.BUCKETS)
        seen, seen_t = np.full(tm.BUCKETS, 1e-10), np.full(max(levels - 1, 1), 1e-8)
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS if levels > 1 else 0):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), 32):
                b = order[k : k + 32]
                at, x, row = tm.stacked([rows[i] for i in b])
                t = self._thresholds(a, steps)
                f = np.bincount(row, w[at] * x, len(b))
                edge = np.r_[-np.inf, t, np.inf]
                hi, lo = sigmoid(edge[y[b] + 1] - f), sigmoid(edge[y[b]] - f)
                hi[y[b] == levels - 1], lo[y[b] == 0] = 1, 0
                p = np.maximum(hi - lo, 1e-9)
                d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
                g = (d_hi - d_lo) / len(b)  # of the loss by f
                gw = np.bincount(at, g[row] * x, tm.BUCKETS)
                u = np.flatnonzero(gw)
                seen[u] += gw[u] ** 2
                w[u] -= RATE * gw[u] / np.sqrt(seen[u])
                gt = (np.bincount(y[b], d_lo, levels + 1)[1:levels] - np.bincount(y[b] + 1, d_hi, levels + 1)[1:levels]) / len(b)
                down = np.cumsum(gt[::-1])[::-1]
                ga = np.r_[down[:1], down[1:] * np.exp(steps)]
                seen_t += ga**2
                step = 0.05 * ga / np.sqrt(seen_t)
                a, steps = a - step[:1], steps - step[1:]
        self.w, self.t = w, self._thresholds(a, steps)

    @staticmethod
    def _thresholds(a: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return a[:1].repeat(len(steps) + 1) + np.r_[0, np.cumsum(np.exp(steps))] if len(a) else a

    def above(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade > k-th) for every text and every grade but the last."""
        f = tm.means(data, off, self.w[:, None])[:, 0]
        return sigmoid(f[:, None] - self.t[None])


def _score(model: Ordinal, level: int):
    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b["text"])
            above = model.above(data, off)
            grade = model.grades[0] + above @ np.diff(model.grades)
            tail = above[:, level - 1] if level else np.ones(len(grade))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(grade), pa.array(tail), pa.array(tail >= 0.5)], ["doc_id", "held_out", "expected_grade", "tail", "kept"])

    return go


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, limit: int, salt: int) -> pa.Table:
    """At most `limit` labelled rows (doc_id, text, y) outside fold 0, in a fixed order."""
    y = columns_of(labels, doc_id="long", **{label: "int"}).where(F.col(label).isNotNull() & (tm.fold("doc_id", folds) != 0))
    y = y.join(docs.select("doc_id"), "doc_id", "left_semi").withColumnRenamed(label, "y")
    few = tm.sample(y, ("doc_id",), "y", lambda n, total: max(LEAST, limit * n // total), salt)
    return tm.held(docs.join(F.broadcast(few), "doc_id").select("doc_id", "y", "text"), limit + LEAST * tm.STRATA, salt)  # `few`: as many ids


def grade(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: int | None = None, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail, kept for every row of docs."""
    ship(docs.sparkSession)
    d = columns_of(docs, doc_id="long", text="string")
    rows = labelled(d, labels, label, 5, limit, 9)
    ask = d.select("doc_id", "text", F.coalesce(tm.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    if not rows.num_rows:
        return ask.select("doc_id", "held_out", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept"))
    y = rows["y"].to_numpy()
    grades = np.unique(y).tolist()
    model = Ordinal(tm.sparse(*tx.column_bytes(rows["text"])), np.searchsorted(grades, y), grades)
    level = len(grades) - 1 if cut is None else int(np.searchsorted(grades, cut))
    return ask.mapInArrow(_score(model, min(level, len(grades) - 1)), SCHEMA)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
