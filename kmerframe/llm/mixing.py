"""Mixing sources to target weights by entropy balancing.

Method. Each document i of source s, of size x_i, gets a rate r_i: of all rates of at most `cap` under
which the sources' sizes come to their token targets, those of the least entropy relative to the base
rates q_i. The dual is convex, and separable by source; its solution tilts the rates exponentially,
r_i = min(cap, q_i exp(l_s x_i / m_s)) with m_s the source's mean size. Newton's iterations take gradient and
curvature from one distributed aggregation of the documents (already summed by source, base rate and
size) each. Rates become whole copies in strata of a source of about STRATUM documents: from the
largest document down, each takes the copies that bring the stratum's running total nearest its
share, so that what is left over is about half of the smallest document.

Only the table of sources, a row each, is held by the driver.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; documents
of size 0 have their base rate, rounded over a stratum; a target of all that the cap allows gives all the cap;
a null doc_id is kept; rows that share a doc_id are separate documents; rows equal in id, text and source are
rounded together, in parts of at most PART, and share their copies out; a very long text is counted whole;
ties in size are ordered by id, then by text hash; without any words all targets are 0; an empty table gives an empty
result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import NO_ID, own_names, ship, tag, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
STRATUM = 4096
PART = 1024
FAR = 40.0  # exp(FAR) times any base rate is over any cap
SCHEMA = "doc_id long, tag long, row long, source string, size long, rate double, m long, part int, took long"


@tx.sliced
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tx.column_bytes(b["text"])
        n = [np.diff(tx.words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])[2]) for i, j in tx.chunks(off)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["tag"], b["row"], b["source"], pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["doc_id", "tag", "row", "source", "size"])


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float = CAP) -> np.ndarray:
    """Shares of `total` by weight; none above cap times its size, the excess reshared by weight."""
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        rest = max(total - cap * sizes[~free].sum(), 0.0)
        out[free] = rest * weights[free] / weights[free].sum()
        over = free & (out > cap * sizes)
        if not over.any():
            break
        out[over] = cap * sizes[over]
        free &= ~over
    return out


def balance(summed: DataFrame, goal: dict, cap: float = CAP, rounds: int = 100, tolerance: float = 1e-10) -> dict:
    """The multipliers l_s for which each source's tokens times min(cap, base * exp(l_s * tilt)) meet the goal.
    summed: source, base, size, and tilt (1 if there is no such column, 0 for documents without size)."""
    spark = summed.sparkSession
    if "tilt" not in summed.columns:
        summed = summed.withColumn("tilt", F.lit(1.0))
    ends = summed.where("tilt > 0 and size > 0").groupBy("source").agg(F.min("tilt"), F.sum("size"), F.min("base")).collect()
    low, high, l = {s: 0.0 for s in goal}, {s: 0.0 for s in goal}, {s: 0.0 for s in goal}
    for s, least, total, base in ends:  # a row per source
        reach = (FAR + abs(float(np.log(base))) + float(np.log(cap))) / least
        low[s], high[s] = -reach, reach
        l[s] = reach if goal[s] >= cap * total * (1 - 1e-12) else 0.0
    done = {s for s in goal if l[s] or s not in {e[0] for e in ends}}
    for _ in range(rounds):
        at = spark.createDataFrame(list(l.items()), "_s string, l double")  # a row per source
        r = F.col("base") * F.exp(F.col("l") * F.col("tilt"))
        size = F.col("size") * F.least(r, F.lit(cap))
        rows = summed.join(at, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(size).alias("f"), F.sum(F.when(r < cap, size * F.col("tilt")).otherwise(0.0)).alias("h")).collect()
        off = 0.0
        for s, f, h in rows:
            t = goal[s]
            if s in done or not f or abs(f - t) <= tolerance * t or high[s] - low[s] <= 1e-13 * abs(l[s]):
                continue
            off = max(off, abs(f - t) / t) if t > 0 else off
            # Newton's step, kept within the bracket: where all documents are at the cap there is no curvature.
            (low if f < t else high)[s] = l[s]
            step = l[s] + float(np.clip((t - f) / h, -2 - abs(l[s]), 2 + abs(l[s]))) if h > 0 else np.nan
            l[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if off <= tolerance:
            break
    return l


def _round(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    size, rate, many = t["size"].to_numpy(), t["rate"].to_numpy(), t["m"].to_numpy()
    took = np.zeros(len(size), np.int64)
    due = empty = 0.0
    for i in np.lexsort((t["part"].to_numpy(), t["row"].to_numpy(), t["tag"].to_numpy(), t["doc_id"].to_numpy(), -size)).tolist():
        most = CAP * many[i]
        if size[i]:
            due += rate[i] * size[i] * many[i]
            n = min(most, max(0.0, np.floor(due / size[i] + 0.5)))
            due -= n * size[i]
        else:
            empty += rate[i] * many[i]
            n = min(most, np.floor(empty + 0.5))
            empty -= n
        took[i] = int(n)
    return t.select(["doc_id", "tag", "row", "source", "size", "rate", "m", "part"]).append_column("took", pa.array(took))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, row: str | None = None) -> DataFrame:
    """doc_id, tag, row (the column of that name: a key that tells all rows apart), source, size, rate, copies,
    source_size, target for every document."""
    spark = docs.sparkSession
    ship(spark)
    key = F.col(f"`{row}`").cast("long") if row else F.lit(0).cast("long")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), tag(F.col("text").cast("string")).alias("tag"), key.alias("row"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = written(d.mapInArrow(_sizes, "doc_id long, tag long, row long, source string, size long"), "sized")
    summed = written(sized.groupBy("source", F.lit(1.0).alias("base"), F.col("size").alias("words")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "sources")
    rows = summed.groupBy("source").agg(F.sum("size"), F.sum("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = np.array([r[1] for r in rows], float)
    goal = targets(sizes, np.resize(np.array(weights), len(rows)), share * sizes.sum()) if rows else np.zeros(0)
    means = spark.createDataFrame([(r[0], max(r[1], 1) / r[2]) for r in rows], "_m string, mean double")
    tilted = summed.join(means, F.col("source").eqNullSafe(F.col("_m"))).withColumn("tilt", F.col("words") / F.col("mean"))
    l = balance(tilted, {r[0]: float(g) for r, g in zip(rows, goal, strict=True)})
    table = [(r[0], int(r[1]), float(g), max(int(r[1]), 1) / int(r[2]), l[r[0]], -(-int(r[2]) // STRATUM)) for r, g in zip(rows, goal, strict=True)]
    per = spark.createDataFrame(table, "_s string, source_size long, target double, mean double, l double, strata int")
    same = F.col("source").eqNullSafe(F.col("_s"))
    tilt = F.exp(F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("l") * F.col("size") / F.col("mean")))
    rate = F.when(F.col("target") > 0, F.least(tilt, F.lit(CAP))).otherwise(F.lit(0.0))
    # Rows equal in all that counts here are one row with its number, in parts of bounded size.
    alike = sized.groupBy("doc_id", "tag", "row", "source", "size").agg(F.count(F.lit(1)).alias("all"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / PART).cast("int")))).withColumn("m", F.least(F.lit(PART), F.col("all") - F.col("part") * PART).cast("long"))
    dealt = parts.join(per, same).withColumn("rate", rate).withColumn("stratum", F.expr("cast(pmod(xxhash64(doc_id, tag, row, part), strata) as int)"))
    whole = dealt.select("doc_id", "tag", "row", "source", "size", "rate", "m", "part", "stratum").groupBy("source", "stratum").applyInArrow(_round, SCHEMA)
    each = whole.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.floor(F.col("took") / F.col("m")) + F.when(F.col("k") <= F.pmod("took", "m"), 1).otherwise(0)
    return each.join(per, same).select("doc_id", "tag", "row", "source", "size", "rate", copies.cast("int").alias("copies"), "source_size", "target")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, a row per copy. Adds a column that numbers the copies: copy, or
    copy with as many _ before it as tell it from the columns there are."""
    number = "copy"
    while number in docs.columns:
        number = f"_{number}"
    rows = written(own_names(docs).withColumn("__row", F.monotonically_increasing_id()), "rows")
    asked = rows.select(F.col("__id").alias("doc_id"), "__row", *(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns) if c in ("text", "source")))
    copies = mix(asked, row="__row").where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    met = rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return met.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)), F.col("__copy").alias(number))
