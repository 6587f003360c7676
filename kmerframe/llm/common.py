"""Keys of rows, and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import release, ship, written  # noqa: F401
from . import textops as tx

SMALL = 200_000  # rows of a few numbers that are broadcast at most; more are joined by a shuffle
NO_ID = -(2**63)  # stands for a null id in internal keys; it orders first


def filtered(docs: DataFrame, keeps) -> DataFrame:
    """The rows of `docs` for which keeps(texts) is true: decided by row, whatever the ids."""

    @tx.sliced
    def go(batches):
        for b in batches:
            yield b.filter(pa.array(keeps(b["text"].cast(pa.string())), pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def columns_of(df: DataFrame, **defaults: str) -> DataFrame:
    """The named columns, cast; whatever else the table holds, under whatever name, stays out."""
    return df.select(*(df[f"`{c}`"].cast(kind).alias(c) for c, kind in defaults.items()))


def tag(text) -> Column:
    """Tells texts under one id apart; rows equal in both are alike to every operator that uses it."""
    return F.xxhash64(text)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), tag, text. Two unlike texts under one id share a tag with a chance of 2^-64."""
    d = columns_of(docs, doc_id="long", text="string")
    return d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), tag("text").alias("tag"), "text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose (doc_id, tag) aren't among `keys`."""
    held = own_names(docs)
    there = (held["__id"] == keys["doc_id"]) & (held["__tag"] == keys["tag"])
    return restored(held.join(keys, there, "left_anti"), docs)


def own_names(docs: DataFrame) -> DataFrame:
    """`docs` under names that clash with nothing (__0, __1, ...), and __id, __tag of each row."""
    names = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(docs.columns)]
    return docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), tag(F.col("text").cast("string")).alias("__tag"))


def restored(held: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` under their names again; `new` ones in place of theirs."""
    return held.select(*(new.get(c, F.col(f"__{k}")).alias(c) for k, c in enumerate(docs.columns)))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): the least node it reaches.

    Alternating large-star and small-star steps: each round is two shuffles of at most as many
    rows as there are edges, and the number of rounds grows with the logarithm of the longest
    path. A hot node's neighbours are never gathered: a step needs only a node's least neighbour, which
    pre-aggregates; it is written, so that the join with it is one of two plain shuffles, of which Spark
    splits what is skewed. Each round is written to the shared folder.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")

    def star(both: DataFrame, keep) -> DataFrame:
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        return both.join(least, "u").where(keep).select("v", "m", "u")

    last = None
    for _ in range(rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = written(star(both, F.col("v") > F.col("u")).where("v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "large")
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        j = down.join(least, "u")
        small = j.where("v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        e = written(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo"), F.col("lo")).distinct())
