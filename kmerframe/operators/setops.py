"""Exact algebra on sketches (gid, code[, cnt]) and pans (code). Counts, where present, are carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(sketch: DataFrame) -> DataFrame:
    return sketch.select("code").distinct()


def unique_union(sketch: DataFrame) -> DataFrame:
    """Codes of exactly one genome."""
    return sketch.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("code")


def intersect(sketch: DataFrame, pan: DataFrame) -> DataFrame:
    return sketch.join(pan.select("code"), "code", "left_semi")


def subtract(sketch: DataFrame, pan: DataFrame) -> DataFrame:
    return sketch.join(pan.select("code"), "code", "left_anti")


def combine(batches: list[DataFrame]) -> DataFrame:
    """Concatenates sketches; gids of later batches follow those of earlier ones, in order."""
    out = None
    for k, b in enumerate(batches):
        part = b.select(F.lit(k).alias("batch"), "gid", "code")
        out = part if out is None else out.union(part)
    sizes = out.groupBy("batch").agg((F.max("gid") + 1).alias("size"))  # a row per batch
    low = F.broadcast(sizes.alias("x").join(sizes.alias("y"), F.col("y.batch") < F.col("x.batch"), "left").groupBy("x.batch").agg(F.coalesce(F.sum("y.size"), F.lit(0)).alias("low")))
    return out.join(low, "batch").select((F.col("gid") + F.col("low")).alias("gid"), "code")


def combine_pans(pans: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each pan becomes one genome: (gid, name, code)."""
    out = None
    for gid, (name, pan) in enumerate(pans):
        part = pan.select(F.lit(gid).cast("long").alias("gid"), F.lit(name).alias("name"), "code")
        out = part if out is None else out.union(part)
    return out


def check_groups(sketch: DataFrame, groups: DataFrame) -> None:
    """Raises where a genome has no group or several, or a taxid has two names."""
    if groups.groupBy("taxid").agg(F.countDistinct("taxname").alias("n")).where("n > 1 and taxid <> 0").limit(1).count():
        raise ValueError("a taxid has two names")
    if groups.groupBy("gid").count().where("count > 1").limit(1).count():
        raise ValueError("a genome has two groups")
    if sketch.select("gid").distinct().join(groups, "gid", "left_anti").limit(1).count():
        raise ValueError("a genome has no group")


def group(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """(taxid, name, code): distinct codes of each group's genomes; taxid 0 is left out."""
    g = groups.where("taxid <> 0").select("gid", "taxid", F.concat_ws("_", F.col("taxid").cast("string"), "taxname").alias("name"))
    return sketch.join(g, "gid").select("taxid", "name", "code").distinct()


def markers(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """Codes that only one group has, by group: grouping, unique union, then intersection."""
    pans = group(sketch, groups)
    return intersect(pans, unique_union(pans)).select("taxid", "name", "code")


def inverted(sketch: DataFrame) -> DataFrame:
    """(code, gids ascending)."""
    return sketch.groupBy("code").agg(F.sort_array(F.collect_set("gid")).alias("gids"))


def genome_names(sketch: DataFrame, names: DataFrame) -> DataFrame:
    """(gid, name, n_codes) of all genomes of `names`, without codes included."""
    n = sketch.groupBy("gid").agg(F.count(F.lit(1)).alias("n_codes"))
    return names.join(n, "gid", "left").select("gid", "name", F.coalesce("n_codes", F.lit(0)).alias("n_codes"))
