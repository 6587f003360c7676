"""Relative abundance, taxonomy roll-up and the CAMI profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import written

# Poisson depth at average coverage 0 to 10.
POISSON = (0.0, 0.02, 0.08, 0.69, 1.57, 2.49, 3.41, 4.31, 5.20, 6.08, 6.94)
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


def poisson_depth(avg: Column) -> Column:
    table = F.array(*[F.lit(x) for x in POISSON])
    return F.when(avg > 5, avg - 3).otherwise(F.element_at(table, F.least(F.floor(avg), F.lit(10)).cast("int") + 1))


def deviation_depth(avg: Column) -> Column:
    d = avg - 3
    return F.when(d > 0.1, d).otherwise(F.pow(F.lit(10.0), d - 0.1))


def two_tier_depth(avg: Column, median: Column, shared: Column, a: float = 3.0, s: int = 18, low: float = 2.0, small: float = 0.01) -> Column:
    return F.when((avg > a) & (median > 1) & (shared > s), avg - a).when((avg >= low) & (shared > s), F.greatest(avg - a, F.lit(small)))


def sample_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^0-9a-zA-Z_.]", "_")


def psid(ref: Column) -> Column:
    return F.element_at(F.split(ref, "_"), 1)


def relative(depths: DataFrame) -> DataFrame:
    """(sample, ref, fraction) from (sample, ref, depth); references without a depth are left out."""
    d = depths.where(F.col("depth").isNotNull())
    return d.withColumn("fraction", F.col("depth") / F.sum("depth").over(Window.partitionBy("sample"))).select("sample", "ref", "depth", "fraction")


def ancestors(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor, hops) for every node and each of its ancestors below the root, itself included.
    A climb of the tree, of as many joins as it is deep; each level is written, so that none is climbed
    twice. nodes (node, rank, parent, name)."""
    step = nodes.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    front = nodes.where("node <> 1").select("node", F.col("node").alias("ancestor"), F.col("parent").alias("up"), F.lit(0).alias("hops"))
    out = front
    for k in range(1, rounds):
        front = front.where("up <> 1 and up is not null").join(step, F.col("up") == F.col("_n")).select("node", F.col("up").alias("ancestor"), F.col("_p").alias("up"), F.lit(k).alias("hops"))
        front = written(front, "front")
        if front.isEmpty():
            return out.select("node", "ancestor", "hops")
        out = out.union(front)
    raise ValueError("the taxonomy is deeper than expected, or has a cycle")


def rollup(leaves: DataFrame, nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(sample, node, pct): percentages of (sample, node, pct) summed onto every ancestor below the root.
    up: ancestors(nodes), if there is one already."""
    up = ancestors(nodes) if up is None else up
    return leaves.join(up, "node").groupBy("sample", "ancestor").agg(F.sum("pct").alias("pct")).withColumnRenamed("ancestor", "node")


def cami(rolled: DataFrame, nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(sample, taxid, rank, taxpath, taxpathsn, percentage): rows of the CAMI profile, of nodes of RANKS
    alone, on rows and paths; paths stop below the root."""
    up = ancestors(nodes) if up is None else up
    ranked = nodes.where(F.col("rank").isin(*RANKS))
    names = ranked.select(F.col("node").alias("ancestor"), "name")
    path = up.join(names, "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("h"), "ancestor", "name"))).alias("p"))
    path = path.select("node", F.array_join(F.transform("p", lambda x: x["ancestor"].cast("string")), "|").alias("taxpath"), F.array_join(F.transform("p", lambda x: x["name"]), "|").alias("taxpathsn"))
    j = rolled.join(ranked.select("node", "rank"), "node").join(path, "node")
    return j.select("sample", F.col("node").alias("taxid"), "rank", "taxpath", "taxpathsn", F.format_string("%.4f", "pct").alias("percentage"))


def species(cov: DataFrame, psids: DataFrame, depth: Column, min_shared: int) -> DataFrame:
    """(sample, node, pct) from coverage rows with more than min_shared shared: a reference's name begins
    with its psid, which psids (psid, node) leads to a species; psids of one species are summed."""
    d = cov.where(F.col("shared") > min_shared).select(sample_name(F.col("sample").cast("string")).alias("sample"), psid(F.col("ref")).alias("psid"), depth.alias("depth")).where("depth is not null")
    return d.join(psids, "psid").groupBy("sample", "node").agg(F.sum("depth").alias("depth")).withColumn("pct", F.lit(100.0) * F.col("depth") / F.sum("depth").over(Window.partitionBy("sample"))).select("sample", "node", "pct")


def taxonomy(cov: DataFrame, psids: DataFrame, nodes: DataFrame, depth: Column, min_shared: int) -> DataFrame:
    """Coverage to CAMI rows: species, roll-up, paths."""
    up = ancestors(nodes)
    return cami(rollup(species(cov, psids, depth, min_shared), nodes, up), nodes, up)


def by_rank(profile: DataFrame) -> DataFrame:
    """Adds place: rank by rank from the top, then falling percentage, then taxid."""
    order = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("rank"))
    return profile.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy(order, F.col("percentage").cast("double").desc(), "taxid")))


def cami_lines(profile: DataFrame, sample: str) -> list[str]:
    """A sample's profile file: its seven header lines, then rows by rank and falling percentage. A
    profile has a row per taxon, and is a text file by nature."""
    head = ["# Taxonomic Profiling Output", f"@SampleID:{sample}", "@Version:0.9.1", f"@Ranks:{'|'.join(RANKS)}", "@TaxonomyID:ncbi-taxonomy", "@__program__:kmerframe", "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"]
    rows = by_rank(profile.where(F.col("sample").cast("string") == sample)).orderBy("place")
    return head + [r[0] for r in rows.select(F.concat_ws("\t", F.col("taxid").cast("string"), "rank", "taxpath", "taxpathsn", "percentage")).collect()]
