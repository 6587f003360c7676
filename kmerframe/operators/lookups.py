"""Small table look-ups on delimited lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISS = "==no match=="


def semi(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (line_no, key, line) whose key is wanted; line_no keeps the order."""
    return lines.join(wanted.select("key"), "key", "left_semi").select("line_no", "key", "line")


def ordered(selection: DataFrame, lines: DataFrame) -> DataFrame:
    """For every row (pos, key) of the selection the last line with that key, or MISS."""
    last = lines.groupBy("key").agg(F.max_by("line", "line_no").alias("line"))
    return selection.join(last, "key", "left").select("pos", "key", F.coalesce("line", F.lit(MISS)).alias("line"))


def left_na(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows (key) with project, sample and organism; NA where unknown. The key loses .fastq and .abv;
    metadata without sample or organism doesn't count."""
    key = F.regexp_replace(F.col("key"), r"\.(fastq|abv)", "")
    m = meta.where(F.col("biosample").isNotNull() & F.col("organism").isNotNull()).select("run", "bioproject", "biosample", "organism")
    j = rows.select(key.alias("run")).join(m, "run", "left")
    na = lambda c: F.coalesce(c, F.lit("NA")).alias(c)
    return j.select("run", na("bioproject"), na("biosample"), na("organism"))


def lineage(species: DataFrame, lineages: DataFrame) -> DataFrame:
    """(species, levels) from lineage strings 'd__..;p__..;...;s__..'; a species without a lineage raises."""
    name = F.regexp_extract("lineage", ";s__([^;]+)", 1)
    table = lineages.select(name.alias("species"), "lineage")
    j = species.select("species").join(table, "species", "left")
    found = F.when(F.col("lineage").isNull(), F.raise_error(F.concat(F.lit("no lineage for "), "species"))).otherwise(F.col("lineage"))
    return j.select("species", F.array_join(F.transform(F.split(found, ";"), lambda x: F.regexp_replace(x, "^[dpcofgs]__", "")), "\t").alias("levels"))
