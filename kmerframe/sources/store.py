"""Sketches at rest: parquet tables sketch, genomes and a one-row meta, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import heading, lines
from ..plans.params import SketchParams


def write(sketch: DataFrame, names: DataFrame, p: SketchParams, path: str, shuf_id: str | None = None) -> None:
    spark = sketch.sparkSession
    sketch.repartition("code").write.mode("errorifexists").parquet(f"{path}/sketch")
    n = spark.read.parquet(f"{path}/sketch").groupBy("gid").agg(F.count(F.lit(1)).alias("n_codes"))
    names.join(n, "gid", "left").select("gid", "name", F.coalesce("n_codes", F.lit(0)).alias("n_codes")).write.parquet(f"{path}/genomes")
    row = (shuf_id or p.seed, "cnt" in sketch.columns, p.k, p.subk, p.level)
    spark.createDataFrame([row], "shuf_id string, counts boolean, k int, subk int, level int").coalesce(1).write.parquet(f"{path}/meta")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/sketch"), spark.read.parquet(f"{path}/genomes"), spark.read.parquet(f"{path}/meta").first().asDict()


def check_compatible(a: dict, b: dict) -> None:
    """Raises unless both were sampled alike."""
    if any(a[k] != b[k] for k in ("shuf_id", "k", "subk", "level")):
        raise ValueError(f"sketches differ in sampling: {a} and {b}")


def write_distances(dist: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    dist.write.option("sep", "\t").option("header", True).csv(path)


def write_distance_table(found: DataFrame, path: str, kind: str = "jaccard", level: int = 2, **options: str) -> None:
    """A folder of text, written with options of Spark's writer: the heading in its first file, then a line per pair."""
    head = found.sparkSession.createDataFrame([(heading(kind, level),)], "value string")
    head.coalesce(1).write.options(**options).text(path)
    lines(found, level).select(F.col("line").alias("value")).write.mode("append").options(**options).text(path)


def write_kmers(decoded: DataFrame, names: DataFrame, path: str) -> None:
    """A folder of text for each genome, a k-mer a line; blanks in names become _."""
    named = decoded.join(names, "gid").select(F.regexp_replace("name", " ", "_").alias("genome"), F.col("kmer").alias("value"))
    named.write.partitionBy("genome").text(path)
