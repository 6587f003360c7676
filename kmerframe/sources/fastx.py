"""FASTA and FASTQ readers. Compressed files (.gz, .bz2) are read by Spark's own codecs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of either format.
FASTA = ("fna", "fas", "fasta", "fa")
FASTQ = ("fq", "fastq")
_SUFFIX = re.compile(rf"\.({'|'.join(FASTA + FASTQ)})(\.gz|\.bz2)?$", re.I)


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, record_no, header, seq): a row per record; records begin at a > at a line's start, line ends
    stay in seq (sketching skips them)."""
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("record_no"))
    body = F.regexp_replace("value", "^>", "")
    cut = F.locate("\n", F.col("body"))
    d = raw.withColumn("body", body).where(F.length(F.trim("body")) > 0)
    return d.select("path", "record_no", F.trim(F.when(cut > 0, F.substring_index("body", "\n", 1)).otherwise(F.col("body"))).alias("header"), F.when(cut > 0, F.expr("substring(body, locate('\n', body) + 1)")).otherwise(F.lit("")).alias("seq"))


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, record_no, header, seq, qual): four lines a record, of any length; a last record without a
    line end counts. Lines are numbered from the counts of the blocks before theirs, so that a file is
    read by as many tasks as it has blocks."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = blocks.select("path", "block", "first", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))
    d = lines.join(before, ["path", "block"]).withColumn("n", F.col("at") - F.col("first") + F.col("before")).withColumn("record_no", F.floor(F.col("n") / 4)).withColumn("part", F.col("n") % 4)
    at = lambda k: F.max(F.when(F.col("part") == k, F.rtrim("value")))
    g = d.groupBy("path", "record_no").agg(at(0).alias("h"), at(1).alias("seq"), at(3).alias("qual"))
    return g.where(F.col("seq").isNotNull()).select("path", "record_no", F.regexp_replace("h", "^@", "").alias("header"), "seq", "qual")


def kind_of(path: str) -> str:
    m = _SUFFIX.search(path)
    if not m:
        raise ValueError(f"not a sequence file: {path}")
    return "fasta" if m[1].lower() in FASTA else "fastq"


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file, one a line, blanks trimmed, empty lines skipped. A list names the input files."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).collect() if r[0]]


def is_fastq(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(FASTQ)})(\.gz|\.bz2)?$")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """Folders that aren't stores become the sequence files right in them, by name."""
    out = []
    for path in paths:
        p, fs = _hadoop(spark, path)
        if exists(spark, f"{path}/meta") or not (fs.exists(p) and fs.getFileStatus(p).isDirectory()):
            out.append(path)
            continue
        inside = sorted(f"{path.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isFile())
        for x in inside:
            kind_of(x)
        out += inside
    return out


def _named(uri: Column | str) -> Column:
    """One spelling of a URI: file:/a and file:///a are the same file."""
    return F.regexp_replace(uri, "^([a-zA-Z0-9+.-]+):/+", "$1:/")


def read_any(spark: SparkSession, paths: list[str], min_quality: int = 0, records: bool = False) -> DataFrame:
    """(gid, path, seq): each file is one genome, its gid its place in the list of paths. records: with record_no."""
    from ..operators.sketch import mask_quality

    cols = ["path", "record_no", "seq"] if records else ["path", "seq"]
    parts = []
    for kind in ("fasta", "fastq"):
        mine = [p for p in paths if kind_of(p) == kind]
        if not mine:
            continue
        if kind == "fasta":
            parts.append(read_fasta(spark, mine).select(*cols))
        else:
            d = read_fastq(spark, mine).select(*cols, "qual")
            parts.append((mask_quality(d, min_quality) if min_quality else d).select(*cols))
    whole = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    full = [fs.makeQualified(p).toUri().toString() for p, fs in (_hadoop(spark, x) for x in paths)]
    names = spark.createDataFrame(list(enumerate(full)), "gid long, _file string").withColumn("_file", _named("_file"))
    return whole.join(names, _named("path") == F.col("_file")).select("gid", *cols)
