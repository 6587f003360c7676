"""Sketch codes back to k-mers, by built-in functions and a join with the kept dimensions
(16^(subk - level) rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.params import SketchParams


BROADCAST = 1 << 16  # rows that are broadcast at most; beyond, Spark joins as it sees fit


def decode(sketch: DataFrame, p: SketchParams) -> DataFrame:
    """Adds u (the 2-bit code) and kmer."""
    if p.kept != 16 ** (p.subk - p.level):
        raise ValueError("codes can be decoded only if 16^(subk - level) dimensions are kept")
    dims, ranks = p.permutation()
    back = sketch.sparkSession.createDataFrame(list(zip(ranks.tolist(), dims.tolist(), strict=True)), "_rank long, _dim long")
    side = (1 << (2 * p.outer)) - 1
    rest = F.shiftright("code", p.rank_bits)
    u = F.shiftleft(F.shiftright(rest, 2 * p.outer), 2 * (p.k + p.subk)).bitwiseOR(F.shiftleft("_dim", 2 * p.outer)).bitwiseOR(rest.bitwiseAND(F.lit(side)))
    kmer = F.translate(F.lpad(F.conv(F.col("u").cast("string"), 10, 4), p.width, "0"), "0123", "ACGT")
    return sketch.withColumn("_rank", F.col("code").bitwiseAND(F.lit(p.kept - 1))).join(F.broadcast(back) if p.kept <= BROADCAST else back, "_rank").withColumn("u", u).withColumn("kmer", kmer).drop("_rank", "_dim")


def decode_reads(reads: DataFrame, p: SketchParams) -> DataFrame:
    """(gid, read_no, kmer) in order of reads."""
    return decode(reads, p).select("gid", "read_no", "kmer").orderBy("gid", "read_no", "kmer")
