"""The command line: dist, set, composite, profile, reverse and shuffle over stores (sources/store.py).

python -m kmerframe.plans.commands COMMAND ... ; main(argv, spark) does the same within a program.
Threads and memory are Spark's, so -p and -m are accepted and have no effect. dist gives the pairs
that share a code; --all-pairs adds those that share none."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, coverage, decode, profile, setops, sketch
from ..sources import fastx, shuf, store
from .params import SketchParams
from .session import written

SMALL = 200_000  # names that are broadcast
MEASURES = ("cosine", "l1", "l2")  # fixed order of composite -s


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerframe")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, options: str, flags: str = "", **kinds) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for o in options.split():
            c.add_argument(f"-{o}", type=kinds.get(o, str))
        for o in flags.split():
            c.add_argument(o if o.startswith("-") else f"-{o}", action="store_true")
        c.add_argument("inputs", nargs="*")
        return c

    d = command("dist", "k p l L m n Q r o N D M O f", "A u --correction --keepskf --byread --all-pairs --table", k=int, n=int, Q=int, N=int, D=float, M=int, O=int)
    d.set_defaults(k=8, L="2", n=1, Q=0, N=0, D=1.0, M=0, O=2)
    command("set", "s i p g o", "u q c P")
    command("composite", "r q o p s", "b i d", s=int)
    command("reverse", "o p L", "--byread")
    command("profile", "t n m S o", S=int).set_defaults(m="poisson", S=18)
    command("shuffle", "k s l o", "--usedefault", k=int, s=int, l=int).set_defaults(k=8, s=5, l=2)
    return top


def params_of(level: str, k: int) -> tuple[SketchParams, str | None]:
    """Parameters and permutation id from a .shuf file or a level."""
    if level.endswith(".shuf"):
        p = shuf.params_of(level)
        return p, p.seed
    return SketchParams.for_level(int(level), k), None


def sketched(spark: SparkSession, paths: list[str], p: SketchParams, least: int = 1, quality: int = 0, counts: bool = False, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sketch, names) of sequence files, a genome each. Counts are for FASTQ alone."""
    kinds = [fastx.kind_of(x) for x in paths]
    least = min(max(least, 1), sketch.MOST_OCCURRENCES)
    seqs = fastx.read_any(spark, paths, 0 if counts else quality)
    names = spark.createDataFrame([(k, x.rsplit("/", 1)[-1]) for k, x in enumerate(paths)], "gid long, name string")
    if counts and "fasta" not in kinds:
        return sketch.counted(seqs, p), names
    if once:
        return sketch.unrepeated(seqs, p), names
    reads = fastx.is_fastq(F.col("path"))
    parts = []
    if "fasta" in kinds:
        parts.append(sketch.codes(seqs.where(~reads), p))
    if "fastq" in kinds:
        mine = seqs.where(reads)
        parts.append(sketch.min_occurrence(mine, p, least) if least > 1 else sketch.codes(mine, p, drop_zero=False))
    return (parts[0] if len(parts) == 1 else parts[0].union(parts[1])), names


def by_read(spark: SparkSession, paths: list[str], p: SketchParams) -> DataFrame:
    """(gid, read_no, code) of FASTA records."""
    files = fastx.read_any(spark, paths, records=True)
    return sketch.by_read(files.withColumnRenamed("record_no", "read_no"), p)


def _is_store(spark: SparkSession, path: str) -> bool:
    return fastx.exists(spark, f"{path}/meta")


def _opened(spark: SparkSession, paths: list[str], a) -> tuple[DataFrame, DataFrame, dict]:
    """One store, or sequence files sketched as the options tell."""
    if len(paths) == 1 and _is_store(spark, paths[0]):
        return store.read(spark, paths[0])
    p, sid = params_of(a.L, a.k)
    s, names = sketched(spark, paths, p, a.n, a.Q, a.A, a.u)
    meta = {"shuf_id": sid or p.seed, "counts": "cnt" in s.columns, "k": p.k, "subk": p.subk, "level": p.level}
    return s, setops.genome_names(s, names), meta


def compared(query: tuple, ref: tuple, kind: str = "jaccard", level: int = 2, nearest: int = 0, most: float = 1.0, correction: bool = False, shared: DataFrame | None = None, all_pairs: bool = False) -> DataFrame:
    """Distances of all genomes of two opened stores, with names. level: 0 similarity and distance, 1 also
    p-values, 2 also bounds."""
    (q, qn, qm), (r, rn, rm) = query, ref
    store.check_compatible(qm, rm)
    qn, rn = (n.where("n_codes > 0") for n in (qn, rn))
    if shared is not None:
        found = shared
    elif q is r:
        found = compare.all_counts(q)
    else:
        found = compare.shared_counts(q, r)
    if all_pairs:
        found = compare.dense(found, qn.select(F.col("gid").alias("qid")), rn.select(F.col("gid").alias("rid")))
    many = qn.count(), rn.count()
    few = [F.broadcast(n) if m <= SMALL else n for n, m in zip((qn, rn), many, strict=True)]  # pairs are shuffled no more than needed
    sized = found.join(few[0].select(F.col("gid").alias("qid"), F.col("name").alias("qry"), F.col("n_codes").alias("qry_s")), "qid")
    sized = sized.join(few[1].select(F.col("gid").alias("rid"), F.col("name").alias("ref"), F.col("n_codes").alias("ref_s")), "rid")
    d = compare.distances(sized, kind, qm["k"], qm["level"], correction, confidence=level > 0)
    if level > 0:
        d = compare.p_values(d, many[0] * many[1])
    d = compare.nearest(d, nearest, most) if nearest else compare.within(d, most)
    extra = (["p_value", "fdr"] if level > 0 else []) + (["m_lo", "m_hi", "d_lo", "d_hi"] if level > 1 else [])
    return d.select("qry", "ref", "shared", "qry_s", "ref_s", "metric", "dist", *extra, "rs")


def _dist(spark: SparkSession, a) -> None:
    paths = fastx.read_list(spark, a.l) if a.l else fastx.expand(spark, a.inputs)
    if a.byread:
        by_read(spark, paths, params_of(a.L, a.k)[0]).write.parquet(a.o)
        return
    if not a.r:
        if len(paths) > 1 and all(_is_store(spark, x) for x in paths):
            _combine(spark, paths, a.o)
            return
        p, sid = params_of(a.L, a.k)
        s, names = sketched(spark, paths, p, a.n, a.Q, a.A, a.u)
        store.write(s, names, p, a.o, sid)
        return
    query, ref = _opened(spark, paths, a), _opened(spark, fastx.expand(spark, [a.r]), a)
    shared = spark.read.parquet(a.f) if a.f else None
    if a.keepskf and shared is None:
        compare.shared_counts(query[0], ref[0]).write.parquet(f"{a.o}/shared_counts")
        shared = spark.read.parquet(f"{a.o}/shared_counts")
    kind = ("jaccard", "containment")[a.M]
    found = compared(query, ref, kind, a.O, a.N, a.D, a.correction, shared, a.all_pairs)
    if a.table:
        store.write_distance_table(found, f"{a.o}/distance", kind, a.O)
    else:
        store.write_distances(found.drop("rs"), f"{a.o}/distance")


def _params(meta: dict) -> SketchParams:
    """Parameters as a store's meta tells them; enough to write another store."""
    return SketchParams(meta["k"], meta["subk"], meta["level"], meta["shuf_id"])


def _combine(spark: SparkSession, paths: list[str], out: str) -> None:
    """Stores one after the other, gids of later ones following."""
    opened = [store.read(spark, x) for x in paths]
    low, codes, names = 0, [], []
    for s, n, meta in opened:
        store.check_compatible(opened[0][2], meta)
        codes.append(s.select((F.col("gid") + low).alias("gid"), "code"))
        names.append(n.select((F.col("gid") + low).alias("gid"), "name"))
        low += (n.agg(F.max("gid")).first()[0] or 0) + 1
    for k in range(1, len(opened)):
        codes[0], names[0] = codes[0].union(codes[k]), names[0].union(names[k])
    store.write(codes[0], names[0], _params(opened[0][2]), out)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(gid, taxid, taxname): line n of the file is genome n's taxid and, after a blank, its group's name."""
    lines = [r[0] for r in spark.read.text(path).coalesce(1).collect()]  # a line per genome, in order
    cut = [x.split(None, 1) for x in lines if x.strip()]
    return spark.createDataFrame([(k, int(c[0]), c[1].strip() if len(c) > 1 else None) for k, c in enumerate(cut)], "gid long, taxid long, taxname string")


def _set(spark: SparkSession, a) -> DataFrame | None:
    s, names, meta = store.read(spark, a.inputs[0])
    if a.P:
        return names.select("n_codes", "name").orderBy("gid")
    one = spark.createDataFrame([(0, os.path.basename(a.inputs[0].rstrip("/")))], "gid long, name string")
    if a.u or a.q:
        pan = setops.union(s) if a.u else setops.unique_union(s)
        s, names = pan.select(F.lit(0).cast("long").alias("gid"), "code"), one
    elif a.s or a.i:
        pan, _, other = store.read(spark, a.s or a.i)
        store.check_compatible(meta, other)
        s = (setops.subtract if a.s else setops.intersect)(s, setops.union(pan)).select(*s.columns)
    elif a.c:
        for x in a.inputs[1:]:
            store.check_compatible(meta, store.read(spark, x)[2])
        t = setops.combine_pans([(os.path.basename(x.rstrip("/")), setops.union(store.read(spark, x)[0])) for x in a.inputs])
        s, names = t.select("gid", "code"), t.select("gid", "name").distinct()
    elif a.g:
        groups = read_groups(spark, a.g)
        if groups.count() != names.count():
            raise ValueError("a group file has a line per genome")
        setops.check_groups(s, groups)
        t = setops.group(s, groups).withColumnRenamed("taxid", "gid")
        s, names = t.select("gid", "code"), t.select("gid", "name").distinct()
    else:
        raise ValueError("set needs one of -u -q -i -s -c -g -P")
    store.write(s, names.select("gid", "name"), _params(meta), a.o)
    return None


def _composite(spark: SparkSession, a) -> DataFrame | None:
    vectors = f"{a.r}/abundance_Vec" if a.r else None
    if a.d:
        return spark.read.parquet(*a.inputs).select("sample", "ref", "pct").orderBy("sample", "ref")
    if a.i:
        coverage.index(spark.read.parquet(vectors)).write.parquet(f"{a.r}/abundance_index")
        return None
    if a.s is not None:
        found = coverage.search(spark.read.parquet(*a.inputs), spark.read.parquet(f"{a.r}/abundance_index"), MEASURES[a.s])
        return coverage.ranked(found, MEASURES[a.s]).orderBy("qid", "place")
    (m, mn, mm), (s, sn, sm) = store.read(spark, a.r), store.read(spark, a.q)
    store.check_compatible(mm, sm)
    if not sm["counts"]:
        raise ValueError("composite needs a sample with counts: dist -A")
    markers = m.join(mn.select("gid", F.col("name").alias("ref")), "gid").select("ref", "code")
    sample = s.join(sn.select("gid", F.col("name").alias("sample")), "gid").select("sample", "code", "cnt")
    cov = coverage.coverage(markers, sample)
    if a.b:
        coverage.abundance(cov).write.mode("append").parquet(a.o or vectors)
        return None
    if a.o:
        store.write_distances(coverage.ordered(cov), a.o)
        return None
    return coverage.ordered(cov).orderBy("sample", "place")


def _tabbed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def _profile(spark: SparkSession, a) -> None:
    """Profile files from what composite -o wrote. -t leads from psid to species, -n has the nodes, -m is the
    depth model, -S the shared codes that a reference must exceed."""
    cov = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(a.inputs)
    psids = _tabbed(spark, a.t, "psid string, node long")
    nodes = _tabbed(spark, a.n, "node long, rank string, parent long, name string")
    top = F.col("avgpct9899")
    depth = {"poisson": profile.poisson_depth(top), "deviation": profile.deviation_depth(top), "two-tier": profile.two_tier_depth(top, F.col("median"), F.col("shared"), s=a.S)}[a.m]
    found = written(profile.taxonomy(cov, psids, nodes, depth, a.S), "profile")
    for r in found.select("sample").distinct().toLocalIterator():  # a file for each sample
        spark.createDataFrame([(x,) for x in profile.cami_lines(found, r.sample)], "value string").coalesce(1).write.text(f"{a.o}/{r.sample}.profile")


def _reverse(spark: SparkSession, a) -> None:
    if a.byread:
        reads = spark.read.parquet(a.inputs[0])
        store.write_distances(decode.decode_reads(reads, params_of(a.L, 8)[0]), a.o)
        return
    s, names, meta = store.read(spark, a.inputs[0])
    p = params_of(a.L, meta["k"])[0] if a.L else _params(meta)
    if p.seed != meta["shuf_id"]:
        raise ValueError("the permutation is not the one of the sketch")
    store.write_kmers(decode.decode(s, p), names, a.o)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs a command; returns what it would print, or None if it wrote its result."""
    a = _parser().parse_args(argv)
    if a.command == "shuffle":
        out = a.o or "./default"
        shuf.write_shuf(out if out.endswith(".shuf") else f"{out}.shuf", SketchParams(8, 5, 2) if a.usedefault else SketchParams(a.k, a.s, a.l))
        return None
    spark = spark or SparkSession.builder.appName("kmerframe").getOrCreate()
    return {"dist": _dist, "set": _set, "composite": _composite, "profile": _profile, "reverse": _reverse}[a.command](spark, a)


if __name__ == "__main__":
    shown = main()
    if shown is not None:
        for row in shown.toLocalIterator():
            print(*row, sep="\t")
