"""Hand-made fixtures and properties of the sketch engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerframe.functions import sequence as sq
from kmerframe.operators import compare, coverage, decode, lookups, profile, setops, sketch
from kmerframe.plans import catalogue, roundtrips
from kmerframe.plans.params import SketchParams
from kmerframe.sources import fastx, store

P = SketchParams(k=8, subk=4, level=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_kmers(text, width):
    import pyarrow as pa

    row, u = sq.kmers(*sq.values(pa.array([text])), width)
    return u.tolist()


def brute(text, width):
    out, run = [], ""
    for c in text.replace("\n", "").replace("\r", ""):
        run = run + c.upper() if c.upper() in "ACGT" else ""
        if len(run) >= width:
            out.append(int("".join(str("ACGT".index(x)) for x in run[-width:]), 4))
    return out


@pytest.mark.parametrize("text", ["ACGTACGT", "acgtNacgta", "AC\nGT\r\nAC", "", "A" * 9, "xxACGTAxx", "ACGTéACGTA"])
@pytest.mark.parametrize("width", [4, 5, 6])
def test_kmers(text, width):
    assert plain_kmers(text, width) == brute(text, width)


def test_canonical_is_strand_free():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 4**16, 500)
    assert (sq.canonical(u, 16) == sq.canonical(sq.reverse_complement(u, 16), 16)).all()
    assert (sq.reverse_complement(sq.reverse_complement(u, 16), 16) == u).all()


def test_params():
    for bad in (dict(k=16), dict(k=4, subk=5), dict(k=8, subk=8), dict(k=8, subk=4, level=2), dict(k=8, level=6)):
        with pytest.raises(ValueError):
            SketchParams(**bad)
    assert SketchParams.for_level(1).kept == 4096


def test_decode_inverts_encode(spark):
    rng = np.random.default_rng(2)
    u = np.unique(sq.canonical(rng.integers(0, 4**16, 20000), 16))
    kept, code = sketch.encode(u, P)
    assert abs(kept.mean() * 16 - 1) < 0.2
    df = spark.createDataFrame([(1, int(c)) for c in code], "gid long, code long")
    assert sorted(r.u for r in decode.decode(df, P).collect()) == sorted(u[kept].tolist())


def test_sketch_kinds(spark):
    seq = "ACGGTCATTGCAATGC" * 40 + "N" + "ACGGTTTTTGCAATGCAGG"
    d = spark.createDataFrame([(1, seq), (2, None), (3, "ACGT")], "gid long, seq string")
    counted = {r.code: r.cnt for r in sketch.counted(d, P).collect()}
    assert {r.code for r in sketch.codes(d, P).collect()} == set(counted) - {0}
    assert {r.code for r in sketch.min_occurrence(d, P, 3).collect()} == {c for c, n in counted.items() if n >= 3}
    assert {r.code for r in sketch.unrepeated(d, P).collect()} == {c for c, n in counted.items() if n == 1} - {0}
    assert sketch.by_read(d.withColumn("read_no", F.lit(1)), P).count() == sum(counted.values())
    with pytest.raises(ValueError):
        sketch.min_occurrence(d, P, 8)


def test_quality_mask(spark):
    d = spark.createDataFrame([(1, "ACGT", "II!I"), (2, "", "")], "gid long, seq string, qual string")
    assert rows(sketch.mask_quality(d, 40).select("gid", "seq")) == [(1, "ACNT"), (2, "")]


def test_set_identities(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 4)], "gid long, code long")
    pan = spark.createDataFrame([(2,), (4,)], "code long")
    assert rows(setops.union(s)) == [(1,), (2,), (3,), (4,)]
    assert rows(setops.unique_union(s)) == [(1,), (3,), (4,)]
    assert setops.intersect(s, pan).count() + setops.subtract(s, pan).count() == s.count()
    g = spark.createDataFrame([(1, 7, "x"), (2, 7, "x"), (3, 0, None)], "gid long, taxid int, taxname string")
    assert rows(setops.group(s, g)) == [(7, "7_x", 1), (7, "7_x", 2), (7, "7_x", 3)]
    setops.check_groups(s, g)
    with pytest.raises(ValueError):
        setops.check_groups(s, g.where("gid < 3"))
    assert rows(setops.combine([s, s])) == sorted([(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (5, 1), (5, 2), (6, 2), (6, 3), (7, 4)])


def test_distances(spark):
    p = spark.createDataFrame([(1, 2, 0, 5, 5), (1, 3, 5, 5, 5), (1, 4, 2, 4, 8), (1, 5, 0, 0, 0)], "qid long, rid long, shared long, qry_s long, ref_s long")
    j = {r.rid: r for r in compare.distances(p, confidence=True).collect()}
    assert (j[2].metric, j[2].dist) == (0, 1) and (j[3].metric, j[3].dist) == (1, 0)
    assert j[4].metric == 0.2 and math.isclose(j[4].dist, math.log(1 / 0.4 + 0.5) / 16)
    assert math.isnan(j[5].metric) and math.isnan(j[5].dist)
    c = {r.rid: r for r in compare.distances(p, "containment").collect()}
    assert c[4].metric == 0.5 and math.isclose(c[4].dist, math.log(2) / 16)
    v = {r.rid: r for r in compare.p_values(compare.distances(p, confidence=True), 4).collect()}
    sd = math.sqrt(0.2 * 0.8 / 10)
    assert math.isclose(v[4].p_value, 0.5 * math.erfc(0.2 / sd / math.sqrt(2))) and math.isclose(v[4].fdr, 4 * v[4].p_value)
    assert [r.rid for r in compare.nearest(compare.distances(p), 1).collect()] == [3]


def test_p_values(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 20, 30), (1, 3, 0, 20, 30), (2, 3, 7, 7, 7), (3, 4, 0, 0, 0)], "qid long, rid long, shared long, qry_s long, ref_s long")
    for kind in ("jaccard", "containment"):
        out = compare.p_values(compare.distances(pairs, kind, confidence=True), 12).collect()
        for r in out:
            den = r.qry_s + r.ref_s - r.shared if kind == "jaccard" else min(r.qry_s, r.ref_s)
            m = r.shared / den if den else math.nan
            sd = math.sqrt(m * (1 - m) / den) if den else math.nan
            want = 0.5 * math.erfc(m / sd / math.sqrt(2)) if sd > 0 else 0.0 if m > 0 else math.nan
            assert (r.p_value, r.fdr) == pytest.approx((want, want * 12), nan_ok=True)


@pytest.mark.parametrize("n", [5, 6, 7, 50, 100, 101])
def test_coverage_statistics(spark, n):
    a = sorted(((i * 37) % 91) + 1 for i in range(n))
    m = spark.createDataFrame([("r", i) for i in range(n)], "ref string, code long")
    s = spark.createDataFrame([(1, i, a[i]) for i in range(n)], "sample long, code long, cnt long")
    got = coverage.coverage(m, s).collect()
    if n < 6:
        assert not got
        return
    lo, hi = math.floor(n * 0.98), math.floor(n * 0.99)
    top = a[lo - 1 : hi]
    g = got[0]
    assert (g.shared, g.median, g.max) == (n, a[n // 2 - 1], a[-1])
    assert math.isclose(g.avgpct9899, sum(top) / len(top) if top else 0.0)


def test_search_of_equal_vectors(spark):
    v = spark.createDataFrame([(1, "a", 40.0), (1, "b", 60.0), (2, "a", 100.0), (3, "c", 100.0)], "sample long, ref string, pct double")
    l1 = {(r.qid, r.sample): r.score for r in coverage.search(v, v, "l1").collect()}
    assert l1[1, 1] == 0 and l1[1, 2] == 120 and (1, 3) not in l1
    cos = {(r.qid, r.sample): r.score for r in coverage.search(v, v, "cosine").collect()}
    assert math.isclose(cos[1, 1], 1)


def test_profile_files(spark):
    nodes = spark.createDataFrame([(10, "superkingdom", 1, "B"), (20, "species", 10, "s"), (21, "species", 10, "t")], "node long, rank string, parent long, name string")
    leaves = spark.createDataFrame([("x", 20, 25.0), ("x", 21, 75.0)], "sample string, node long, pct double")
    lines = profile.cami_lines(profile.cami(profile.rollup(leaves, nodes), nodes), "x")
    assert len(lines) == 10 and lines[7] == "10\tsuperkingdom\t10\tB\t100.0000" and lines[8] == "21\tspecies\t10|21\tB|t\t75.0000"


def test_lineage_raises(spark):
    s = spark.createDataFrame([("a",), ("z",)], "species string")
    t = spark.createDataFrame([("d__B;p__P;s__a",)], "lineage string")
    with pytest.raises(Exception, match="no lineage"):
        lookups.lineage(s, t).collect()


def test_fastx(spark, tmp_path):
    from kmerframe.sources import fastx, shuf

    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\nGG>T\n")
    got = [(r.path.rsplit("/", 1)[1], r.header, r.seq.replace("\n", "")) for r in fastx.read_fasta(spark, [str(tmp_path / "a.fa")]).orderBy("record_no").collect()]
    assert got == [("a.fa", "one x", "ACGTAC"), ("a.fa", "two", "GG>T")]
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n@!")
    assert [(r.header, r.seq, r.qual) for r in fastx.read_fastq(spark, [str(tmp_path / "b.fq")]).orderBy("record_no").collect()] == [("r1", "ACGT", "IIII"), ("r2", "GG", "@!")]
    with pytest.raises(ValueError):
        fastx.read_any(spark, [str(tmp_path / "x.txt")])
    shuf.write_shuf(str(tmp_path / "p.shuf"), P)
    head, ranks = shuf.read_shuf(str(tmp_path / "p.shuf"))
    assert head["k"] == 8 and sorted(ranks.tolist()) == list(range(P.dims))
    dims, kept = P.permutation()
    assert (ranks[dims] == kept).all()


def test_queries_have_oracles():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 40


def test_nearest_ranks_uncorrected(spark):
    """The correction changes the similarity, not the order: a pair that it takes to 0 or under stays."""
    p = spark.createDataFrame([(1, 2, 1, 900, 900), (1, 3, 40, 100, 2000), (1, 4, 0, 10, 10)], "qid long, rid long, shared long, qry_s long, ref_s long")
    d = compare.distances(p, k=4, level=1, correction=True)
    assert {r.rid: r.metric < 0 for r in d.where("rid < 4").collect()}[2]
    assert [r.rid for r in compare.nearest(d, 2).orderBy("rank").collect()] == [3, 2]


def test_unranked_nodes_stay_out(spark):
    nodes = spark.createDataFrame([(10, "superkingdom", 1, "B"), (15, "clade", 10, "c"), (20, "species", 15, "s")], "node long, rank string, parent long, name string")
    leaves = spark.createDataFrame([("x", 20, 100.0)], "sample string, node long, pct double")
    assert rows(profile.cami(profile.rollup(leaves, nodes), nodes).select("taxid", "taxpath", "taxpathsn")) == [(10, "10", "B"), (20, "10|20", "B|s")]


def test_species(spark):
    cov = spark.createDataFrame([("a b", "p1_x", 20, 9.0), ("a b", "p2_y", 30, 6.0), ("a b", "p3", 18, 9.0), ("a b", "p4_z", 25, 6.0)], "sample string, ref string, shared long, avgpct9899 double")
    psids = spark.createDataFrame([("p1", 7), ("p2", 8), ("p3", 9), ("p4", 8)], "psid string, node long")
    got = rows(profile.species(cov, psids, profile.poisson_depth(F.col("avgpct9899")), 18))
    assert got == [("a_b", 7, 50.0), ("a_b", 8, 50.0)]


def test_distance_lines(spark):
    p = spark.createDataFrame([("q", "r", 0, 5, 6), ("q", "s", 0, 0, 0)], "qry string, ref string, shared long, qry_s long, ref_s long")
    got = [r.line for r in compare.lines(compare.distances(p), 0).orderBy("ref").collect()]
    assert got == ["q\tr\t0-0|6|5\t0.000000\t1.000000", "q\ts\t0-0|0|0\tnan\tnan"]


def test_pairs_are_counted_within_ranges_of_codes(spark, monkeypatch):
    """Genomes that share many codes of a range reach the shuffle as one row, and nothing is lost at the bounds of batches."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(c), int(g)) for c, g in zip(rng.integers(0, 60, 900), rng.integers(0, 25, 900), strict=True)} | {(99, g) for g in range(40)})
    want: dict[tuple[int, int], int] = {}
    for c in {c for c, _ in rows}:
        gids = [g for x, g in rows if x == c]
        for q in gids:
            for r in gids:
                if q < r:
                    want[q, r] = want.get((q, r), 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array([g for _, g in rows]), pa.array([c for c, _ in rows])], ["gid", "code"])
    for most, chunk, size in ((1 << 18, 1 << 22, 1000), (1, 1, 7), (50, 300, 7), (10, 1 << 22, 1)):
        monkeypatch.setattr(compare, "ROWS", most)
        monkeypatch.setattr(compare, "CHUNK", chunk)
        got = [tuple(r.values()) for b in compare._local_pairs(iter([batch.slice(k, size) for k in range(0, len(rows), size)])) for r in b.to_pylist()]
        sums: dict[tuple[int, int], int] = {}
        for q, r, n in got:
            sums[q, r] = sums.get((q, r), 0) + n
        assert sums == want and (most < 1000 or len(got) == len(want))
    s = spark.createDataFrame([(g, c) for c, g in rows] + [(None, 1), (1, None)], "gid long, code long")
    for hot in (2048, 20):
        monkeypatch.setattr(compare, "HOT", hot)
        assert {(r.qid, r.rid): r.shared for r in compare.pair_counts(s).collect()} == want
    s = s.where("gid is not null and code is not null")
    assert sorted(compare.all_counts(s).collect()) == sorted(compare.shared_counts(s, s).collect())


def test_nearest_without_a_shuffle_of_pairs(spark, monkeypatch):
    """A code of 1000 genomes is sent once a bucket, not as a million pairs; ranks, ties and counts are those of all pairs."""
    import pyarrow as pa

    monkeypatch.setattr(compare, "ROWS", 300)
    gids = np.r_[np.arange(1000), np.arange(1000, 1004)]
    batch = pa.RecordBatch.from_arrays([pa.array(gids), pa.array(np.r_[np.full(1000, 7), 8, 8, 9, 10]), pa.array(np.full(1004, 3))], ["gid", "code", "n"])
    got = [r for b in compare._posting_lists(4)(iter([batch.slice(k, 90) for k in range(0, 1004, 90)])) for r in b.to_pylist()]
    assert sorted(x for r in got for x in compare._unplaned(r["qid"], np.int64)) == list(range(1002))
    assert sum(len(r["rid"]) // 8 for r in got) <= 4 * 1002
    monkeypatch.undo()
    rng = np.random.default_rng(5)
    rows = {(int(g) - 20, int(c)) for g, c in zip(rng.integers(0, 80, 700), rng.integers(0, 90, 700), strict=True)} | {(g, 1000) for g in range(50)} | {(10**12 + g, c) for g in range(9) for c in (2000, 2001)} | {(500, 3000)}
    s = spark.createDataFrame(sorted(rows), "gid long, code long")
    want = compare.nearest(compare.distances(compare.with_sizes(compare.shared_counts(s, s).where("qid <> rid"), s, s)), 5).select("qid", "rid", "shared", "rank", "raw")
    want, got = sorted(want.collect()), sorted(compare.nearest_of(s, 5).collect())
    assert got == want and len(got) > 400


def test_distance_table_shuffles_each_pair_once(spark, tmp_path, monkeypatch):
    """The table's pairs are counted before their only shuffle, its text is compressed, and its lines are those of all pairs."""
    rng = np.random.default_rng(7)
    rows = [(int(g), int(c)) for g, c in zip(rng.integers(0, 30, 900), rng.integers(0, 50, 900), strict=True)] * 2 + [(g, 100) for g in range(40)] + [(None, 1), (1, None), (50, None), (60, 200)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found, paths, counted = [], [], []
    write, count = store.write_distance_table, compare.pair_counts
    monkeypatch.setattr(store, "write_distance_table", lambda f, path, *a, **b: (found.append(f), paths.append(path), write(f, path, *a, **b)))
    monkeypatch.setattr(compare, "pair_counts", lambda s: counted.append(count(s)) or counted[-1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(r.line for r in roundtrips.distance_table(spark, str(tmp_path)).collect())
        plans = [x._jdf.queryExecution().executedPlan().toString().splitlines() for x in (*counted, found[0])]
        dealt = [x for plan in plans for x in plan if "Exchange hashpartitioning" in x and ("qid" in x or "rid" in x)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    b = spark.read.parquet(f"{tmp_path}/lineitem.parquet").selectExpr("l_suppkey AS gid", "l_partkey AS code").distinct()
    pairs = compare.with_sizes(compare.shared_counts(b, b, ordered=True), b, b)
    want = compare.lines(compare.distances(pairs).withColumn("qry", F.col("qid")).withColumn("ref", F.col("rid")), 0)
    assert got == sorted([compare.heading("jaccard", 0), *(r.line for r in want.collect())]) and len(got) == 1 + 40 * 39 // 2
    assert len(dealt) == 1
    path, fs = fastx._hadoop(spark, paths[0])
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    assert names and all(x.endswith(".gz") for x in names if x.startswith("part-"))


def test_far_numbers_of_distance_lines(spark):
    far = [float("nan"), float("inf"), float("-inf"), 0.5]
    p = spark.createDataFrame([("q", str(k), 3, 5, 6, x, 2.9, x, x, x) for k, x in enumerate(far)], "qry string, ref string, shared long, qry_s long, ref_s long, metric double, rs double, dist double, p_value double, fdr double")
    got = [r.line.split("\t")[2:] for r in compare.lines(p, 1).orderBy("ref").collect()]
    assert got == [["3-2|6|5", x, x, y, y] for x, y in (("nan", "nan"), ("inf", "inf"), ("-inf", "-inf"), ("0.500000", "5.000000E-01"))]


def test_distance_lines_round_as_c(spark):
    """Near a tie the exact binary value decides: 0.0140625 is below it, 0.0109375 above, k / 128 on it."""
    numbers = [18 / 1280, 14 / 1280, 1 / 128, 3 / 128, -0.0140625, -1e-9, 0.0, 1.0, 2.5e-6, 123456.5e-9, 1.2345675e-5, 9.9999995e-7, 1e-200, 3e5]
    rows = [("q", f"{k:02}", 1, 2, 3, 0.0, *[x] * 8) for k, x in enumerate(numbers)]
    columns = "qry string, ref string, shared long, ref_s long, qry_s long, rs double, metric double, dist double, p_value double, fdr double, m_lo double, m_hi double, d_lo double, d_hi double"
    got = [r.line for r in compare.lines(spark.createDataFrame(rows, columns), 2).orderBy("ref").collect()]
    assert got == ["q\t%02d\t1-0|2|3\t%.6f\t%.6f\t%E\t%E\t[%.6f,%.6f]\t[%.6f,%.6f]" % (k, *[x] * 8) for k, x in enumerate(numbers)]


def test_erfc(spark):
    z = spark.createDataFrame([(x / 7,) for x in range(180)] + [(float("inf"),)], "z double")
    for r in compare.with_erfc(z, "e", F.col("z")).collect():
        assert math.isclose(r.e, math.erfc(r.z), rel_tol=1e-11, abs_tol=1e-300)


def test_fastq_of_many_blocks(spark, tmp_path):
    n = 3000
    (tmp_path / "big.fq").write_text("".join(f"@r{k}\n{'ACGT'[k % 4] * (k % 50 + 1)}\n+\n{'I' * (k % 50 + 1)}\n" for k in range(n)))
    from kmerframe.sources import fastx

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted((r.record_no, r.header, r.seq) for r in fastx.read_fastq(spark, [str(tmp_path / "big.fq")]).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, f"r{k}", "ACGT"[k % 4] * (k % 50 + 1)) for k in range(n)]
