"""The command line, against the same results by the operators or by hand."""

import random

import pytest
from pyspark.sql import functions as F

from kmerframe.plans import commands
from kmerframe.sources import fastx, shuf, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def genomes(tmp_path_factory):
    """Four genomes; b is a with its second half replaced; x of two folders bear one name."""
    t, rng = tmp_path_factory.mktemp("g"), random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, c = dna(20000), dna(20000)
    texts = {"a.fa": a, "b.fa": a[:10000] + dna(10000), "one/x.fa": c, "two/x.fa": dna(20000)}
    for name, text in texts.items():
        (t / name).parent.mkdir(exist_ok=True)
        (t / name).write_text(f">r {name}\n" + "\n".join(text[i : i + 70] for i in range(0, len(text), 70)) + "\n")
    deep = [c[i : i + 150] for i in range(0, 19800, 25)]
    (t / "s.fq").write_text("".join(f"@r{k}\n{r}\n+\n{'I' * len(r)}\n" for k, r in enumerate(deep)))
    return t


def test_files_of_one_name_stay_apart(spark, genomes):
    d = fastx.read_any(spark, [f"{genomes}/one/x.fa", f"{genomes}/two/x.fa"])
    got = rows(d.select("gid", F.element_at(F.split("path", "/"), -2)))
    assert got == [(0, "one"), (1, "two")]


def test_dist_set_and_reverse(spark, genomes):
    o = f"{genomes}/out"
    run = lambda *x: commands.main([str(v) for v in x], spark)
    run("shuffle", "-k", 8, "-s", 4, "-l", 1, "-o", f"{o}.p")
    assert shuf.read_shuf(f"{o}.p.shuf")[0]["subk"] == 4
    run("dist", "-L", f"{o}.p.shuf", "-o", f"{o}/s", f"{genomes}/a.fa", f"{genomes}/b.fa", f"{genomes}/one/x.fa")
    s, names, meta = store.read(spark, f"{o}/s")
    assert meta["shuf_id"].startswith("shuf-") and meta["counts"] is False
    by = {}
    for g, c in rows(s.select("gid", "code")):
        by.setdefault(g, set()).add(c)

    run("dist", "-L", f"{o}.p.shuf", "--keepskf", "-O", 2, "-r", f"{o}/s", "-o", f"{o}/d", f"{o}/s")
    d = spark.read.option("sep", "\t").option("header", True).csv(f"{o}/d/distance")
    assert {"p_value", "fdr", "m_lo", "d_hi"} <= set(d.columns)
    got = {(r.qry, r.ref): int(r.shared) for r in d.collect()}
    name = {r.gid: r.name for r in names.collect()}
    assert got == {(name[x], name[y]): len(by[x] & by[y]) for x in by for y in by if by[x] & by[y]}
    run("dist", "-f", f"{o}/d/shared_counts", "--all-pairs", "-O", 0, "-r", f"{o}/s", "-o", f"{o}/e", f"{o}/s")
    e = spark.read.option("sep", "\t").option("header", True).csv(f"{o}/e/distance")
    assert e.count() == 9 and "p_value" not in e.columns

    run("set", "-u", "-o", f"{o}/u", f"{o}/s")
    run("set", "-q", "-o", f"{o}/q", f"{o}/s")
    assert {r[1] for r in rows(store.read(spark, f"{o}/u")[0].select("gid", "code"))} == set().union(*by.values())
    only = {c for g in by for c in by[g] if sum(c in v for v in by.values()) == 1}
    assert {r[1] for r in rows(store.read(spark, f"{o}/q")[0].select("gid", "code"))} == only
    run("set", "-s", f"{o}/q", "-o", f"{o}/m", f"{o}/s")
    run("set", "-i", f"{o}/q", "-o", f"{o}/i", f"{o}/s")
    want = sorted((g, c) for g in by for c in by[g])
    parts = [rows(store.read(spark, f"{o}/{x}")[0].select("gid", "code")) for x in "mi"]
    assert sorted(parts[0] + parts[1]) == want and parts[1] == sorted((g, c) for g in by for c in by[g] & only)

    (genomes / "groups").write_text("7 first\n7 first\n0\n")
    run("set", "-g", genomes / "groups", "-o", f"{o}/g", f"{o}/s")
    g, gn, _ = store.read(spark, f"{o}/g")
    assert rows(g.select("gid", "code")) == sorted((7, c) for c in by[0] | by[1])
    assert rows(gn.select("gid", "name")) == [(7, "7_first")]
    assert [r.name for r in run("set", "-P", f"{o}/s").collect()] == ["a.fa", "b.fa", "x.fa"]
    run("set", "-c", "-o", f"{o}/c", f"{o}/u", f"{o}/q")
    assert rows(store.read(spark, f"{o}/c")[1].select("name")) == [("q",), ("u",)]
    run("dist", "-o", f"{o}/two", f"{o}/s", f"{o}/u")
    assert rows(store.read(spark, f"{o}/two")[1].select("gid")) == [(0,), (1,), (2,), (3,)]

    run("reverse", "-L", f"{o}.p.shuf", "-o", f"{o}/k", f"{o}/s")
    back = spark.read.text(f"{o}/k")
    assert back.count() == len(want)
    text = "".join((genomes / "a.fa").read_text().split("\n")[1:])
    turn = str.maketrans("ACGT", "TGCA")
    mine = [r.value for r in back.where("genome = 'a.fa'").limit(50).collect()]
    assert mine and all(k in text or k.translate(turn)[::-1] in text for k in mine)
    with pytest.raises(ValueError, match="permutation"):
        run("reverse", "-L", "1", "-o", f"{o}/bad", f"{o}/s")


def test_composite(spark, genomes):
    o = f"{genomes}/comp"
    run = lambda *x: commands.main([str(v) for v in x], spark)
    run("dist", "-L", 1, "-o", f"{o}/ref", f"{genomes}/one/x.fa", f"{genomes}/a.fa")
    run("dist", "-L", 1, "-A", "-o", f"{o}/smp", f"{genomes}/s.fq")
    got = run("composite", "-r", f"{o}/ref", "-q", f"{o}/smp").collect()
    assert [(r.sample, r.ref, r.place) for r in got] == [("s.fq", "x.fa", 1)]
    run("composite", "-b", "-r", f"{o}/ref", "-q", f"{o}/smp")
    run("composite", "-i", "-r", f"{o}/ref")
    vec = run("composite", "-d", f"{o}/ref/abundance_Vec").collect()
    assert [(r.sample, r.ref, round(r.pct, 9)) for r in vec] == [("s.fq", "x.fa", 100.0)]
    for k, want in ((0, 1.0), (1, 0.0), (2, 0.0)):
        found = run("composite", "-s", k, "-r", f"{o}/ref", f"{o}/ref/abundance_Vec").collect()
        assert [round(r.score, 9) for r in found] == [want]
    with pytest.raises(ValueError, match="counts"):
        run("composite", "-r", f"{o}/ref", "-q", f"{o}/ref")


def test_profile(spark, tmp_path):
    cov = [("s 1", "p1_a", 30, 8.0, 9.0, 8, 9), ("s 1", "p2_b", 30, 5.0, 6.0, 5, 6), ("s 1", "p3_c", 3, 9.0, 9.0, 9, 9)]
    store.write_distances(spark.createDataFrame(cov, "sample string, ref string, shared long, avg double, avgpct9899 double, median long, max long"), f"{tmp_path}/cov")
    (tmp_path / "psid").write_text("p1\t20\np2\t21\np3\t21\n")
    (tmp_path / "nodes").write_text("10\tsuperkingdom\t1\tB\n15\tclade\t10\tc\n20\tspecies\t15\ts\n21\tspecies\t15\tt\n")
    for model, want in (("poisson", ["66.6667", "33.3333"]), ("two-tier", ["66.6667", "33.3333"]), ("deviation", ["66.6667", "33.3333"])):
        commands.main(["profile", "-t", f"{tmp_path}/psid", "-n", f"{tmp_path}/nodes", "-m", model, "-S", "18", "-o", f"{tmp_path}/{model}", f"{tmp_path}/cov"], spark)
        lines = [r.value for r in spark.read.text(f"{tmp_path}/{model}/s_1.profile").collect()]
        assert len(lines) == 10 and lines[1] == "@SampleID:s_1" and lines[7].startswith("10\tsuperkingdom\t10\tB\t100.0000")
        assert [x.split("\t")[4] for x in lines[8:]] == want and lines[8].startswith("20\tspecies\t10|20\tB|s\t")


def test_dist_table_and_byread(spark, genomes):
    o = f"{genomes}/table"
    run = lambda *x: commands.main([str(v) for v in x], spark)
    run("shuffle", "--usedefault", "-o", f"{o}.d")
    assert shuf.read_shuf(f"{o}.d.shuf")[0] == {"shuf_id": 1, "k": 8, "subk": 5, "level": 2}
    run("dist", "-L", 1, "-o", f"{o}/s", f"{genomes}/a.fa", f"{genomes}/b.fa")
    run("dist", "-L", 1, "--table", "-r", f"{o}/s", "-o", f"{o}/t", f"{o}/s")
    lines = [r.value.split("\t") for r in spark.read.text(f"{o}/t/distance").collect()]
    head = next(x for x in lines if x[0] == "Qry")
    assert head == ["Qry", "Ref", "Shared_k|Ref_s|Qry_s", "Jaccard", "MashD", "P-value(J)", "FDR(J)", "Jaccard_CI", "MashD_CI"]
    same = next(x for x in lines if x[:2] == ["a.fa", "a.fa"])
    assert len(lines) == 5 and same[3:5] == ["1.000000", "0.000000"] and same[5] == "0.000000E+00"
    run("dist", "-L", 1, "--byread", "-o", f"{o}/r", f"{genomes}/a.fa")
    run("reverse", "--byread", "-L", 1, "-o", f"{o}/k", f"{o}/r")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{o}/k")
    assert back.count() == spark.read.parquet(f"{o}/r").count() > 0
