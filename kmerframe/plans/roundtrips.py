"""Registered queries of sources, sinks and whole commands: what is written to the shared folder and read
again must be what SQL finds in the tables. Imported after the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, coverage, decode, profile, setops, sketch
from ..sources import fastx, shuf, store
from . import commands
from .catalogue import _DOCS, _JAC, _PAIRS, _POISSON, _PVALUE, _SK, _STATS, P, _occ, basket, query, r6, table, txt, txt_sketch, vectors
from .catalogue import _ABV as ABV
from .session import fresh, written

_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_BASES = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _bases(column: str):
    return F.translate(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _fasta(spark, d, codec: str | None = None) -> str:
    """Documents as FASTA files, 60 bases a line."""
    path = fresh(spark, "fasta")
    folded = F.regexp_replace(_bases("text"), "(.{60})", "$1\n")
    lines = table(spark, d, "documents").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("-")), F.lit("\n"), folded).alias("value"))
    w = lines.write
    (w.option("compression", codec) if codec else w).text(path)
    return path


def _fastq(spark, d) -> str:
    """Turns of conversations as FASTQ files; a base's quality follows from its place."""
    path = fresh(spark, "fastq")
    q = F.expr("if(length(seq) = 0, '', array_join(transform(sequence(1, length(seq)), p -> char(33 + pmod(p * 7 + turn, 41))), ''))")
    rows = table(spark, d, "conversations").select("conv_id", "turn", _bases("text").alias("seq"))
    rows.select(F.concat(F.lit("@"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), q).alias("value")).write.text(path)
    return path


def _records(found):
    seq = F.regexp_replace("seq", "\n", "")
    return found.select(F.split("header", " ")[0].cast("long").alias("gid"), F.split("header", " ")[1].alias("name"), F.length(seq).cast("long").alias("bases"), F.md5(seq).alias("digest"))


_RECORDS = f"SELECT doc_id AS gid, coalesce(source, '-') AS name, length({_BASES}) AS bases, md5({_BASES}) AS digest FROM documents"


@query(_RECORDS)
def source_fasta(spark, d):
    return _records(fastx.read_fasta(spark, [_fasta(spark, d)]))


@query(_RECORDS)
def source_fasta_gz(spark, d):
    return _records(fastx.read_fasta(spark, [_fasta(spark, d, "gzip")]))


@query(_RECORDS)
def source_fasta_bz2(spark, d):
    return _records(fastx.read_fasta(spark, [_fasta(spark, d, "bzip2")]))


_TURNS = f"SELECT conv_id || '/' || turn AS header, {_BASES} AS seq FROM conversations"


@query(f"WITH s AS ({_TURNS}) SELECT header, length(seq) AS bases, md5(seq) AS digest FROM s")
def source_fastq(spark, d):
    return fastx.read_fastq(spark, [_fastq(spark, d)]).select("header", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


def _three(spark, d) -> str:
    """A folder of three FASTA files."""
    top = fresh(spark, "folder")
    docs = table(spark, d, "documents")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\nACGT")).alias("value")).coalesce(1).write.text(f"{top}.parts/{k}")
        p, fs = fastx._hadoop(spark, f"{top}.parts/{k}")
        part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
        fs.mkdirs(fastx._hadoop(spark, top)[0])
        fs.rename(part, fastx._hadoop(spark, f"{top}/{k}.fa")[0])
    return top


_THREE = "SELECT doc_id % 3 AS gid, count(*) AS records FROM documents GROUP BY 1"


@query(_THREE)
def source_list(spark, d):
    """A list file names the files by their places; each is a genome."""
    top = _three(spark, d)
    spark.createDataFrame([(f" {top}/{k}.fa ",) for k in range(3)] + [("",)], "value string").coalesce(1).write.text(f"{top}.list")
    files = fastx.read_any(spark, fastx.read_list(spark, f"{top}.list"), records=True)
    return files.groupBy("gid").agg(F.count(F.lit(1)).alias("records"))


@query(_THREE)
def source_dir(spark, d):
    """A folder stands for the sequence files in it, by name."""
    files = fastx.read_any(spark, fastx.expand(spark, [_three(spark, d)]), records=True)
    return files.groupBy("gid").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT dim, row_number() OVER (ORDER BY md5('seed42:' || dim), dim) - 1 AS rank FROM range(65536) t(dim)")
def shuf_file(spark, d):
    """A permutation file written and read, whole."""
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(prefix="kmerframe-"), "p.shuf")  # read by the driver, where it was written
    shuf.write_shuf(path, P)
    ranks = shuf.read_shuf(path)[1]
    return spark.createDataFrame(list(enumerate(ranks.tolist())), "dim long, rank long")


def _names(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("gid"), F.coalesce("source", F.lit("-")).alias("name"))


def _store(spark, d, s) -> str:
    path = fresh(spark, "store")
    store.write(s, _names(spark, d), P, path)
    return path


@query(f"{_SK} SELECT gid, code FROM sk")
def store_codes(spark, d):
    return store.read(spark, _store(spark, d, txt_sketch(spark, d)))[0].select("gid", "code")


@query(f"{_SK} SELECT gid, code FROM k WHERE cnt >= 3")
def store_min_occ(spark, d):
    return store.read(spark, _store(spark, d, sketch.min_occurrence(txt(spark, d), P, 3, "letters")))[0].select("gid", "code")


@query(f"{_SK} SELECT gid, code, least(cnt, 65535) AS cnt FROM k")
def store_counts(spark, d):
    return store.read(spark, _store(spark, d, sketch.counted(txt(spark, d), P, "letters")))[0].select("gid", "code", "cnt")


@query(f"{_SK} SELECT doc_id AS gid, coalesce(source, '-') AS name, count(code) AS n_codes, 'seed42' AS shuf_id, false AS counts, 8 AS k, 4 AS subk, 1 AS level FROM documents LEFT JOIN sk ON gid = doc_id GROUP BY doc_id, source")
def store_meta(spark, d):
    _, names, meta = store.read(spark, _store(spark, d, txt_sketch(spark, d)))
    return names.select("gid", "name", F.col("n_codes").cast("long").alias("n_codes"), *(F.lit(meta[c]).alias(c) for c in ("shuf_id", "counts", "k", "subk", "level")))


@query(f"{_PAIRS} SELECT qid, rid, shared, round({_JAC}, 6) AS metric FROM q")
def shared_counts_kept(spark, d):
    """Shared counts written, then read for the distances."""
    b = basket(spark, d)
    kept = written(compare.shared_counts(b, b, ordered=True), "shared")
    return compare.distances(compare.with_sizes(kept, b, b)).select("qid", "rid", "shared", r6("metric").alias("metric"))


@query(f"{_SK} SELECT DISTINCT coalesce(source, '-') AS genome, o.km AS kmer, count(DISTINCT gid) AS genomes FROM o JOIN documents ON gid = doc_id WHERE o.code <> 0 GROUP BY 1, 2")
def kmer_text(spark, d):
    path = fresh(spark, "kmers")
    store.write_kmers(decode.decode(txt_sketch(spark, d), P), _names(spark, d), path)
    return spark.read.text(path).groupBy(F.col("genome").cast("string").alias("genome"), F.col("value").alias("kmer")).agg(F.count(F.lit(1)).alias("genomes"))


@query(f"WITH {_occ('SELECT conv_id AS gid, turn AS read_no, text AS seq FROM conversations', 'gid, read_no')} SELECT gid, read_no, km AS kmer, count(*) AS n FROM o GROUP BY ALL")
def decode_by_read(spark, d):
    reads = table(spark, d, "conversations").select(F.col("conv_id").alias("gid"), F.col("turn").alias("read_no"), F.col("text").alias("seq"))
    path = fresh(spark, "reads")
    sketch.by_read(reads, P, "letters").write.parquet(path)
    return decode.decode_reads(spark.read.parquet(path), P).groupBy("gid", "read_no", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SK} SELECT (code % 4)::BIGINT AS component, code >> 2 AS inner_code, count(*) AS n FROM sk GROUP BY ALL")
def sketch_components(spark, d):
    part, inner = sketch.component(F.col("code"), 4)
    return txt_sketch(spark, d).groupBy(part.alias("component"), inner.alias("inner_code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_partkey AS code FROM lineitem")
def set_union_single(spark, d):
    """The union of a single sketch is its codes."""
    return setops.union(table(spark, d, "lineitem").select(F.lit(0).cast("long").alias("gid"), F.col("l_partkey").alias("code")).distinct())


_TEXTS = "(qid || chr(9) || rid || chr(9) || shared || '-0|' || ref_s || '|' || qry_s || chr(9) || printf('%.6f', m) || chr(9) || printf('%.6f', least(ln(1 / (2 * m) + 0.5) / 16, 1)))"


@query(f"{_PAIRS}, t AS (SELECT *, {_JAC} AS m FROM q) SELECT {_TEXTS} AS line FROM t UNION ALL SELECT 'Qry' || chr(9) || 'Ref' || chr(9) || 'Shared_k|Ref_s|Qry_s' || chr(9) || 'Jaccard' || chr(9) || 'MashD'")
def distance_table(spark, d):
    """The distance table as text, heading included, at the lowest level of output."""
    path = fresh(spark, "distances")
    b = written(basket(spark, d), "basket")
    found = compare.distances(compare.sized_pairs(b)).withColumn("qry", F.col("qid")).withColumn("ref", F.col("rid"))
    store.write_distance_table(found, path, "jaccard", 0, **_GZIP)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    f"{_PVALUE}, g AS (SELECT e.*, q.shared, q.qry_s, q.ref_s, sqrt(m * (1 - m) / (qry_s + ref_s - shared)) AS sd FROM e JOIN q USING (qid, rid)) SELECT qid, rid, round(m, 6) AS metric, round(p, 6) AS p_value, round(m - 1.96 * sd, 6) AS m_lo, round(m + 1.96 * sd, 6) AS m_hi FROM g"
)
def dist_levels(spark, d):
    """All output levels together, as the command compares two stores."""
    b = written(basket(spark, d), "basket")
    names = written(setops.genome_names(b, b.select("gid", F.col("gid").cast("string").alias("name")).distinct()), "names")
    opened = (b, names, {"shuf_id": "x", "k": 8, "subk": 4, "level": 1})
    found = commands.compared(opened, opened, level=2).select(F.col("qry").cast("long").alias("qid"), F.col("ref").cast("long").alias("rid"), *(r6(c).alias(c) for c in ("metric", "p_value", "m_lo", "m_hi")))
    return found.where("qid < rid")


@query(f"{ABV} SELECT sample, ref, round(pct, 6) AS pct FROM abv")
def abv_written(spark, d):
    return written(vectors(spark, d), "abv").select("sample", "ref", r6("pct").alias("pct"))


@query(f"{ABV}, v AS (SELECT abv.sample, ref, pct, l2, dims FROM abv JOIN nrm USING (sample)) SELECT ref, sample, round(pct, 6) AS pct, round(l2, 6) AS l2, dims FROM v")
def abv_index(spark, d):
    """The index by reference, each posting with its vector's norm."""
    path = fresh(spark, "index")
    coverage.index(vectors(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select("ref", "sample", r6("pct").alias("pct"), r6("l2").alias("l2"), "dims")


@query(
    f"{ABV}, s AS (SELECT a.sample AS qid, b.sample AS sample, round(sum(a.pct * b.pct) / (any_value(n.l2) * any_value(o.l2)), 6) AS score FROM abv a JOIN abv b USING (ref) JOIN nrm n ON n.sample = a.sample JOIN nrm o ON o.sample = b.sample WHERE a.sample % 20 = 0 GROUP BY 1, 2) SELECT qid, sample, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sample) AS place FROM s"
)
def abv_search_order(spark, d):
    v = vectors(spark, d)
    found = coverage.search(v.where("sample % 20 = 0"), v, "cosine").withColumn("score", r6("score"))
    return coverage.ranked(found, "cosine").select("qid", "sample", F.col("place").cast("long").alias("place"))


# --- a tree of five levels, one of which has no rank ----------------------------------------------

_DEEP = """t AS (SELECT n_nationkey + 100 AS node, 'species' AS rank, 60 + 2 * n_regionkey + n_nationkey % 2 AS parent, n_name AS name, n_regionkey AS r FROM nation
UNION ALL SELECT 60 + 2 * r_regionkey + x, 'genus', 40 + r_regionkey, 'g' || x || r_name, r_regionkey FROM region, range(2) y(x)
UNION ALL SELECT 40 + r_regionkey, 'clade', 20 + r_regionkey, 'c' || r_name, r_regionkey FROM region
UNION ALL SELECT 20 + r_regionkey, 'phylum', 10 + r_regionkey, 'p' || r_name, r_regionkey FROM region
UNION ALL SELECT 10 + r_regionkey, 'superkingdom', 1, r_name, r_regionkey FROM region)"""
_UP = """u AS (SELECT sample, x.node::BIGINT AS node, sum(pct) AS pct FROM (SELECT sample, unnest([l.node, s.parent, 40 + s.r, 20 + s.r, 10 + s.r]) AS node, pct FROM l JOIN t s ON s.node = l.node) x GROUP BY 1, 2),
k AS (SELECT node, rank, CASE rank WHEN 'superkingdom' THEN [node] WHEN 'phylum' THEN [10 + r, node] WHEN 'genus' THEN [10 + r, 20 + r, node] ELSE [10 + r, 20 + r, parent, node] END AS path FROM t WHERE rank <> 'clade'),
w AS (SELECT node, rank, array_to_string(path, '|') AS taxpath, (SELECT string_agg(b.name, '|' ORDER BY i) FROM (SELECT unnest(path) AS q, unnest(range(len(path))) AS i) z JOIN t b ON b.node = q) AS taxpathsn FROM k),
prof AS (SELECT sample, u.node AS taxid, rank, taxpath, taxpathsn, printf('%.4f', pct) AS percentage FROM u JOIN w ON w.node = u.node)"""
_LEAVES = "l AS (SELECT c_mktsegment AS sample, c_nationkey + 100 AS node, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS pct FROM customer GROUP BY 1, 2)"


def _deep(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    node = lambda k, rank, up, name, of: of.select(k.cast("long").alias("node"), F.lit(rank).alias("rank"), up.cast("long").alias("parent"), name.alias("name"))
    region, title = F.col("r_regionkey"), F.col("r_name")
    out = node(F.col("n_nationkey") + 100, "species", 60 + 2 * F.col("n_regionkey") + F.col("n_nationkey") % 2, F.col("n_name"), n)
    for x in (0, 1):
        out = out.union(node(60 + 2 * region + x, "genus", 40 + region, F.concat(F.lit(f"g{x}"), title), r))
    out = out.union(node(40 + region, "clade", 20 + region, F.concat(F.lit("c"), title), r)).union(node(20 + region, "phylum", 10 + region, F.concat(F.lit("p"), title), r))
    return out.union(node(10 + region, "superkingdom", F.lit(1), title, r))


def _deep_profile(spark, d):
    from .catalogue import _leaves

    nodes = _deep(spark, d)
    up = profile.ancestors(nodes)
    return profile.cami(profile.rollup(_leaves(spark, d), nodes, up), nodes, up)


@query(f"WITH {_DEEP}, {_LEAVES}, {_UP} SELECT * FROM prof")
def cami_profile_deep(spark, d):
    return _deep_profile(spark, d)


@query(
    f"WITH {_DEEP}, {_LEAVES}, {_UP} SELECT sample, taxid, row_number() OVER (PARTITION BY sample ORDER BY list_position(['superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species'], rank), percentage::DOUBLE DESC, taxid) AS place FROM prof"
)
def cami_order(spark, d):
    return profile.by_rank(_deep_profile(spark, d)).select("sample", "taxid", F.col("place").cast("long").alias("place"))


_PSID = f"""WITH m AS (SELECT 'B' || substr(p_brand, 7) || '_' || p_brand AS ref, p_partkey AS code FROM part), y AS (SELECT 'y#' || year(l_shipdate) AS sample, l_partkey AS code, count(*) AS cnt FROM lineitem GROUP BY 1, 2), {_STATS}, {_DEEP},
x AS (SELECT 'y_' || substr(sample, 3) AS sample, 100 + regexp_extract(ref, '^B([0-9]+)_', 1)::INT % 25 AS node, {_POISSON} AS depth FROM cov WHERE shared > 18),
l AS (SELECT sample, node, 100 * sum(depth) / sum(sum(depth)) OVER (PARTITION BY sample) AS pct FROM x GROUP BY 1, 2)"""


def _yearly_psid(spark, d):
    m = table(spark, d, "part").select(F.concat(F.lit("B"), F.substring("p_brand", 7, 9), F.lit("_"), "p_brand").alias("ref"), F.col("p_partkey").alias("code"))
    s = table(spark, d, "lineitem").groupBy(F.concat(F.lit("y#"), F.year("l_shipdate").cast("string")).alias("sample"), F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    psids = table(spark, d, "part").select(F.concat(F.lit("B"), F.substring("p_brand", 7, 9)).alias("psid"), (F.substring("p_brand", 7, 2).cast("long") % 25 + 100).alias("node")).distinct()
    return coverage.coverage(m, s), psids


@query(f"{_PSID} SELECT sample, node::BIGINT AS node, round(pct, 6) AS pct FROM l")
def profile_species(spark, d):
    cov, psids = _yearly_psid(spark, d)
    return profile.species(cov, psids, profile.poisson_depth(F.col("avgpct9899")), 18).select("sample", "node", r6("pct").alias("pct"))


@query(f"{_PSID}, {_UP} SELECT * FROM prof")
def profile_taxonomy(spark, d):
    """Coverage, psids, species, roll-up and paths in one."""
    cov, psids = _yearly_psid(spark, d)
    return profile.taxonomy(cov, psids, _deep(spark, d), profile.poisson_depth(F.col("avgpct9899")), 18)
