"""Registered queries of the sketch engine and the SQL that checks them.

Driver tables become sketches by these adapters: TXT maps the letters of documents cyclically to
bases; BASKET takes suppliers as genomes and parts as codes; COVER takes brands as references,
parts as markers and suppliers as samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, coverage, decode, lookups, profile, setops, sketch
from .params import SketchParams
from .session import written

P = SketchParams(k=8, subk=4, level=1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# --- adapters -------------------------------------------------------------------------------------


def txt(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("gid"), F.col("text").alias("seq"))


def txt_sketch(spark, d):
    return sketch.codes(txt(spark, d), P, "letters")


def english(spark, d):
    en = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("gid"), F.col("text").alias("seq"))
    return setops.union(sketch.codes(en, P, "letters"))


def basket(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gid"), F.col("l_partkey").alias("code")).distinct()


def groups(spark, d):
    low = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("gid")).distinct().withColumn("low", F.lit(True))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("gid"), "lang")
    tax = F.when(F.col("low"), 0).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), F.col("lang")), F.lit(0))).cast("int")
    return docs.join(low, "gid", "left").select("gid", tax.alias("taxid"), F.when(tax == 0, None).otherwise(F.col("lang")).alias("taxname"))


def cover_markers(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("ref"), F.col("p_partkey").alias("code"))


def cover_sample(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("code")).agg(F.sum("l_quantity").alias("q"))
    return n.select("sample", "code", F.least(F.col("q"), F.lit(65535.0)).cast("long").alias("cnt"))


def yearly(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("sample"), F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    return coverage.coverage(cover_markers(spark, d), n)


def vectors(spark, d):
    return coverage.abundance(coverage.coverage(cover_markers(spark, d), cover_sample(spark, d)))


_LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'"


def _kmers(source: str, keys: str) -> str:
    """CTEs up to n (keys, u): canonical k-mers of source (keys, seq)."""
    return f"""s AS ({source}),
t AS (SELECT {keys}, translate(regexp_replace(lower(coalesce(seq, '')), '[ \\n]', '', 'g'), {_LETTERS}) AS seq FROM s),
r AS (SELECT {keys}, unnest(regexp_extract_all(seq, '[ACGT]{{16,}}')) AS run FROM t),
w AS (SELECT {keys}, substr(run, i, 16) AS km FROM (SELECT {keys}, run, unnest(range(1, length(run) - 14)) AS i FROM r)),
c AS (SELECT {keys}, least(km, reverse(translate(km, 'ACGT', 'TGCA'))) AS km FROM w),
n AS (SELECT {keys}, km, list_reduce([x::BIGINT for x in string_split(translate(km, 'ACGT', '0123'), '')], lambda a, b: a * 4 + b) AS u FROM c)"""


_SHUF = "shuf AS (SELECT dim, pf FROM (SELECT dim, row_number() OVER (ORDER BY md5('seed42:' || dim), dim) - 1 AS pf FROM range(65536) x(dim)) WHERE pf < 4096)"
_CODE = "((((((u >> 24) & 255) << 8) | (u & 255)) << 16) >> 4) + pf"
_DOCS = "SELECT doc_id AS gid, text AS seq FROM documents"


def _occ(source: str = _DOCS, keys: str = "gid") -> str:
    return f"{_kmers(source, keys)}, {_SHUF}, o AS (SELECT {keys}, n.km, {_CODE} AS code FROM n JOIN shuf ON dim = ((u >> 8) & 65535))"


_SK = f"WITH {_occ()}, k AS (SELECT gid, code, count(*) AS cnt FROM o GROUP BY gid, code), sk AS (SELECT gid, code FROM k WHERE code <> 0)"
_PAN = f", pan AS (SELECT DISTINCT code FROM sk JOIN documents ON doc_id = gid WHERE lang = 'en')"
_GROUPS = """, g AS (SELECT doc_id AS gid, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0 ELSE coalesce(list_position(['en', 'de', 'fr', 'es'], lang), 0) END AS taxid, lang FROM documents),
pans AS (SELECT DISTINCT taxid::INT AS taxid, taxid || '_' || lang AS name, code FROM sk JOIN g USING (gid) WHERE taxid <> 0)"""


# --- sketches -------------------------------------------------------------------------------------


@query(f"WITH {_kmers(_DOCS, 'gid')}, d AS (SELECT gid, u, count(*) AS c FROM n GROUP BY gid, u) SELECT gid, sum(c)::BIGINT AS n_kmers, count(*) AS n_distinct, sum(u)::BIGINT AS sum_u FROM d GROUP BY gid")
def kmer_canonical(spark, d):
    k = sketch.kmers(txt(spark, d), P, "letters")
    return k.groupBy("gid").agg(F.sum("cnt").alias("n_kmers"), F.count(F.lit(1)).alias("n_distinct"), F.sum("code").alias("sum_u"))


@query(f"{_SK} SELECT gid, code FROM sk")
def sketch_codes(spark, d):
    return txt_sketch(spark, d)


@query(f"{_SK} SELECT gid, code FROM k WHERE cnt >= 2")
def sketch_min_occ(spark, d):
    return sketch.min_occurrence(txt(spark, d), P, 2, "letters")


@query(f"{_SK} SELECT gid, code, least(cnt, 65535) AS cnt FROM k")
def sketch_abundance(spark, d):
    return sketch.counted(txt(spark, d), P, "letters")


@query(f"{_SK} SELECT gid, code FROM k WHERE cnt = 1 AND code <> 0")
def sketch_unique(spark, d):
    return sketch.unrepeated(txt(spark, d), P, "letters")


@query(f"WITH {_occ('SELECT conv_id AS gid, turn AS read_no, text AS seq FROM conversations', 'gid, read_no')} SELECT gid, read_no, code FROM o")
def sketch_by_read(spark, d):
    reads = table(spark, d, "conversations").select(F.col("conv_id").alias("gid"), F.col("turn").alias("read_no"), F.col("text").alias("seq"))
    return sketch.by_read(reads, P, "letters")


@query(
    "WITH "
    + _occ(
        "SELECT conv_id AS gid, turn AS read_no, array_to_string([CASE WHEN (conv_id * 31 + p * 17) % 41 = 0 THEN '-' ELSE x[p] END for p in range(1, length(x) + 1)], '') AS seq FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\\x01-\\x7F]', '.', 'g') AS x FROM conversations)",
        "gid, read_no",
    )
    + " SELECT gid, read_no, code FROM o"
)
def quality_mask(spark, d):
    reads = table(spark, d, "conversations").select(F.col("conv_id").alias("gid"), F.col("turn").alias("read_no"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7F]", ".").alias("seq"))
    qual = F.expr("if(length(seq) = 0, '', array_join(transform(sequence(1, length(seq)), p -> char(33 + pmod(gid * 31 + p * 17, 41))), ''))")
    return sketch.by_read(sketch.mask_quality(reads.withColumn("qual", qual), 34, "-"), P, "letters")


@query(f"{_SK} SELECT DISTINCT gid, o.code, o.km AS kmer FROM o WHERE o.code <> 0")
def decode_kmers(spark, d):
    return decode.decode(txt_sketch(spark, d), P).select("gid", "code", "kmer")


@query(f"WITH {_SHUF} SELECT dim, pf FROM shuf")
def shuffle_perm(spark, d):
    dims, ranks = P.permutation()
    return spark.createDataFrame(list(zip(dims.tolist(), ranks.tolist(), strict=True)), "dim long, pf long")


@query(f"{_SK} SELECT code, string_agg(gid::VARCHAR, ',' ORDER BY gid) AS gids FROM sk GROUP BY code")
def inverted_index(spark, d):
    return setops.inverted(txt_sketch(spark, d)).select("code", F.array_join(F.col("gids").cast("array<string>"), ",").alias("gids"))


@query(f"{_SK} SELECT doc_id AS gid, source AS name, count(code) AS n_codes FROM documents LEFT JOIN sk ON gid = doc_id GROUP BY doc_id, source")
def genome_names(spark, d):
    names = table(spark, d, "documents").select(F.col("doc_id").alias("gid"), F.col("source").alias("name"))
    return setops.genome_names(txt_sketch(spark, d), names)


# --- set algebra ----------------------------------------------------------------------------------


@query(f"{_SK} SELECT DISTINCT code FROM sk")
def set_union(spark, d):
    return setops.union(txt_sketch(spark, d))


@query(f"{_SK} SELECT code FROM sk GROUP BY code HAVING count(*) = 1")
def set_uniq_union(spark, d):
    return setops.unique_union(txt_sketch(spark, d))


@query("SELECT code FROM (SELECT DISTINCT l_partkey AS gid, l_orderkey AS code FROM lineitem) GROUP BY code HAVING count(*) = 1")
def set_uniq_union_basket(spark, d):
    return setops.unique_union(table(spark, d, "lineitem").select(F.col("l_partkey").alias("gid"), F.col("l_orderkey").alias("code")).distinct())


@query(f"{_SK}{_PAN} SELECT gid, code FROM sk WHERE code IN (SELECT code FROM pan)")
def set_intersect(spark, d):
    return setops.intersect(txt_sketch(spark, d), english(spark, d)).select("gid", "code")


@query(f"{_SK}{_PAN} SELECT gid, code FROM sk WHERE code NOT IN (SELECT code FROM pan)")
def set_subtract(spark, d):
    return setops.subtract(txt_sketch(spark, d), english(spark, d)).select("gid", "code")


@query(
    "WITH s AS (SELECT DISTINCT l_suppkey AS gid, l_partkey AS code FROM lineitem) SELECT gid, code FROM s WHERE gid % 2 = 0 UNION ALL SELECT gid + (SELECT max(gid) + 1 FROM s WHERE gid % 2 = 0), code FROM s WHERE gid % 2 = 1"
)
def set_combine(spark, d):
    b = basket(spark, d)
    return setops.combine([b.where("gid % 2 = 0"), b.where("gid % 2 = 1")])


@query(f"{_SK} SELECT DISTINCT (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::BIGINT AS gid, lang AS name, code FROM sk JOIN documents ON doc_id = gid WHERE lang IN ('de', 'en', 'es', 'fr')")
def set_combine_pans(spark, d):
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("gid"), "lang")
    s = txt_sketch(spark, d).join(lang, "gid")
    return setops.combine_pans([(x, setops.union(s.where(F.col("lang") == x))) for x in ("de", "en", "es", "fr")])


@query(f"{_SK}{_GROUPS} SELECT taxid, name, code FROM pans")
def group_pan(spark, d):
    return setops.group(txt_sketch(spark, d), groups(spark, d))


@query(f"{_SK}{_GROUPS} SELECT taxid, name, code FROM pans WHERE code IN (SELECT code FROM pans GROUP BY code HAVING count(*) = 1)")
def marker_db(spark, d):
    return setops.markers(txt_sketch(spark, d), groups(spark, d))


# --- comparison -----------------------------------------------------------------------------------

_PAIRS = """WITH s AS (SELECT DISTINCT l_suppkey AS gid, l_partkey AS code FROM lineitem), z AS (SELECT gid, count(*) AS n FROM s GROUP BY gid),
p AS (SELECT a.gid AS qid, b.gid AS rid, count(*) AS shared FROM s a JOIN s b USING (code) WHERE a.gid < b.gid GROUP BY 1, 2),
q AS (SELECT qid, rid, shared, x.n AS qry_s, y.n AS ref_s FROM p JOIN z x ON x.gid = qid JOIN z y ON y.gid = rid)"""
_JAC = "shared / (qry_s + ref_s - shared)"


def pairs(spark, d):
    b = basket(spark, d)
    return compare.with_sizes(compare.shared_counts(b, b, ordered=True), b, b)


@query(f"{_PAIRS} SELECT qid, rid, shared FROM p")
def shared_counts(spark, d):
    b = basket(spark, d)
    return compare.shared_counts(b, b, ordered=True)


@query(f"{_PAIRS} SELECT qid, rid, shared, round({_JAC}, 6) AS metric, round(least(ln(1 / (2 * {_JAC}) + 0.5) / 16, 1), 6) AS dist FROM q")
def dist_jaccard(spark, d):
    return compare.distances(pairs(spark, d)).select("qid", "rid", "shared", r6("metric").alias("metric"), r6("dist").alias("dist"))


@query(f"{_PAIRS} SELECT qid, rid, shared, round(shared / least(qry_s, ref_s), 6) AS metric, round(least(ln(least(qry_s, ref_s) / shared) / 16, 1), 6) AS dist FROM q")
def dist_containment(spark, d):
    return compare.distances(pairs(spark, d), "containment").select("qid", "rid", "shared", r6("metric").alias("metric"), r6("dist").alias("dist"))


@query(
    f"""{_PAIRS}, e AS (SELECT *, 1 - pow(1 - pow(4.0, -14), qry_s - shared) AS px, 1 - pow(1 - pow(4.0, -14), ref_s - shared) AS py FROM q),
f AS (SELECT *, CASE WHEN px + py - 2 * px * py = 0 THEN 'nan'::DOUBLE ELSE px * py * (qry_s + ref_s - 2 * shared) / (px + py - 2 * px * py) END AS rs FROM e),
m AS (SELECT *, (shared - rs) / (qry_s + ref_s - shared) AS m FROM f)
SELECT qid, rid, round(rs, 6) AS rs, round(m, 6) AS metric, round(CASE WHEN isnan(m) OR m < 0 THEN 'nan'::DOUBLE WHEN m = 0 THEN 1 ELSE least(ln(1 / (2 * m) + 0.5) / 16, 1) END, 6) AS dist FROM m"""
)
def dist_corrected(spark, d):
    return compare.distances(pairs(spark, d), k=8, level=1, correction=True).select("qid", "rid", r6("rs").alias("rs"), r6("metric").alias("metric"), r6("dist").alias("dist"))


@query(
    f"""{_PAIRS}, m AS (SELECT qid, rid, {_JAC} AS m, sqrt({_JAC} * (1 - {_JAC}) / (qry_s + ref_s - shared)) AS sd FROM q), b AS (SELECT *, m - 1.96 * sd AS lo, m + 1.96 * sd AS hi FROM m)
SELECT qid, rid, round(lo, 6) AS m_lo, round(hi, 6) AS m_hi, round(ln(1 / (2 * hi) + 0.5) / 16, 6) AS d_lo, round(CASE WHEN lo <= 0 THEN 'nan'::DOUBLE ELSE ln(1 / (2 * lo) + 0.5) / 16 END, 6) AS d_hi FROM b"""
)
def dist_ci(spark, d):
    return compare.distances(pairs(spark, d), confidence=True).select("qid", "rid", *(r6(c).alias(c) for c in ("m_lo", "m_hi", "d_lo", "d_hi")))


@query(f"{_PAIRS} SELECT qid, rid, round(ln(1 / (2 * {_JAC}) + 0.5) / 16, 6) AS dist FROM q WHERE least(ln(1 / (2 * {_JAC}) + 0.5) / 16, 1) <= 0.17")
def dist_threshold(spark, d):
    return compare.within(compare.distances(pairs(spark, d)), 0.17).select("qid", "rid", r6("dist").alias("dist"))


_PVALUE = f"""{_PAIRS}, m AS (SELECT qid, rid, {_JAC} AS m, sqrt({_JAC} * (1 - {_JAC}) / (qry_s + ref_s - shared)) AS sd FROM q), v AS (SELECT qid, rid, m, m / sd / sqrt(2) AS z, 4 / (2 + m / sd / sqrt(2)) - 1 AS x FROM m),
e AS (SELECT qid, rid, m, 0.5 * 2 / (2 + z) * exp(list_reduce({compare.ERFC}::DOUBLE[], lambda a, b: a * x + b) - z * z) AS p FROM v)"""


@query(f"{_PVALUE} SELECT qid, rid, round(m, 6) AS metric, round(p, 6) AS p_value, round(p * (SELECT count(*) FROM z) * (SELECT count(*) FROM z), 4) AS fdr FROM e")
def dist_pvalue(spark, d):
    b = basket(spark, d)
    n = b.select("gid").distinct().count()
    p = compare.p_values(compare.distances(pairs(spark, d), confidence=True), n * n)
    return p.select("qid", "rid", r6("metric").alias("metric"), r6("p_value").alias("p_value"), F.round("fdr", 4).alias("fdr"))


@query(
    f"""{_PAIRS}, e AS (SELECT *, 1 - pow(1 - pow(4.0, -6), qry_s - shared) AS px, 1 - pow(1 - pow(4.0, -6), ref_s - shared) AS py FROM q),
f AS (SELECT *, (shared - px * py * (qry_s + ref_s - 2 * shared) / (px + py - 2 * px * py)) / (qry_s + ref_s - shared) AS m FROM e)
SELECT qid, rid, rank, round(m, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_JAC} DESC, rid) AS rank FROM f) WHERE rank <= 3"""
)
def dist_topn_corrected(spark, d):
    """The rank is by the uncorrected similarity, whatever the correction makes of it."""
    n = compare.nearest(compare.distances(pairs(spark, d), k=4, level=1, correction=True), 3)
    return n.select("qid", "rid", F.col("rank").cast("long").alias("rank"), r6("metric").alias("metric"))


@query(
    f"""{_SK}, z AS (SELECT gid, count(*) AS n FROM sk GROUP BY gid), p AS (SELECT a.gid AS qid, b.gid AS rid, count(*) AS shared FROM sk a JOIN sk b USING (code) WHERE a.gid <> b.gid GROUP BY 1, 2),
q AS (SELECT qid, rid, shared, shared / (x.n + y.n - shared) AS m FROM p JOIN z x ON x.gid = qid JOIN z y ON y.gid = rid)
SELECT qid, rid, shared, rank, round(m, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m DESC, rid) AS rank FROM q) WHERE rank <= 5"""
)
def dist_topn(spark, d):
    n = compare.nearest_of(written(txt_sketch(spark, d), "sketch"), 5)
    return n.select("qid", "rid", "shared", "rank", r6("raw").alias("metric"))


@query(f"{_PAIRS} SELECT qid, rid, rank, round(m, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m DESC, rid) AS rank FROM (SELECT *, {_JAC} AS m FROM q)) WHERE rank <= 3")
def dist_topn_basket(spark, d):
    n = compare.nearest(compare.distances(pairs(spark, d)), 3)
    return n.select("qid", "rid", F.col("rank").cast("long").alias("rank"), r6("metric").alias("metric"))


@query("SELECT a.r_regionkey::BIGINT AS qid, b.r_regionkey::BIGINT AS rid, (SELECT count(*) FROM nation x JOIN nation y ON x.n_nationkey % 7 = y.n_nationkey % 7 WHERE x.n_regionkey = a.r_regionkey AND y.n_regionkey = b.r_regionkey AND x.n_nationkey % 7 <> 5) AS shared FROM region a, region b")
def dist_dense(spark, d):
    s = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("gid"), (F.col("n_nationkey") % 7).cast("long").alias("code")).where("code <> 5")
    ids = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("qid"))
    return compare.dense(compare.shared_counts(s, s), ids, ids.withColumnRenamed("qid", "rid"))


# --- coverage and vectors -------------------------------------------------------------------------

_STATS = """c AS (SELECT sample, ref, count(*) AS shared, avg(cnt) AS avg, list_sort(list(cnt)) AS a FROM m JOIN y USING (code) GROUP BY sample, ref HAVING count(*) >= 6),
cov AS (SELECT sample, ref, shared, avg, CASE WHEN floor(shared * 0.99) >= floor(shared * 0.98) THEN list_sum(a[floor(shared * 0.98)::INT:floor(shared * 0.99)::INT]) / (floor(shared * 0.99) - floor(shared * 0.98) + 1) ELSE 0.0 END AS pct, a[greatest(shared // 2, 1)] AS median, a[len(a)] AS max FROM c)"""
_COVER = f"""WITH m AS (SELECT p_brand AS ref, p_partkey AS code FROM part), y AS (SELECT l_suppkey AS sample, l_partkey AS code, floor(least(sum(l_quantity), 65535))::BIGINT AS cnt FROM lineitem GROUP BY 1, 2), {_STATS}"""
_YEAR = f"""WITH m AS (SELECT p_brand AS ref, p_partkey AS code FROM part), y AS (SELECT year(l_shipdate) AS sample, l_partkey AS code, count(*) AS cnt FROM lineitem GROUP BY 1, 2), {_STATS}"""
_ABV = f"{_COVER}, f AS (SELECT sample, ref, pct - 1 AS x FROM cov WHERE median > 1 AND shared > 7), abv AS (SELECT sample, ref, 100 * x / sum(x) OVER (PARTITION BY sample) AS pct FROM f), nrm AS (SELECT sample, sqrt(sum(pct * pct)) AS l2, count(*) AS dims FROM abv GROUP BY sample)"


@query(f"{_COVER} SELECT sample, ref, shared, round(avg, 6) AS avg, round(pct, 6) AS avgpct9899, median, max FROM cov")
def coverage_stats(spark, d):
    c = coverage.coverage(cover_markers(spark, d), cover_sample(spark, d))
    return c.select("sample", "ref", "shared", r6("avg").alias("avg"), r6("avgpct9899").alias("avgpct9899"), "median", "max")


@query(f"{_COVER} SELECT sample, ref, shared, row_number() OVER (PARTITION BY sample ORDER BY shared DESC, ref) AS place FROM cov")
def coverage_order(spark, d):
    c = coverage.ordered(coverage.coverage(cover_markers(spark, d), cover_sample(spark, d)))
    return c.select("sample", "ref", "shared", F.col("place").cast("long").alias("place"))


@query(f"{_ABV} SELECT sample, ref, round(pct, 6) AS pct FROM abv")
def abv(spark, d):
    return vectors(spark, d).select("sample", "ref", r6("pct").alias("pct"))


@query(f"{_ABV} SELECT sample, round(l2, 6) AS l2, dims FROM nrm")
def abv_norms(spark, d):
    return coverage.norms(vectors(spark, d)).select("sample", r6("l2").alias("l2"), "dims")


_FOUND = f"{_ABV}, j AS (SELECT a.sample AS qid, b.sample AS sample, a.pct AS x, b.pct AS y FROM abv a JOIN abv b USING (ref) WHERE a.sample % 20 = 0)"


def _search(spark, d, measure):
    v = vectors(spark, d)
    return coverage.search(v.where("sample % 20 = 0"), v, measure).select("qid", "sample", (r6("score") + 0.0).alias("score"))


@query(f"{_FOUND} SELECT qid, j.sample, round(sum(x * y) / (any_value(n.l2) * any_value(o.l2)), 6) AS score FROM j JOIN nrm n ON n.sample = qid JOIN nrm o ON o.sample = j.sample GROUP BY qid, j.sample")
def abv_search_cosine(spark, d):
    return _search(spark, d, "cosine")


@query(f"{_FOUND} SELECT qid, sample, round(sum(abs(x - y)) + 200 - sum(x) - sum(y), 6) + 0.0 AS score FROM j GROUP BY qid, sample")
def abv_search_l1(spark, d):
    return _search(spark, d, "l1")


@query(f"{_FOUND} SELECT qid, sample, round(sqrt(sum((y - x) * (y - x))), 6) AS score FROM j GROUP BY qid, sample")
def abv_search_l2(spark, d):
    return _search(spark, d, "l2")


# --- profiles and look-ups ------------------------------------------------------------------------


EXCEED = 18  # shared codes that a reference must exceed


def _profile(spark, d, depth):
    c = yearly(spark, d).where(F.col("shared") > EXCEED).withColumn("depth", depth)
    return profile.relative(c).select("sample", "ref", r6("depth").alias("depth"), r6("fraction").alias("fraction"))


# Poisson depth at average coverage 0 to 10.
_POISSON = "CASE WHEN pct > 5 THEN pct - 3 ELSE [0, .02, .08, .69, 1.57, 2.49, 3.41, 4.31, 5.20, 6.08, 6.94][floor(pct)::INT + 1]::DOUBLE END"
_REL = "SELECT sample, ref, round(depth, 6) AS depth, round(depth / sum(depth) OVER (PARTITION BY sample), 6) AS fraction FROM x WHERE depth IS NOT NULL"


@query(f"{_YEAR}, x AS (SELECT sample, ref, {_POISSON} AS depth FROM cov WHERE shared > 18) {_REL}")
def profile_poisson(spark, d):
    return _profile(spark, d, profile.poisson_depth(F.col("avgpct9899")))


@query(f"{_YEAR}, x AS (SELECT sample, ref, CASE WHEN pct > 3 AND median > 1 AND shared > 18 THEN pct - 3 WHEN pct >= 2 AND shared > 18 THEN greatest(pct - 3, 0.01) END AS depth FROM cov) {_REL}")
def profile_two_tier(spark, d):
    return _profile(spark, d, profile.two_tier_depth(F.col("avgpct9899"), F.col("median"), F.col("shared")))


@query(f"{_YEAR}, x AS (SELECT sample, ref, CASE WHEN pct - 3 > 0.1 THEN pct - 3 ELSE pow(10, pct - 3.1) END AS depth FROM cov WHERE shared > 18) {_REL}")
def profile_deviation(spark, d):
    return _profile(spark, d, profile.deviation_depth(F.col("avgpct9899")))


def _nodes(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.lit("species").alias("rank"), (F.col("n_regionkey") + 10).cast("long").alias("parent"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("node"), F.lit("superkingdom").alias("rank"), F.lit(1).cast("long").alias("parent"), F.col("r_name").alias("name"))
    return n.union(r)


def _leaves(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("sample"), (F.col("c_nationkey") + 100).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("sample", "node", (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("sample"))).alias("pct"))


_TREE = """WITH l AS (SELECT c_mktsegment AS sample, c_nationkey + 100 AS node, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS pct FROM customer GROUP BY 1, 2),
e AS (SELECT sample, node, pct FROM l UNION ALL SELECT sample, n_regionkey + 10, pct FROM l JOIN nation ON n_nationkey + 100 = node), u AS (SELECT sample, node::BIGINT AS node, sum(pct) AS pct FROM e GROUP BY 1, 2)"""


@query(f"{_TREE} SELECT sample, node, round(pct, 6) AS pct FROM u")
def taxonomy_rollup(spark, d):
    return profile.rollup(_leaves(spark, d), _nodes(spark, d)).select("sample", "node", r6("pct").alias("pct"))


@query(
    f"""{_TREE}, p AS (SELECT r_regionkey + 10 AS node, 'superkingdom' AS rank, (r_regionkey + 10)::VARCHAR AS taxpath, r_name AS taxpathsn FROM region
UNION ALL SELECT n_nationkey + 100, 'species', (r_regionkey + 10) || '|' || (n_nationkey + 100), r_name || '|' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT sample, node AS taxid, rank, taxpath, taxpathsn, printf('%.4f', pct) AS percentage FROM u JOIN p USING (node)"""
)
def cami_profile(spark, d):
    nodes = _nodes(spark, d)
    up = profile.ancestors(nodes)
    return profile.cami(profile.rollup(_leaves(spark, d), nodes, up), nodes, up)


@query("SELECT c_custkey AS line_no, c_nationkey::VARCHAR AS key, c_name AS line FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def lookup_semi(spark, d):
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("line"))
    return lookups.semi(lines, table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key")))


@query("SELECT n_nationkey::BIGINT AS pos, (2 * n_nationkey)::VARCHAR AS key, coalesce((SELECT max_by(s_name, s_suppkey) FROM supplier WHERE s_nationkey = 2 * n_nationkey), '==no match==') AS line FROM nation")
def lookup_ordered(spark, d):
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), F.col("s_nationkey").cast("string").alias("key"), F.col("s_name").alias("line"))
    return lookups.ordered(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_nationkey") * 2).cast("string").alias("key")), lines)


@query(
    "SELECT 'n' || s_nationkey AS run, coalesce('p' || n_regionkey, 'NA') AS bioproject, coalesce(n_name, 'NA') AS biosample, coalesce(n_name, 'NA') AS organism FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = s_nationkey"
)
def lookup_left_na(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey", F.lit(".fastq.abv")).alias("key"))
    n = table(spark, d, "nation")
    meta = n.select(F.concat(F.lit("n"), "n_nationkey").alias("run"), F.concat(F.lit("p"), "n_regionkey").alias("bioproject"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("biosample"), F.col("n_name").alias("organism"))
    return lookups.left_na(rows, meta)


@query("SELECT n_name AS species, r_name || chr(9) || 'x' || n_nationkey || chr(9) || n_name AS levels FROM nation JOIN region ON r_regionkey = n_regionkey")
def lineage_split(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = j.select(F.concat(F.lit("d__"), "r_name", F.lit(";p__x"), F.col("n_nationkey").cast("string"), F.lit(";s__"), "n_name").alias("lineage"))
    return lookups.lineage(n.select(F.col("n_name").alias("species")), lines)
