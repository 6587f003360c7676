"""The registered queries opN_<name> and, where SQL can express one, the SQL that checks it."""

from __future__ import annotations

from .debruijn_dedup import op4_debruijn_dedup
from .decontaminate import op7_benchmark_decontamination
from .embedding_dedup import op10_embedding_near_dedup
from .html_extract import op3_html_extraction
from .language_id import op6_language_id
from .mixing import op2_source_mixing
from .ngram_join import op5_ngram_jaccard_join
from .quality import op9_quality_classifier
from .suffix_dedup import op1_suffix_array_dedup
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_source_mixing, op3_html_extraction, op4_debruijn_dedup, op5_ngram_jaccard_join, op6_language_id, op7_benchmark_decontamination, op8_toxicity, op9_quality_classifier, op10_embedding_near_dedup)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM k SEMI JOIN r USING (m)),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
t AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY doc_id, run),
u AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM t),
v AS (SELECT d.doc_id, h, sum(z - a) AS gone, count(a) AS n, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept, max(z) AS last FROM d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id, h)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, n AS n_spans, sha256(unhex(CASE WHEN n = 0 THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM v
""",
    "op4_debruijn_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS f FROM k GROUP BY s),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT k.doc_id, k.i, unnest(range(0, 13)) AS j FROM k JOIN m USING (s) WHERE m.f < k.doc_id)),
a AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
r AS (SELECT a.doc_id, count(*) AS n, count(g.p) AS gone, string_agg(a.w[a.p], ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS n_words, coalesce(r.gone, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
""",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k / (a.n + b.n - k) >= 0.8),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT v AS doc_id, c AS class_id, (SELECT count(*) FROM l WHERE l.x = v) AS n_links, v = c AS kept FROM c
""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT v AS vec_id, (SELECT count(*) FROM l WHERE l.x = v) AS n_links, c AS component_id, v = c AS kept FROM c
""",
}
