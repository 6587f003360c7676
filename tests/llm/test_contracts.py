"""Parts of the methods, whole stages and edge cases against brute force."""

import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerframe.llm import debruijn_dedup, decontaminate, embedding_dedup, html_extract, mixing, ngram_join, suffix_dedup, textmodel, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("width, letters, n", [(8, 2, 400), (20, 2, 700), (200, 2, 1500), (30, 1, 120)])
def test_longest_previous_factors(width, letters, n):
    rng = np.random.default_rng(width + n)
    b = rng.integers(97, 97 + letters, n, dtype=np.uint8)
    b[n // 2 : n // 2 + n // 4] = b[: n // 4]
    at = np.arange(n - width + 1)
    position = rng.permutation(len(at))
    lpf, smaller, lengths, order = suffix_dedup.previous_factors(b, at, position, width)
    text = b.tobytes()
    s = [text[k : k + width] for k in at]
    assert [s[k] for k in order] == sorted(s)
    common = lambda x, y: next((k for k in range(width) if x[k] != y[k]), width)
    place = {k: p for p, k in enumerate(order.tolist())}
    for k in range(0, len(at), max(1, len(at) // 60)):
        assert lpf[k] == max([0, *(common(s[k], s[j]) for j in range(len(at)) if position[j] < position[k])])
        before = next((j for j in order[: place[k]][::-1] if position[j] < position[k]), -1)
        after = next((j for j in order[place[k] + 1 :] if position[j] < position[k]), -1)
        assert smaller[:, k].tolist() == [before, after]
        assert lengths[:, k].tolist() == [common(s[k], s[j]) if j >= 0 else 0 for j in (before, after)]


def test_hot_anchor_in_parts_with_repeated_rows(spark):
    """More rows of one anchor than are held at once, repeated rows among them."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(60))
    rows = [(k, f"{word()} {line} {word()}") for k in range(300)]
    rows += [(None, "z" * 300 + line), (None, "z" * 300 + line), (7, rows[7][1])]
    df = docs_of(spark, rows).repartition(40)
    from test_llm import brute_bytes, brute_words

    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.marked(df, 200, "none").mapInArrow(suffix_dedup._cut(200, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect())
    assert got == sorted((i, sum(g)) for i, _, g in brute_bytes(rows, 200, "none"))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn_dedup.cut(df, 13, True).fillna(-(2**63), ["doc_id"]).collect())
    assert got == brute_words(rows, 13)


def test_keep_first_tells_unlike_texts_of_one_id_apart(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(None, passage + "first"), (None, passage + "second"), (5, "x" + passage)]
    got = sorted(r.n_removed for r in suffix_dedup.dedup(docs_of(spark, rows), 200, "first").collect())
    assert got == [0, 400, 400]


@pytest.mark.parametrize("width", [2, 3, 12, 13, 16])
def test_word_ranks(width):
    rng = np.random.default_rng(width)
    codes = rng.integers(0, 3, 300).astype(np.uint64)
    codes[150:250] = codes[:100]
    rank = debruijn_dedup.word_ranks(codes, width)[: len(codes) - width + 1]
    s = [tuple(codes[k : k + width].tolist()) for k in range(len(codes) - width + 1)]
    assert np.unique(rank, return_inverse=True)[1].tolist() == [sorted(set(s)).index(x) for x in s]


def test_paths_end_at_branches():
    """Edges a-b-c and x-b-c: the node b-c has two ways in, so no path passes it."""
    words = np.array([1, 2, 3, 4, 9, 2, 3, 4], np.uint64)
    first, many, branch = debruijn_dedup.graph(2)(words.view(np.uint8), np.array([0, 32, 64]), np.array([3, 3]), np.array([2, 2]), np.arange(6))
    assert first.tolist() == [0, 1, 2, 3, 1, 2] and many.all()
    assert branch.tolist() == [False, True, False, False, True, False] or branch.tolist()[1::3] == [True, True]


def test_spans_continue_and_are_verified():
    spans = np.array([[5, 2, 1, 7, 50], [0, 3, 1, 7, 10], [3, 2, 1, 7, 13]])
    assert debruijn_dedup.compacted(spans).tolist() == [[0, 5, 1, 7, 10], [5, 2, 1, 7, 50]]
    words = [f"w{k}".encode() for k in range(20)]
    good = {"fstart": 2, "len": 3, "digest": debruijn_dedup.digest(words, 2, 3, 4)}
    asked = pa.array([[good, {**good, "fstart": 3}]], pa.list_(pa.struct([("fstart", pa.int32()), ("len", pa.int32()), ("digest", pa.binary())])))
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b" ".join(words).decode()]), asked], ["doc_id", "tag", "text", "asked"])
    bad = list(debruijn_dedup._source(4)([b]))[0].to_pylist()
    assert [(x["fdoc"], x["ftag"], x["fstart"], x["len"]) for x in bad] == [(1, 2, 3, 3)]
    spans = pa.array([[dict(zip(debruijn_dedup.SPAN, s, strict=True)) for s in ((0, 2, 1, 2, 4), (8, 1, 1, 2, 0))]])
    wrong = pa.array([[dict(zip(debruijn_dedup.SPAN, (8, 1, 1, 2, 0), strict=True))]])
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b" ".join(words).decode()]), spans, wrong], ["doc_id", "tag", "text", "spans", "wrong"])
    assert [r[1] for r in debruijn_dedup._trimmed(b, 4, True)] == [9] and [r[1] for r in debruijn_dedup._trimmed(b, 4, True, True)] == [5]


def test_mixing_against_a_direct_solution(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), f"s{k % 5}" if k % 11 else None) for k in range(900)]
    rows += [(1, "same words here", "s1")] * 3000 + [(None, "null id", "s2")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    sizes = dict(con.sql("select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) from documents group by 1").fetchall())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:  # resharing, one source at a time
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2 * sizes[s] if over else rest * weight[s] / sum(weight[x] for x in free)
        free -= set(over or free)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for s, mine in by.items():
        assert {r.source_size for r in mine} == {sizes[s]} and abs(mine[0].target - target[s]) < 1e-6
        size = np.array([r.size for r in mine], float)
        low, high = -500.0, 500.0
        rates = lambda l: np.minimum(2, np.exp(np.clip(l * size / size.mean(), -700, 700)))  # noqa: B023, E731
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (rates(mid) * size).sum() < target[s] else (low, mid)
        full = size > 0
        assert np.allclose(np.array([r.rate for r in mine])[full], rates(low)[full], atol=1e-6)
        # Optimal: for two documents off the cap, ln r / size is the same.
        inner = [(np.log(r.rate) / r.size) for r in mine if r.size and 1e-9 < r.rate < 2 - 1e-9]
        assert not inner or max(inner) - min(inner) < 1e-6
        took = sum(r.copies * r.size for r in mine)
        assert abs(took - target[s]) <= 0.02 * target[s] + 10 and all(0 <= r.copies <= 2 for r in mine)
    assert len({round(r.rate, 6) for r in by["s1"]}) > 1
    again = Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(df.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.size, r.copies) for r in got)


def brute_items(text, items, width=13):
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    w, out = words(text), []
    for i, t in items:
        x = words(t)
        n = min(width, len(x))
        if len(x) < 5:
            continue
        most = 2 if n >= 12 else 2 * n // 13
        if any(sum(a == b for a, b in zip(x[p : p + n], w[q : q + n], strict=True)) >= n - most for p in range(len(x) - n + 1) for q in range(len(w) - n + 1)):
            out.append(i)
    return sorted(out, key=lambda v: (v is None, v))


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, small):
    rng = random.Random(17)
    word = lambda: f"b{rng.randrange(400)}"
    items = [(k if k % 9 else None, " ".join(word() for _ in range(rng.choice([3, 5, 7, 9, 12, 14, 30])))) for k in range(60)]
    items += [(100, items[20][1]), (100, items[20][1]), (101, None), (102, "")]
    rows = []
    for k in range(120):
        text = [word() for _ in range(rng.randint(0, 60))]
        if k % 2:
            part = rng.choice(items[:60])[1].split()
            for p in rng.sample(range(len(part)), min(len(part), k % 4)):
                part[p] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        rows.append((None if k % 7 == 0 else k % 50, " ".join(text).replace("b1 ", "B1, ").replace("b2 ", "“b2” ")))
    rows += [(None, None), (None, ""), rows[1], rows[1]]
    if not small:
        monkeypatch.setattr(decontaminate, "SMALL", 0)
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, seed int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, tag string")
    got = Counter((r.doc_id, tuple(r["items"]), r.n_items) for r in decontaminate.overlaps(d, b).collect())
    want = Counter((i, tuple(x), len(x)) for i, t in rows for x in [brute_items(t, items)])
    assert got == want


ODD = "copy long, __0 string, __row long, __id string, __tag string, tag string, spans string, seed int, node long, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with null and repeated ids, repeated rows, a very long text and columns of clashing names."""
    rng = random.Random(23)
    text = lambda k: " ".join(f"t{rng.randrange(9000)}" for _ in range(k))
    passage = text(80)
    rows = [(None, text(30)), (None, text(30)), (None, None), (None, ""), (4, text(40)), (4, text(50)), (5, text(60000)), (6, f"{text(30)} {passage}"), (7, f"{passage} {text(30)}"), (None, f"{text(30)} {passage} {text(30)}")]
    rows += [rows[0], rows[4], rows[2]]
    full = [(i, t, "en", ("s1", None, "s2")[k % 3], 0, k, "p", k, "q", "r", "s", "u", k, k, k) for k, (i, t) in enumerate(rows)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:20]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(100, 120)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.createDataFrame(full, f"{DOCS}, {ODD}"), str(path), rows


def stages():
    return [(f.__module__.rsplit(".", 1)[1], f) for f in (toxicity.stage, ngram_join.stage, suffix_dedup.stage, decontaminate.stage, mixing.stage)]


@pytest.mark.parametrize("name, stage", stages())
def test_stages_on_odd_rows(spark, odd, name, stage):
    df, path, rows = odd
    out = stage(spark, df, path)
    assert out.columns[: len(df.columns)] == df.columns
    got = sorted((r["__row"], r["a.b"], r.doc_id, r.text) for r in out.collect())
    whole = [(k, k, i, t) for k, (i, t) in enumerate(rows)]
    if name == "toxicity":  # no labelled document is there to learn from
        assert got == sorted(whole, key=lambda r: r[0])
    elif name == "ngram_join":  # one of each group of equal texts; texts without words are not alike
        assert len(got) == len(rows) - 2 and {r[0] for r in got} >= {1, 2, 3, 5, 6, 7, 8, 9, 12}
    elif name == "suffix_dedup":
        assert [r[:3] for r in got] == [r[:3] for r in whole]
        texts = {r[0]: r[3] for r in got}
        assert texts[2] is None and texts[3] == "" and texts[6] == rows[6][1] and texts[9] == rows[9][1]
        assert all(len(texts[k]) < len(rows[k][1]) - 300 for k in (7, 8))
    elif name == "decontaminate":
        assert [r[0] for r in got] == [k for k in range(len(rows)) if k != 1]
    else:
        assert out.columns[-1] == "_copy" and all(n <= 2 for n in Counter(r[0] for r in got).values())


@pytest.mark.parametrize("name, stage", stages())
def test_stages_on_no_rows(spark, odd, name, stage):
    df, path, _ = odd
    assert stage(spark, df.where("false"), path).count() == 0


def test_samples_are_bounded(spark):
    df = spark.createDataFrame([(1, "same", "en")] * 6000 + [(k, f"t{k}", "en") for k in range(3000)] + [(k, f"r{k}", "xx") for k in range(20)], "doc_id long, text string, lang string")
    rows = textmodel.sample(df, ("doc_id", "text"), "lang", lambda n, total: max(16, 512 * n // total), 1).collect()
    n = Counter(r.lang for r in rows)
    assert n["en"] <= 512 and n["xx"] == 16 and sum(r.text == "same" for r in rows) <= 1 and n["en"] > 300
    held = textmodel.held(df, 100, 2)
    assert held.num_rows <= 100


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"idiot scum {k}" if k % 2 else f"fine words {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, k % 2) for k in range(10**6, 10**6 + 4000)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels, limit=64).collect()}
    assert np.mean([got[k] == k % 2 for k in range(200)]) > 0.97


@pytest.mark.parametrize(
    "page, text",
    [
        ("just text here", "just text here"),
        ("<p>One paragraph here of words.</p><p>Two paragraph.</p>", "One paragraph here of words. Two paragraph."),
        ("<body>text straight in body, long enough to read and go on</body>", "text straight in body, long enough to read and go on"),
        ("<article><p>See <math><mi>x</mi></math> and more text of the article goes on here.</p><aside>related stuff</aside><p>End of the article text.</p><footer>tags</footer></article>", "See x and more text of the article goes on here. End of the article text."),
    ],
)
def test_html_without_telling_containers(page, text):
    assert html_extract.extract_text([page], html_extract.model())[0] == text


def test_html_hardly_leans_on_one_tag(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = html_extract.extract_text(pages, html_extract.model())
    div = html_extract.extract_text([p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages], html_extract.model())
    assert all(div) and sum(a != b for a, b in zip(plain, div, strict=True)) <= 0.02 * len(pages)


def test_large_buckets_and_blocks(spark, monkeypatch):
    """The same links whether buckets are compared within, or groups in many blocks."""
    rng = random.Random(29)
    base = [f"n{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for p in rng.sample(range(80), rng.randint(0, 2)):
            w[p] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"n{rng.randrange(5000)}" for _ in range(50))) for k in range(30)]
    df = docs_of(spark, rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = Counter(x for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for x in (a, b))
    for bucket, members in ((256, 1024), (4, 8)):
        monkeypatch.setattr(ngram_join, "BLOCK", bucket)
        monkeypatch.setattr(ngram_join, "MEMBERS", members)
        assert {r.doc_id: r.n_links for r in ngram_join.join(df).collect()} == {i: links[i] for i in sets}


def test_embeddings_in_many_lists(spark, monkeypatch):
    rng = np.random.default_rng(31)
    base = rng.normal(size=(30, 8))
    rows = [(k if k else None, (base[k % 30] + rng.normal(size=8) * 0.08).tolist(), k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r.embedding for r in df.collect()], float)
    label = np.array([r[2] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    want = near.sum(1) - 1
    for lists, block in ((4, 1024), (64, 16)):
        monkeypatch.setattr(embedding_dedup, "LEAST_LISTS", lists)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r.vec_id: r.n_links for r in embedding_dedup.near(df).collect()}
        assert [got[r[0]] for r in rows] == want.tolist()


def test_whole_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(37)
    text = lambda k: " ".join(f"p{rng.randrange(20000)}" for _ in range(k))
    passage, item = text(90), text(30)
    rows = [(k, text(60) + (" idiot scum clown moron" if k % 4 == 0 else "")) for k in range(400)]
    near = rows[1][1].split()
    near[5] = "changed"
    rows += [(1000, rows[1][1]), (1001, " ".join(near)), (None, rows[1][1]), (1002, f"{text(20)} {passage}"), (1003, f"{passage} {text(20)}"), (1004, f"{text(20)} {item} {text(20)}"), (None, text(40)), (None, text(40))]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = at[name] = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), T.StructType(stage(spark, docs, str(tmp_path)).schema.fields))
    ids = {n: [r.doc_id for r in d.collect()] for n, d in at.items()}
    toxic = {k for k in range(400) if k % 4 == 0}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(ids["toxicity"]) >= len(rows) - len(toxic) - 6
    assert not {1, 1000, 1001} & set(ids["ngram_jaccard_join"]) and ids["ngram_jaccard_join"].count(None) == 3
    left = {r.doc_id: r.text for r in at["suffix_array_dedup"].collect()}
    assert len(ids["suffix_array_dedup"]) == len(ids["ngram_jaccard_join"]) and passage in left[1002] and passage not in left[1003]
    assert 1004 not in ids["benchmark_decontamination"] and set(ids["benchmark_decontamination"]) == set(ids["suffix_array_dedup"]) - {1004}
    total = sum(len(r.text.split()) for r in at["benchmark_decontamination"].collect())
    assert abs(sum(len(r.text.split()) for r in at["source_mixing"].collect()) - 1.5 * total) < 0.02 * total
