"""Operators for training corpora against brute force, planted cases and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerframe.llm import decontaminate, embedding_dedup, html_extract, language_id, mixing, ngram_join, quality, repeats, suffix_dedup, toxicity
from kmerframe.llm import debruijn_dedup as dbg
from kmerframe.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, spans string, node int"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, out = text(70), []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = None if i % 20 else ""
        elif kind in (1, 2):
            t = f"{text(30)} {passage}\t{text(20)}"
        elif kind == 3 and out:
            t = out[-1][1]
        elif kind == 4:
            w = out[-2][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 5:
            t = ("ab " * 400) if i < 20 else "x" * 700
        elif kind == 6:
            t = text(rng.randint(1, 5))
        else:
            t = text(rng.randint(20, 200))
        out.append((i, t))
    out += [(3, out[3][1]), (n + 5, "longest " + text(3000) + " " + passage)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ("en", "de")[(i or 0) % 2], None if (i or 0) % 7 == 3 else f"s{(i or 0) % 3}", 0, "x", "y", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    return rows, frame(spark, rows)


def brute_bytes(rows, width, keep):
    enc = [((-(2**63) if i is None else i), (t or "").encode()) for i, t in rows]
    where = {}
    for i, b in enc:
        for k in range(len(b) - width + 1):
            where.setdefault(b[k : k + width], []).append((i, k))
    out = []
    for i, b in enc:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            w = where[b[k : k + width]]
            if (len(w) > 1) if keep == "none" else (i, k) != min(w):
                gone[k : k + width] = [True] * width
        out.append((i, b, gone))
    return out


def test_suffix_array(data):
    rows, df = data
    got = sorted(map(tuple, suffix_dedup.marked(df, 200, "none").mapInArrow(suffix_dedup._cut(200, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()))
    want = sorted((i, len(b), sum(g), sum(x and not (k and g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()) for i, b, g in brute_bytes(rows, 200, "none"))
    assert got == want


def test_suffix_array_keeps_first(data):
    rows, df = data
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(df, 200, "first").collect())
    brute = sorted((i, sum(g)) for i, b, g in brute_bytes(rows, 200, "first"))
    assert all(a == b and n <= m <= n + 400 for (a, n), (b, m) in zip(got, brute, strict=True))
    texts = {r.doc_id: r.text for r in suffix_dedup.dedup(df, 200, "first").collect()}
    assert texts[0] == "" and texts[10] is None and texts[1] == rows[1][1]


@pytest.mark.parametrize("width", [8, 30, 72, 200, 201])
def test_suffix_ranks(width):
    rng = np.random.default_rng(width)
    b = rng.integers(97, 99, 900, dtype=np.uint8)
    b[400:700] = b[:300]
    at = np.arange(len(b) - width + 1)
    rank = suffix_dedup.suffix_ranks(b, at, width)
    s = [b[k : k + width].tobytes() for k in at]
    assert np.array_equal(np.unique(s, return_inverse=True)[1], np.unique(rank, return_inverse=True)[1])


def brute_words(rows, width):
    enc = [((-(2**63) if i is None else i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in enc:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in enc:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_debruijn(data):
    rows, df = data
    assert sorted(map(tuple, dbg.marked(df).mapInArrow(dbg._cut(13, True), "doc_id long, n_words long, n_removed long, kept_sha256 string").collect())) == brute_words(rows, 13)


def test_hot_anchors_take_the_other_way(data, monkeypatch):
    rows, df = data
    monkeypatch.setattr(repeats, "HOT", 1)
    whole = repeats._settle
    found = df.sparkSession  # the limit is read where rows are settled, in workers: patch by closure
    assert found is not None

    def settle(rule):
        inner = whole(rule)

        def go(batches):
            from kmerframe.llm import repeats as r

            r.HOT = 1
            return inner(batches)

        return go

    monkeypatch.setattr(repeats, "_settle", settle)
    assert sorted(map(tuple, dbg.marked(df).mapInArrow(dbg._cut(13, True), "doc_id long, n_words long, n_removed long, kept_sha256 string").collect())) == brute_words(rows, 13)


def test_windows_of_hot_anchors_meet_places_as_series():
    """A row a series of windows, not one a window; a source that jumps ends a series where the first copy matters."""
    import pyarrow as pa

    names = ["anchor", "run", "off", "fdoc", "ftag", "fstart"]
    rows = [(1, 1, k, 5, 0, 40 + k) for k in range(300)] + [(1, 1, k, 6, 0, k) for k in range(300, 310)] + [(1, 1, 400, 6, 0, 100), (1, 2, 401, 6, 0, 101)]
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names)
    got = {rule: [tuple(r[c] for c in ("run", "off", "len", "fdoc", "fstart")) for x in repeats._series(rule)(iter([b])) for r in x.to_pylist()] for rule in ("all", "smaller")}
    assert got["all"] == [(1, 0, 310, 5, 40), (1, 400, 1, 6, 100), (2, 401, 1, 6, 101)]
    assert got["smaller"] == [(1, 0, 300, 5, 40), (1, 300, 10, 6, 300), (1, 400, 1, 6, 100), (2, 401, 1, 6, 101)]


def shingle_set(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def reach(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_join(data):
    rows, df = data
    s = [(i, shingle_set(t)) for i, t in rows]
    edges = [(x, y) for x in range(len(s)) for y in range(x) if s[x][1] and s[y][1] and len(s[x][1] & s[y][1]) / len(s[x][1] | s[y][1]) >= 0.8]
    n = Counter(v for e in edges for v in e)
    comp = reach({i for i, _ in s}, [(s[x][0], s[y][0]) for x, y in edges])
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df).collect())
    assert got == sorted((i, comp[i], n[k]) for k, (i, _) in enumerate(s))


def test_posterior():
    assert ngram_join.least_matches(96, 0.8, 1e-6) < 77 and ngram_join.least_matches(16, 0.8, 1e-6) >= 1
    rng = np.random.default_rng(0)
    for n, m in ((16, 8), (32, 20)):
        t = rng.beta(m + 1, n - m + 1, 400000)
        tail = sum(1 for x in [ngram_join.least_matches(n, 0.8, float((t >= 0.8).mean()) * f) for f in (0.8, 1.25)] if x <= m)
        assert tail == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [e for e in edges if e[0] != e[1]]
    assert got == reach({v for e in real for v in e}, real)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + rng.normal(size=16) * rng.choice([0.03, 0.06])).tolist(), k % 2) for k in range(400)]
    rows += [(500, rows[0][1], 0), (501, [0.0] * 16, 0), (502, None, 0), (503, [float("nan")] + [1.0] * 15, 0), (504, rows[0][1], None), (505, [None] + [1.0] * 15, 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [], 0), (509, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    x = {r.vec_id: r for r in df.collect()}

    def ok(r):
        return r.label is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)

    good, edges = [i for i in x if ok(x[i])], []
    for k, i in enumerate(good):
        for j in good[:k]:
            if x[i].label == x[j].label and len(x[i].embedding) == len(x[j].embedding):
                a, b = np.array(x[i].embedding, float), np.array(x[j].embedding, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    edges.append((i, j))
    n, comp = Counter(v for e in edges for v in e), reach(list(x), edges)
    got = sorted(map(tuple, embedding_dedup.near(df).collect()))
    assert edges and got == sorted((i, n[i], comp[i], comp[i] == i) for i in x)


def test_mixing(spark, data):
    rows, df = data
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.copies in (0, 1, 2)
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.size * r.copies
    assert all(s[0] == s[3] and s[2] <= 2 * s[3] + 1e-6 for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[0] for s in by.values())) < 1e-6
    assert all(abs(s[1] - s[2]) <= 0.02 * s[2] + 10 for s in by.values())
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_stages_decide_by_row(spark, tmp_path):
    rng = random.Random(21)
    text = lambda k: [f"v{rng.randrange(4000)}" for _ in range(k)]
    a, b, c, item = text(60), text(60), text(60), text(30)
    near = [*a[:-1], "changed"]
    rows = [(None, a), (None, near), (None, b), (7, b), (7, c), (8, a), (None, text(20) + item), (8, text(9) + item), (9, None), (9, None), (11, text(50)), (11, text(50)), (12, item[:20]), (13, c), (13, [*c[:-1], "other"])]
    docs = frame(spark, [(i, None if t is None else " ".join(t)) for i, t in rows])
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    whole = [(i, None if t is None else " ".join(t)) for i, t in rows]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert key(decontaminate.stage(spark, docs, str(tmp_path))) == Counter(w for k, w in enumerate(whole) if k not in (6, 7, 12))
    groups, got = [{0, 1, 5}, {2, 3}, {4, 13, 14}], key(ngram_join.stage(spark, docs, str(tmp_path)))
    left = {w for g in groups for w in [min((whole[k] for k in g), key=lambda w: (w[0] is not None, w[0] or 0))]}
    assert sum(got.values()) == len(rows) - sum(len(g) - 1 for g in groups)
    assert all(len([k for k in g if whole[k] in got]) == 1 for g in groups)
    assert {w[0] for w in left} == {None, 7} and all(got[whole[k]] for k in (6, 7, 8, 10, 11, 12)) and got[whole[8]] == 2
    bad = spark.createDataFrame([(i, f"fine words here {i}" if i % 2 == 0 else f"scum idiot {i}") for i in range(100, 140)] + [(None, "scum idiot"), (None, "fine words here"), (200, "scum idiot"), (200, "fine words here")], "doc_id long, text string")
    assert all(("scum" in t) == 0 for _, t in key(toxicity.stage(spark, bad, str(tmp_path)))) and sum(key(toxicity.stage(spark, bad, str(tmp_path))).values()) == 22


def test_repeated_id_with_near_texts(spark):
    words = [f"u{k}" for k in range(60)]
    got = ngram_join.join(frame(spark, [(4, " ".join(words)), (4, " ".join([*words[:-1], "x"])), (6, "else where")])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(4, 4, 1), (4, 4, 1), (6, 6, 0)]


def test_targets():
    t = mixing.targets(np.array([10.0, 100.0, 100.0]), np.array([3.0, 1.0, 2.0]), 315.0)
    assert np.allclose(t, [20, 295 / 3, 2 * 295 / 3])
    t = mixing.targets(np.array([10.0, 10.0, 10.0]), np.array([3.0, 1.0, 2.0]), 45.0)
    assert np.allclose(t, [20, 25 / 3, 50 / 3])
    assert np.allclose(mixing.targets(np.zeros(3), np.ones(3), 0.0), 0)


def test_newton_with_base_rates(spark):
    rows = [("a", float(k % 5 + 1) / 3, k + 1) for k in range(20)] + [(None, 1.0, 7)]
    df = spark.createDataFrame(rows, "source string, base double, size long")
    l = mixing.balance(df, {"a": 260.0, None: 3.5})
    got = sum(s * min(2, b * np.exp(l["a"])) for x, b, s in rows if x == "a")
    assert abs(got - 260) < 1e-6 and abs(np.exp(l[None]) - 0.5) < 1e-9


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        (None, ""),
        ("<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><article><h1>A &amp; B</h1><p>One <b>two</b>three,\n four. Five six seven.<br>Eight nine ten.<p>More words follow here, and more.</article><footer>&copy; Someone 2020</footer></body></html>", "A & B One twothree, four. Five six seven. Eight nine ten. More words follow here, and more."),
        ("<body><div class='ad'>Buy this now</div><article><h1>Title here</h1><p>The text of it is long enough to be read, and goes on.</p><script>var t='</p>';</script><!-- no --><p>End.</p></article><div class=comments><div class=comment><p>First!</p></div></div>", "Title here The text of it is long enough to be read, and goes on. End."),
    ],
)
def test_html(page, text):
    assert html_extract.extract_text([page or ""], html_extract.model())[0] == text


def test_html_on_made_pages():
    f = []
    for made in html_extract.training_pages(60, seed=77):
        p = html_extract.Page(made)
        want = Counter(" ".join("".join(" " if t is None else t if "\x01" in t else "" for e, t in p.pieces).split()).replace("\x01", "").split())
        got = Counter(html_extract.extract_text([made.replace("\x01", "")], html_extract.model())[0].split())
        f.append(2 * sum((want & got).values()) / max(1, sum(want.values()) + sum(got.values())))
    assert np.mean(f) > 0.93


def test_decoding_is_consistent():
    rng = np.random.default_rng(1)
    parent = [-1] + [int(rng.integers(0, k)) for k in range(1, 200)]
    kept = html_extract.decode(parent, rng.normal(size=200) * 3)
    for e in range(1, 200):
        chain, p = [kept[e]], parent[e]
        while p > 0:
            chain.append(kept[p])
            p = parent[p]
        s = "".join("1" if c else "0" for c in reversed(chain)).strip("0")
        assert "0" not in s


def test_language(spark):
    rng = random.Random(5)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["sch", "lich", "ung", "der"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(30)), x, "s") for i, x in ((i, ("aa", "bb")[i % 2]) for i in range(200))]
    rows += [(300, None, "aa", "s"), (301, "123 !!", "bb", "s"), (None, "theing andtion", None, None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[300].lang_pred == got[301].lang_pred == "und" and got[300].score == 0 and got[None].lang_pred == "aa"
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows[:200])
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows[:200]]) > 0.97


def test_toxicity_and_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        w, bad, low = [word() for _ in range(40)], i % 7 == 0, i % 5 == 0
        if bad:
            w[3] = w[20] = rng.choice(["Idiot,", "scum", "clown!"])
        if low:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(bad)))
    rows += [(900, None), (901, ""), (None, "scum")]
    labels += [(5000, 1, 1), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, y).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[None].predicted == 1 and got[900].predicted == 0
    assert np.mean([got[i].predicted == t for i, _, t in labels[:400]]) > 0.97
    grades = {r.doc_id: r for r in quality.grade(docs, y).collect()}
    assert np.mean([grades[i].kept == bool(q) for i, q, _ in labels[:400]]) > 0.95
    none = y.where("false")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0} and all(r.kept for r in quality.grade(docs, none).collect())


def test_nearest_is_exact():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(40)], 12)) + (" bad worse" if k % 3 == 0 else "") for k in range(300)]
    m = toxicity.Index(np.arange(300), pa.array(texts), (np.arange(300) % 3 == 0).astype(np.int64), 0.3)
    for term, w in m.vectors(*toxicity.plain(pa.array(texts[:40]))):
        if len(term):
            at, sim = m.nearest(term, w)
            every = w @ m.matrix[term]
            order = np.lexsort((np.arange(len(every)), -every))[: toxicity.K]
            order = order[every[order] > 0]
            assert np.allclose(np.sort(every[order]), np.sort(sim)) and len(at) == len(order)


def test_toxicity_uses_all_terms(spark):
    """Nearest examples by TF-IDF cosine over every term, idf over all documents, against a direct computation."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(60)]) for _ in range(rng.randint(3, 15)))) for i in range(120)] + [(500, ""), (501, "unheard of")]
    labels = [(i, 1, i % 2) for i in range(60)]
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, y).collect()}
    bags = {i: Counter((n, w[:n] if n else w) for w in t.split() for n in (0, *toxicity.PREFIX) if not n or len(w) > n) for i, t in rows}
    known = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    names = set().union(*(bags[i] for i in known))
    df = Counter(x for b in bags.values() for x in b)
    vec = {i: {x: (1 + np.log(n)) * (np.log((len(rows) + 1) / (df[x] + 1)) + 1) for x, n in b.items() if x in names} for i, b in bags.items()}
    norm = {i: np.sqrt(sum(v * v for v in x.values())) for i, x in vec.items()}
    for i, x in vec.items():
        sims = sorted((-round(sum(v * vec[k].get(t, 0) for t, v in x.items()) / norm[i] / norm[k], 9) for k in known), key=float) if x else []
        near = [s for s in sims if s < 0][:3]
        mine = [-round(sum(v * vec[k].get(t, 0) for t, v in x.items()) / norm[i] / norm[k], 9) for k in got[i].evidence]
        assert mine == near, i
    assert all(got[i].evidence for i in range(120)) and got[500].evidence == got[501].evidence == []


def test_grades_in_order(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        g = i % 3
        rows.append((i, " ".join(rng.choice(["good", "text"]) if rng.random() < (0.2, 0.5, 0.8)[g] else "&&&" for _ in range(80))))
        labels.append((i, g))
    got = {r.doc_id: r for r in quality.grade(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    mean = [np.mean([got[i].expected_grade for i, g in labels if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_decontamination(spark):
    rng = random.Random(10)
    text = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    items = [(k, text(40)) for k in range(8)] + [(8, text(7)), (9, ["a", "b"])]
    swapped = list(items[1][1])
    swapped[10] = swapped[18] = "other"
    docs = [(0, text(300)), (1, text(50) + items[0][1] + text(50)), (2, text(9) + swapped + text(9)), (3, [w.upper() + "," for w in items[2][1]]), (4, text(20) + items[8][1]), (5, items[3][1][:12] + text(80)), (6, ["a", "b"]), (7, None), (8, [])]
    d = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(99, None)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.overlaps(d, b).collect()}
    assert got == {0: [], 1: [0], 2: [1], 3: [2], 4: [8], 5: [3] if got[5] else [], 6: [], 7: [], 8: []}
    assert not any(r.contaminated for r in decontaminate.overlaps(d, b.where("false")).collect())


def test_every_substitution_is_found():
    """All placements of replaced words, and texts of mixed words, against brute force."""
    import itertools

    import pyarrow as pa

    rng = random.Random(31)
    for n, item in ((n, [f"t{n}x{k}" for k in range(n)]) for n in (5, 6, 7, 9, 11, 12, 13, 14, 16)):
        test = decontaminate.TestSet(np.array([1], object), pa.array([" ".join(item)]), 13, 2)
        places = [c for m in range(4) for c in itertools.combinations(range(n), m)]
        texts = [["q"] * 5 + [w if k not in c else "z" for k, w in enumerate(item)] + ["q"] * 5 for c in places]
        texts += [[rng.choice([*item, "q"]) for _ in range(30)] for _ in range(50)]

        def held(t):
            w = min(13, n)
            most = 2 if w >= 12 else 2 * w // 13
            return any(sum(t[s + k] == item[i + k] for k in range(w)) >= w - most for i in range(n - w + 1) for s in range(len(t) - w + 1))

        got = [bool(x) for x in decontaminate._found(test, pa.array([" ".join(t) for t in texts]))[0]]
        assert got == [held(t) for t in texts], n


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(41)
    items = [" ".join(f"b{rng.randrange(3000)}" for _ in range(20)) for _ in range(30)]
    rows = [(None, items[0]), (None, "clean text"), (3, items[1]), (3, "also clean"), (3, f"{items[2]} and {items[9]}"), (4, items[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = lambda: sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
    whole = got()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert got() == whole and len(whole) == len(rows)


def test_stages_carry_the_columns_of_each_row(spark):
    rows = [(5, "some words of a text " * 3, "en", "a", 0), (5, "some words of a text " * 3, "de", "b", 0), (None, "other " * 90, "en", "a", 0), (None, "other " * 90, "fr", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.lang, r.source) for r in suffix_dedup.stage(spark, docs, "").collect())
    assert got == [(0, "en", "a"), (0, "fr", "c"), (5, "de", "b"), (5, "en", "a")]
    same = spark.createDataFrame([(1, "one two three four", "s", 1)] * 9 + [(2, "five six", "s", 1), (3, "five six seven", "t", 1)] * 40, "doc_id long, text string, source string, n int")
    for _ in range(2):
        want = {r.source: r.t for r in mixing.mix(same).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
        took = Counter()
        for r in mixing.stage(spark, same, "").collect():
            took[r.source] += len(r.text.split())
        assert dict(took) == want


def test_empty_tables(spark):
    d = frame(spark, [(1, "x")]).where("false")
    y = spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")]))
    for df in (suffix_dedup.dedup(d), dbg.dedup(d), ngram_join.join(d), language_id.identify(d), mixing.mix(d), toxicity.scored(d, y), quality.grade(d, y), decontaminate.overlaps(d, d.select(F.col("doc_id").alias("item_id"), "text"))):
        assert df.count() == 0
    assert embedding_dedup.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
