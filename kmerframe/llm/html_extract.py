"""HTML extraction: the main text of a page.

Method. Pages are parsed into a DOM tree (optional end tags, raw-text elements, character
references). Gradient-boosted regression trees, fitted here by second-order boosting on histograms,
give each element the chance that all of its text is main text, from features of its tag, attribute
words (of known kinds, and all of them hashed), subtree density, depth, siblings and ancestors. A tree-shaped dynamic program then picks for
every element one of three states - before the article, in it, or cut out of it - of the greatest
likelihood under which a state can only pass from the first to the second to the third on the way
down; so no choice contradicts an ancestor's or a descendant's.

The trees are fitted on pages made here (training_pages): many layouts, with and without semantic
tags, with containers that tell something by their names, tell nothing or are missing, whose main text is
known by construction. No page of the input is learned from.

Edge cases: null html is empty and gives an empty text with n_chars 0; markup that isn't closed ends
with the page; text outside any element is judged as the body's; a very long page is read whole; a tie between states
goes to the earlier of them (between main and cut out to main); null page_id and url are kept;
repeated rows are extracted alike; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops as tx
from .common import columns_of, ship

PAGES = 800  # made pages that the trees are fitted on

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg select".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("br button caption dd dt td th tr tbody thead tfoot head html body option legend summary li".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")

# Kinds of attribute words and of tags.
KINDS = {
    "main": "article articlebody content post entry main body story text prose copy blogpost",
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar aside widget widgets related recommended rail trending popular secondary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "talk": "comment comments disqus reply replies respond discussion reviews",
    "share": "share sharing social follow tags meta byline author",
}
WORD_KIND: dict[str, list[int]] = {}
for _k, _words in enumerate(KINDS.values()):
    for _w in _words.split():
        WORD_KIND.setdefault(_w, []).append(_k)
TAG_KIND = {t: k for k, group in enumerate(("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "nav", "header", "footer", "aside", "form button fieldset label input", "a", "table tbody tr td th", "blockquote pre figure figcaption", "b i em strong span u small code", "html body")) for t in group.split()}
TAG_KIND["#"] = TAG_KIND["body"]
N_TAGS, N_KINDS = 18, len(KINDS)
HASHED = 32  # buckets of all attribute words, known or not
N_FEATURES = 2 * N_TAGS + 2 * N_KINDS + HASHED + 22


class Page:
    """Elements in page order, parents first; pieces of text with their elements, and block bounds."""

    __slots__ = ("tag", "parent", "kinds", "hashed", "pieces")

    def __init__(self, text: str):
        self.tag, self.parent, self.kinds, self.hashed = ["#"], [-1], [()], [()]
        self.pieces: list[tuple[int, str | None]] = []  # None: a block begins or ends
        stack, at, n = [0], 0, len(text)
        while at < n:
            m = TAG.search(text, at)
            upto = m.start() if m else n
            if upto > at:
                self.pieces.append((stack[-1], html_lib.unescape(text[at:upto])))
            if not m:
                break
            at = m.end()
            name = m[2] or m[4]
            if name:
                name = name.lower()
                attrs = m[3] if m[2] else m[5]
                if name in RAW:
                    if attrs.endswith("/") and name == "svg":
                        continue
                    end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
                    at = end.end() if end else n
                    if name in BLOCK:
                        self.pieces.append((stack[-1], None))
                    continue
                if name in ENDS_P:
                    self._close(stack, ("p",), ("td", "th", "button", "table"))
                if name in CLOSES:
                    self._close(stack, *CLOSES[name])
                if name in BLOCK:
                    self.pieces.append((stack[-1], None))
                if name in VOID:
                    continue
                self.tag.append(name)
                self.parent.append(stack[-1])
                kinds: set[int] = set()
                hashed: list[int] = []
                for a in ATTR.finditer(attrs) if "=" in attrs else ():
                    for w in TOKEN.findall((a[2] or a[3] or a[4] or "").lower()):
                        kinds.update(WORD_KIND.get(w, ()))
                        hashed.append(zlib.crc32(w.encode()) % HASHED)
                self.kinds.append(tuple(kinds))
                self.hashed.append(tuple(hashed))
                stack.append(len(self.tag) - 1)
            elif m[1]:
                name = m[1].lower()
                if name == "p" and not any(self.tag[x] == "p" for x in stack):
                    self.pieces.append((stack[-1], None))
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        if any(self.tag[x] in BLOCK for x in stack[k:]):
                            self.pieces.append((self.parent[stack[k]], None))
                        del stack[k:]
                        break

    def _close(self, stack: list[int], names: tuple, scope: tuple) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in names:
                self.pieces.append((self.parent[stack[k]], None))
                del stack[k:]
                return
            if t in scope:
                return

    def features(self) -> np.ndarray:
        n = len(self.tag)
        x = np.zeros((n, N_FEATURES), np.float32)
        own, stops, words = np.zeros(n), np.zeros(n), np.zeros(n)
        for e, t in self.pieces:
            if t is not None and not t.isspace():
                own[e] += len(t)
                stops[e] += t.count(".") + t.count(",")
                words[e] += t.count(" ") + 1
        parent = self.parent
        depth, index = np.zeros(n), np.zeros(n)
        kids, count = np.zeros(n), np.ones(n)
        total, linked = own.copy(), np.zeros(n)
        all_stops, all_words = stops.copy(), words.copy()
        paragraphs, items = np.zeros(n), np.zeros(n)
        for e in range(n - 1, 0, -1):
            p, t = parent[e], self.tag[e]
            if t == "a":
                linked[e] = total[e]
            paragraphs[e] += t == "p"
            items[e] += t == "li"
            for a in (total, linked, count, all_stops, all_words, paragraphs, items):
                a[p] += a[e]
        x[0, TAG_KIND["#"]] = 1
        c = 2 * N_TAGS + 2 * N_KINDS
        for e in range(1, n):
            p = parent[e]
            depth[e], index[e] = depth[p] + 1, kids[p]
            kids[p] += 1
            t = TAG_KIND.get(self.tag[e], N_TAGS - 1)
            x[e, t] = 1
            x[e, N_TAGS : 2 * N_TAGS] = np.maximum(x[p, N_TAGS : 2 * N_TAGS], x[p, :N_TAGS])
            b = 2 * N_TAGS
            for k in self.kinds[e]:
                x[e, b + k] = 1
            x[e, b + N_KINDS : b + 2 * N_KINDS] = np.maximum(x[p, b + N_KINDS : b + 2 * N_KINDS], x[p, b : b + N_KINDS])
            for k in self.hashed[e]:
                x[e, c + k] = 1
        up = np.array(parent)
        up[0] = 0
        b = 2 * N_TAGS + 2 * N_KINDS + HASHED
        page = max(total[0], 1)
        cols = (own, total, linked / np.maximum(total, 1), all_stops / np.maximum(all_words, 1), all_words, count, kids, depth, index, index / np.maximum(kids[up], 1), kids[up], total / page, total[up] / page, total / np.maximum(total[up], 1), total / count, linked[up] / np.maximum(total[up], 1), paragraphs, paragraphs[up], items, all_stops, own / np.maximum(total, 1), total[up] / np.maximum(kids[up], 1))
        x[:, b:] = np.stack(cols, 1)
        return x

    def text(self, kept: np.ndarray) -> str:
        return " ".join("".join(" " if t is None else t if kept[e] else "" for e, t in self.pieces).split())


class Boosted:
    """Second-order gradient boosting for the logistic loss, trees grown level by level on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 110, depth: int = 5, rate: float = 0.15, bins: int = 32, least: float = 8.0, some: int = 32, seed: int = 11):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        mean = y.mean()
        self.start, self.depth = float(np.log(mean / (1 - mean))), depth
        self.trees = []
        z = np.full(len(y), self.start)
        n, nf, rng = len(x), some, np.random.default_rng(seed)
        for _ in range(rounds):
            names = rng.choice(x.shape[1], some, replace=False)  # the features that this tree may use
            flat = b[:, names].astype(np.int64) + np.arange(nf)[None] * bins
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            g_each, h_each = np.repeat(g, nf), np.repeat(h, nf)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.uint8)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (nf * bins) + flat).reshape(-1)
                G = np.bincount(key, g_each, width * nf * bins).reshape(width, nf, bins)
                H = np.bincount(key, h_each, width * nf * bins).reshape(width, nf, bins)
                GL, HL = G.cumsum(2), H.cumsum(2)
                GT, HT = GL[:, :, -1:], HL[:, :, -1:]
                gain = GL**2 / (HL + 1) + (GT - GL) ** 2 / (HT - HL + 1) - GT**2 / (HT + 1)
                gain[(HL < least / 8) | (HT - HL < least / 8)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1).max(1) > 1e-6
                feature[first : first + width] = names[best // bins]
                cut[first : first + width] = np.where(good, best % bins, 255)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            z += value[leaf]

    def binned(self, x: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Bins of all features, or of some (0 for the others)."""
        out = np.zeros(x.shape, np.uint8)
        for f in range(x.shape[1]) if only is None else only:
            out[:, f] = np.searchsorted(self.edges[f], x[:, f], "left")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x, np.unique(np.concatenate([f[c < 255] for f, c, _ in self.trees]))), np.arange(len(x))
        z = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            z += value[node - (2**self.depth - 1)]
        return z


def decode(parent: list[int], z: np.ndarray, start: float = 1.0) -> np.ndarray:
    """Which elements' own text is main. States: 0 before the article, 1 in it, 2 cut out of it; a child
    of 0 is 0 or 1, of 1 is 1 or 2, of 2 is 2. Beginning an article costs `start`, but at the root."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    s0, s1, s2 = no.copy(), yes.copy(), no.copy()
    for e in range(n - 1, 0, -1):
        p = parent[e]
        s0[p] += max(s0[e], s1[e] - start)
        s1[p] += max(s1[e], s2[e])
        s2[p] += s2[e]
    state = np.zeros(n, np.int8)
    state[0] = s1[0] > s0[0]
    for e in range(1, n):
        p = state[parent[e]]
        state[e] = (1 if s1[e] - start > s0[e] else 0) if p == 0 else (1 if s1[e] >= s2[e] else 2) if p == 1 else 2
    return state == 1


def training_pages(n: int, seed: int = 20240601) -> Iterator[str]:
    """Made pages; main text is marked by \\x01 before each main word."""
    rng = np.random.default_rng(seed)
    syllables = ["".join(s) for s in zip(rng.choice(list("bcdfglmnprstvz"), 40), rng.choice(list("aeiouäéü"), 40), rng.choice(["", "n", "r", "s", "t"], 40), strict=True)]
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p

    def words(k: int, main: bool = False) -> str:
        out = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(max(1, k))]
        out = [w + ("," if chance(0.07) else "." if chance(0.1) else "") for w in out]
        if chance(0.08):
            out = [w + pick("!!", "&amp;&amp;", "###", " |") for w in out]
        out[0] = out[0].capitalize()
        return " ".join(("\x01" if main else "") + w for w in out) + pick(".", "", ".")

    def menu(k: int) -> str:
        if chance(0.7):
            return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.integers(1, 4))}</a>' + pick("</li>", "</li>", "") for i in range(k)) + "</ul>"
        return pick(" | ", " ").join(f'<a href="/{i}">{words(rng.integers(1, 4))}</a>' for i in range(k))

    def junk(kind: str) -> str:
        k = int(rng.integers(1, 30))
        if kind == "nav":
            body = menu(int(rng.integers(2, 12)))
            return pick(f"<nav>{body}</nav>", f'<div class="{pick("nav", "menu", "main-nav", "breadcrumb")}">{body}</div>')
        if kind == "header":
            return pick("<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead">{}</div>').format(pick(f"<h1>{words(3)}</h1>", f"<a href='/'>{words(2)}</a>", f"<p>{words(6)}</p>") + (menu(4) if chance(0.4) else ""))
        if kind == "footer":
            body = pick(f"<p>{words(k)}</p>", f"&copy; {words(k)}", f"{menu(5)}<p>{words(k)}</p>")
            return pick(f"<footer>{body}</footer>", f'<div class="{pick("footer", "copyright", "site-footer")}">{body}</div>')
        if kind == "side":
            body = f"<h3>{words(2)}</h3>" + pick(menu(5), f"<p>{words(k)}</p>", f"<p>{words(k)}</p><p>{words(k)}</p>")
            return pick(f"<aside>{body}</aside>", f'<div class="{pick("sidebar", "widget", "related-posts", "trending")}">{body}</div>')
        if kind == "ad":
            return f'<div class="{pick("ad", "ads", "advert", "sponsored", "ad-slot", "promo")}">{pick(words(k), f"<p>{words(k)}</p>", f"<a href=/x>{words(k)}</a>")}</div>'
        if kind == "notice":
            return f'<div {pick("class", "id")}="{pick("cookie-banner", "notice", "alert", "newsletter-signup", "consent", "modal")}"><p>{words(k)}</p>{pick("", "<button>" + words(1) + "</button>")}</div>'
        if kind == "form":
            return f"<form><label>{words(2)}</label><input name=q>{pick('', f'<p>{words(8)}</p>')}<button>{words(1)}</button></form>"
        if kind == "comments":
            one = lambda: f'<{(t := pick("div", "li"))} class="comment"><b>{words(1)}</b><p>{words(int(rng.integers(2, 50)))}</p></{t}>'
            body = "".join(one() for _ in range(rng.integers(1, 6)))
            return pick(f'<section id="comments"><h2>{words(2)}</h2>{body}</section>', f'<div class="comments">{body}</div>')
        return f'<div class="{pick("share", "social", "tags")}">{menu(4)}</div>'

    def odd() -> str:
        """An attribute that tells nothing, or none."""
        return pick("", "", f' class="{words(1).strip(".,!#&;| ").lower()}-{rng.integers(90)}"', f' id="x{rng.integers(900)}"')

    def paragraph() -> str:
        k = int(pick(rng.integers(1, 5), rng.integers(5, 40), rng.integers(20, 120)))
        t = words(k, True)
        if chance(0.15):
            t = f"<{(g := pick('b', 'em', 'span', 'a href=/y'))}>{words(3, True)}</{g.split()[0]}> {t}"
        return pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<div>{t}</div>", f"<h2>{words(4, True)}</h2><p>{t}</p>", f"<ul><li>{t}</li><li>{words(9, True)}</li></ul>", f"<blockquote>{t}</blockquote>", f"{t}<br><br>", f"<table><tr><td>{t}<td>{words(2, True)}</table>", f"<p>{t} <math><mi>{words(1, True)}</mi><mo>+</mo></math></p>", f"<figure><img src=a><figcaption>{t}</figcaption></figure>", f"<section{odd()}><h3>{words(3, True)}</h3><p>{t}</p></section>")

    for _ in range(n):
        parts = [paragraph() for _ in range(int(pick(rng.integers(1, 3), rng.integers(2, 9), rng.integers(6, 24))))]
        if chance(0.2):  # next to nothing: a heading and what it repeats
            t = words(int(rng.integers(1, 8)), True)
            parts = [f"<h1>{t}</h1><p>{pick('', '<b>')}{t}</p>"]
        elif chance(0.8):
            parts.insert(0, f"<h1>{words(int(rng.integers(1, 14)), True)}</h1>")
        for kind in ("ad", "side", "share", "notice", "form", "comments", "footer", "nav"):
            if chance(0.12):
                parts.insert(int(rng.integers(len(parts) + 1)), junk(kind))
        body = "".join(parts)
        if chance(0.06):  # bare text
            parts = [words(int(rng.integers(3, 90)), True) + pick("", "<br>") for _ in parts]
            body = " ".join(parts)
        main = pick(
            "<article{1}>{0}</article>", "<article>{0}</article>", "<main{1}>{0}</main>", "<main><article>{0}</article></main>", '<div class="content">{0}</div>', '<div id="main-content"><div class="post">{0}</div></div>', '<div class="entry-content">{0}</div>',
            "<div>{0}</div>", "<div{1}>{0}</div>", "<div{1}><div{1}>{0}</div></div>", '<section class="article-body">{0}</section>', "<section{1}>{0}</section>", "{0}", "{0}", "<table><tr><td{1}>{0}</td></tr></table>", "<center>{0}</center>",
        ).format(body, odd())
        before = "".join(junk(k) for k in ("header", "nav", "notice", "ad", "form", "side") if chance(0.45))
        after = "".join(junk(k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer") if chance(0.4))
        page = f"{before}{main}{after}"
        if chance(0.3):
            page = f'<div class="{pick("wrapper", "page", "container")}">{page}</div>'
        if chance(0.15):
            page = body if chance(0.5) else page  # nothing but the article, maybe without html and body
            yield pick(page, f"<body>{page}", f"<html><body>{page}</body></html>")
            continue
        yield f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{}}</style></head><body{odd()}>{page}</body></html>"


@lru_cache(maxsize=1)
def model() -> Boosted:
    xs, ys = [], []
    for text in training_pages(PAGES):
        page = Page(text)
        n = len(page.tag)
        main, rest = np.zeros(n), np.zeros(n)
        clean = []
        for e, t in page.pieces:
            if t is not None and t.strip():
                (main if "\x01" in t else rest)[e] += len(t.strip())
            clean.append((e, t.replace("\x01", "") if t is not None else None))
        page.pieces = clean
        for e in range(n - 1, 0, -1):
            main[page.parent[e]] += main[e]
            rest[page.parent[e]] += rest[e]
        told = np.flatnonzero(main + rest > 0)
        xs.append(page.features()[told])
        # A container that holds the article and some parts to be cut out is main if most of it is.
        ys.append(((main - 4 * rest > 0) | (rest == 0))[told])
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_text(pages: list[str], m: Boosted) -> list[str]:
    parsed = [Page(p) for p in pages]
    size = [len(p.tag) for p in parsed]
    z = m.log_odds(np.concatenate([p.features() for p in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for p, n in zip(parsed, size, strict=True):
        out.append(p.text(decode(p.parent, z[at : at + n])))
        at += n
    return out


def _extract(m: Boosted):
    @tx.sliced
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                text = extract_text([t or "" for t in part["html"].to_pylist()], m)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return go


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship(pages.sparkSession)
    d = columns_of(pages, page_id="long", url="string", html="string")
    return d.mapInArrow(_extract(model()), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
