"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of its block elements (and of inline elements with a
telling attribute); scripts, styles, titles and text fields are left out when
it is read. Every node has features of its subtree (text, links, tags, marks),
its attributes and those above it, its depth and its siblings. Gradient-boosted
trees give each node the log-odds of belonging to the article. Decoding picks
the labels of highest total under the rule that nothing below a rejected node
is kept, so no choice contradicts the one above it. Kept text is joined block by
block.

There are no hand-made labels: training takes a bounded sample of pages
(``Boosting.pages``), labels nodes by the meaning of their tags and
attribute words, and adds pages put together from the sample's paragraphs with
known menus, notices, adverts, forms and comments, some without any telling
attribute, so that structure is learned beside words.

Null html counts as empty: no text. Cut-off and wrongly nested pages are read as
far as they go, an unclosed comment, script or style hides the rest. Rows are
independent; repeated rows repeat; other columns are passed through, and the
added ``text`` and ``n_chars`` win over columns of the same name.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.llm.common import as_text, chunked

#: Elements whose content is no markup; a title closed in itself, as SVG has it, is empty.
_RAW = r"script|style|textarea|title(?!\s*/>)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|</?[a-z][^>]*>?|([^<]+|<)",
    re.I | re.S,
)
_ATTR = re.compile(r"(class|id|role|aria-label|aria-hidden|style|hidden|data-y|type)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
BLOCK = frozenset(
    "html body div p article main section header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary center hr dialog menu head".split()
)
VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
#: A start tag of the key ends an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDERS = frozenset("ul ol dl table div section article main body".split())
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert warning popup modal comment comments reply replies discussion disqus share sharing social related recommended newsletter subscribe signup login "
    "search breadcrumb breadcrumbs pagination pager widget toolbar copyright disclaimer form complementary contentinfo navigation dialog".split()
)
ARTICLE = frozenset("article content main post entry story body text blog articlebody prose".split())
NOT_TAGS = frozenset("nav header footer aside form menu dialog head fieldset".split())
ART_TAGS = frozenset(("article", "main"))
#: Elements that hold the article or the page: a word in their names tells of the site, not of what they are.
WHOLE = frozenset("html body article main".split())
#: Inline elements that tell against the article by their name.
FURNITURE = frozenset("select datalist noscript template iframe canvas object audio video".split())
_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "dl": 4, "table": 5, "tr": 5, "td": 6, "th": 6, "div": 7, "section": 7, "article": 8, "main": 8, "nav": 9, "header": 10, "footer": 11, "aside": 12, "form": 13, "blockquote": 14, "pre": 14, "body": 15, "html": 15}


class Page:
    """Nodes of a page in reading order, as lists; text pieces as (node, block, text)."""

    def __init__(self, source: str, labelled: bool = False):
        """``labelled``: a composed page, whose data-y attributes are its truth."""
        self.labelled = labelled
        self.tag: list[str] = ["#page"]
        self.parent, self.depth, self.end = [0], [0], [0]
        self.bad, self.good, self.label = [0], [0], [-1]
        self.chars, self.link, self.marks, self.tags, self.inputs = [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]
        at, block, anchors = 0, 0, 0
        opened: Counter[str] = Counter()

        def cut(depth: int) -> None:
            opened.subtract(t for t, _ in stack[depth:])
            del stack[depth:]

        for m in _TOKEN.finditer(source):
            text = m[5]
            if text is not None:
                self.pieces.append((at, block, text))
                k = len(text)
                self.chars[at] += k
                self.marks[at] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
                if anchors:
                    self.link[at] += k
                continue
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                if opened[tag] <= 0:
                    continue
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                anchors -= sum(t == "a" for t, _ in stack[depth:])
                if tag in BLOCK or any(t in BLOCK for t, _ in stack[depth:]):
                    block += 1
                cut(depth)
                now = stack[-1][1]
                while at != now:
                    self.end[at] = len(self.tag)
                    at = self.parent[at]
                continue
            self.tags[at] += 1
            if tag in VOID:
                if tag == "br":
                    self.pieces.append((at, block, " "))
                elif tag == "hr":
                    block += 1
                elif tag == "input":
                    self.inputs[at] += 1
                continue
            is_block = tag in BLOCK
            if is_block:
                block += 1
                closing = CLOSES.get(tag)
                depth = len(stack) - 1
                while depth:
                    name = stack[depth][0]
                    if name == "p" or closing and name in closing:
                        break
                    if name in HOLDERS or name in BLOCK and not closing:
                        depth = 0
                        break
                    depth -= 1
                if depth:
                    anchors -= sum(t == "a" for t, _ in stack[depth:])
                    cut(depth)
                    now = stack[-1][1]
                    while at != now:
                        self.end[at] = len(self.tag)
                        at = self.parent[at]
            if tag == "option":
                self.pieces.append((at, block, " "))
            bad, good = int(tag in FURNITURE), 0
            label = -1
            attrs = m[4]
            if attrs and not attrs.isspace():
                for a in _ATTR.finditer(attrs):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name == "data-y":
                        label = int(value == "1") if self.labelled else -1
                    elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                        bad += 1
                    elif name in ("class", "id", "role", "aria-label"):
                        for w in _SPLIT.split(value):
                            w = w.lower()
                            bad += w in NOT_ARTICLE and tag not in WHOLE
                            good += w in ARTICLE
            if is_block or bad or good:
                here = len(self.tag)
                self.tag.append(tag)
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                self.end.append(0)
                self.bad.append(bad)
                self.good.append(good)
                self.label.append(label)
                for x in (self.chars, self.link, self.marks, self.tags, self.inputs):
                    x.append(0)
                at = here
            if attrs.endswith("/") and not is_block:
                if at != stack[-1][1]:
                    self.end[at] = len(self.tag)
                    at = stack[-1][1]
                continue
            anchors += tag == "a"
            stack.append((tag, at))
            opened[tag] += 1
        n = len(self.tag)
        while at:
            self.end[at] = n
            at = self.parent[at]
        self.end[0] = n

    def text(self, keep: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if keep[node]:
                blocks.setdefault(block, []).append(text)
        out = []
        for parts in blocks.values():
            whole = "".join(parts)
            line = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
            if line:
                out.append(line)
        return "\n".join(out)


class Nodes:
    """Arrays over the nodes of many pages."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        base = np.repeat(self.start[:-1], sizes)
        cat = lambda name: np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, int(sizes.sum()))
        self.parent, self.end, self.depth = cat("parent") + base, cat("end") + base, cat("depth")
        by_depth = np.argsort(self.depth, kind="stable")
        #: Nodes of each depth, from 1 down.
        self.levels = np.split(by_depth, np.cumsum(np.bincount(self.depth))[:-1])[1:] if len(by_depth) else []
        self.label = cat("label")
        self.tags = [t for p in pages for t in p.tag]
        kind = np.array([_KINDS.get(t, 0) for t in self.tags], np.int64)
        self.not_tag = np.array([t in NOT_TAGS for t in self.tags], np.int64)
        self.art_tag = np.array([t in ART_TAGS for t in self.tags], np.int64)
        self.bad, self.good = cat("bad"), cat("good")
        n = len(kind)
        index = np.arange(n)
        root = index == self.parent
        below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[self.end] - s[index]
        chars, link, marks, tags, inputs = (cat(x) for x in ("chars", "link", "marks", "tags", "inputs"))
        all_chars, all_link, all_marks, all_tags, all_inputs = map(below, (chars, link, marks, tags, inputs))
        bad_all, good_all = self.bad + self.not_tag, self.good + self.art_tag
        over_bad, over_good = np.zeros(n), np.zeros(n)
        for at in self.levels:
            up = self.parent[at]
            over_bad[at] = over_bad[up] + (bad_all[up] > 0)
            over_good[at] = over_good[up] + (good_all[up] > 0)
        siblings = np.bincount(self.parent[~root], minlength=n)[self.parent]
        pair = self.parent * 16 + kind
        _, inv, count = np.unique(pair, return_inverse=True, return_counts=True)
        page_chars, page_nodes = all_chars[base], np.repeat(sizes, sizes)
        mean_sib = np.where(siblings > 0, (all_chars[self.parent] - chars[self.parent]) / np.maximum(siblings, 1), 0)
        log = lambda x: np.log1p(np.maximum(x, 0))
        self.x = np.stack(
            [
                self.depth, log(chars), log(all_chars), all_link / (all_chars + 1), 100 * all_tags / (all_chars + 10), 100 * all_marks / (all_chars + 10), all_inputs,
                self.bad, self.good, self.not_tag, self.art_tag, over_bad, over_good, kind, siblings, count[inv] / np.maximum(siblings, 1),
                (index - base) / page_nodes, all_chars / (page_chars + 1), all_chars / (all_chars[self.parent] + 1), log(mean_sib), below(bad_all) / (self.end - index), below(good_all) > 0,
                link / (chars + 1),
            ],
            1,
        ).astype(np.float32)
        self.weight = 1 + log(chars)
        self.root = root

    def taught(self) -> np.ndarray:
        """Labels: a given one, else by tag and attribute words, else as above; what holds an article part is kept."""
        own = np.where(self.label >= 0, self.label, np.where((self.bad + self.not_tag) > 0, 0, np.where((self.good + self.art_tag) > 0, 1, -1)))
        out = np.zeros(len(own), np.int64)
        for at in self.levels:
            up = out[self.parent[at]]
            out[at] = np.where(own[at] == 0, 0, np.where(own[at] == 1, 1, up))
            out[at[(own[self.parent[at]] == 0) & (up == 0) & ~self.root[self.parent[at]]]] = 0
        holds = out > 0
        for level in reversed(self.levels):
            at = level[holds[level]]
            up = self.parent[at]
            holds[up[own[up] != 0]] = True
        return holds.astype(np.int64)

    def decoded(self, odds: np.ndarray) -> np.ndarray:
        """Kept nodes: the best total of log-odds with nothing kept under a rejected node."""
        gain = np.where(self.root, 0.0, odds) * self.weight
        keep, drop = gain.copy(), -gain
        for at in reversed(self.levels):
            np.add.at(keep, self.parent[at], np.maximum(keep[at], drop[at]))
            np.add.at(drop, self.parent[at], drop[at])
        out = self.root.copy()
        for at in self.levels:
            out[at] = out[self.parent[at]] & (keep[at] > drop[at])
        return out


@dataclass(frozen=True)
class Boosting:
    pages: int = 300
    trees: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0


class Trees:
    """Gradient-boosted trees of fixed depth over binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Boosting):
        self.depth = how.depth
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, how.bins)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), self.base)
        inner, leaves = (1 << how.depth) - 1, 1 << how.depth
        self.feature, self.cut, self.leaf = (np.zeros((how.trees, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (leaves, np.float64)))
        for t in range(how.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            for d in range(how.depth):
                first, k = (1 << d) - 1, 1 << d
                best = np.full(k, -np.inf)
                for f in range(x.shape[1]):
                    cell = node * how.bins + b[:, f]
                    gs = np.bincount(cell, g, k * how.bins).reshape(k, -1).cumsum(1)
                    hs = np.bincount(cell, h, k * how.bins).reshape(k, -1).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + how.ridge) + (gt - gl) ** 2 / (ht - hl + how.ridge) - gt**2 / (ht + how.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    win = top > best + 1e-12
                    best[win], self.feature[t, first : first + k][win], self.cut[t, first : first + k][win] = top[win], f, at[win]
                node = node * 2 + (b[np.arange(len(y)), self.feature[t, first + node]] > self.cut[t, first + node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.leaf[t] = -how.rate * gs / (hs + how.ridge)
            score += self.leaf[t][node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = node * 2 + (b[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def composed(paragraphs: list[list[str]], n: int, seed: int = 11) -> list[str]:
    """Pages put together from given paragraphs, with known parts around and inside the article."""
    rng = random.Random(seed)
    short = lambda k: " ".join(rng.choice(rng.choice(paragraphs)).split()[:k])
    esc = entities.escape

    def part(word: str, body: str) -> str:
        tag = {"nav": "nav", "footer": "footer", "header": "header", "sidebar": "aside", "form": "form"}.get(word, "div")
        shape = rng.random()
        if shape < 0.25 and tag != "div":
            return f'<{tag} data-y="0">{body}</{tag}>'
        if shape >= 0.9:
            return f'<div data-y="0">{body}</div>'
        tag, name = rng.choice([tag, "div", "section"]), rng.choice([word, f"{word}-box", f"site-{word}", f"{word}_1"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}" data-y="0">{body}</{tag}>'

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{esc(short(rng.randint(1, 3)))}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"

    bodies = {
        "nav": links, "header": lambda: f"<div>{esc(short(4))}</div>" + links(), "footer": lambda: f"&copy; {esc(short(8))}", "sidebar": lambda: f"<h3>{esc(short(3))}</h3>" + links() + f"<p>{esc(short(12))}</p>",
        "notice": lambda: f"<p>{esc(short(14))}</p><button>OK</button>", "cookie": lambda: f"{esc(short(20))} <a href='#'>OK</a>", "advert": lambda: f"<p>{esc(short(15))}</p>", "ad": lambda: esc(short(10)), "sponsored": lambda: f"<p>{esc(short(18))}</p>",
        "form": lambda: f"<label>{esc(short(3))}</label><input name=q><input type=submit>", "newsletter": lambda: f"<form><p>{esc(short(9))}</p><input></form>", "related": links, "share": links,
        "comments": lambda: f"<h3>{esc(short(2))}</h3>" + "".join(f'<div class="comment"><p>{esc(short(rng.randint(5, 40)))}</p></div>' for _ in range(rng.randint(1, 5))), "breadcrumb": lambda: f"<a href='/'>{esc(short(1))}</a> / {esc(short(2))}",
    }
    out = []
    for _ in range(n):
        paras = [esc(p) for p in rng.choice(paragraphs)] or [esc(short(30))]
        paras = [" ".join(p.split()[: rng.randint(1, 12)]) if rng.random() < 0.2 else p for p in paras[: rng.randint(1, 12)]]
        inner = [f"<h1>{' '.join(paras[0].split()[: rng.randint(1, 8)])}</h1>", *(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(p) for p in paras)]
        for w in rng.sample(list(bodies), rng.randint(0, 2)):
            inner.insert(rng.randint(1, len(inner)), part(w, bodies[w]()))
        wrap = rng.choice(["<article{}>{}</article>", "<main{}>{}</main>", '<div class="content"{}>{}</div>', '<div class="post-body"{}>{}</div>', '<div id="main"{}>{}</div>', "<div{}>{}</div>", "<article{}>{}"])
        before = "".join(part(w, bodies[w]()) for w in rng.sample(["nav", "header", "notice", "cookie", "ad", "advert", "breadcrumb", "form"], rng.randint(1, 4)))
        after = "".join(part(w, bodies[w]()) for w in rng.sample(["footer", "comments", "related", "sidebar", "share", "newsletter", "sponsored", "ad"], rng.randint(1, 4)))
        out.append(f"<html><head><title>x</title></head><body>{before}{wrap.format(' data-y="1"', ''.join(inner))}{after}</body></html>")
    return out


def train(df: DataFrame, how: Boosting = Boosting(), html: str = "html") -> Trees:
    """Trees fitted on ``how.pages`` pages of ``df``, taken in the order of their digests, and as many composed ones."""
    digest = F.xxhash64("html")
    rows = df.select(F.col(html).alias("html")).filter("html IS NOT NULL")
    # Digests alone are ordered; only the pages drawn are fetched.
    last = rows.select(digest.alias("d")).distinct().orderBy("d").limit(how.pages).agg(F.max("d")).first()[0]
    drawn = rows.filter(digest <= last).withColumn("d", digest).dropDuplicates(["d"]).orderBy("d").limit(how.pages).collect() if last is not None else []
    pages = [Page(r["html"]) for r in drawn]
    paragraphs = [x for x in ([line for line in p.text(np.ones(len(p.tag), bool)).split("\n") if len(line) > 40] for p in pages) if x]
    pages += [Page(x, labelled=True) for x in composed(paragraphs or [["One sentence of text, long enough to be read as a paragraph."]], max(how.pages, 50))]
    nodes = Nodes(pages)
    use = ~nodes.root
    return Trees(nodes.x[use], nodes.taught()[use], how)


def texts_of(sources: list[str | None], trees: Trees) -> list[str]:
    """Main texts of whole pages."""
    pages = [Page(s or "") for s in sources]
    nodes = Nodes(pages)
    keep = nodes.decoded(trees.log_odds(nodes.x))
    return [p.text(keep[a:b]) for p, a, b in zip(pages, nodes.start[:-1], nodes.start[1:], strict=True)]


def extracted(df: DataFrame, trees: Trees, html: str = "html") -> DataFrame:
    """``df`` without its html, with text and n_chars (code points)."""
    kept = [c for c in df.columns if c not in ("text", "n_chars", html)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(trees)  # a few thousand numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sources = [as_text(x) for x in b[html]]
            for lo, hi in chunked(sources):
                out = b.iloc[lo:hi][kept].copy()
                out["text"] = texts_of(sources[lo:hi], shared.value)
                out["n_chars"] = out["text"].map(len)
                yield out

    return df.select(*kept, html).mapInPandas(run, schema)
