"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements whose leaves are blocks of text. Every node is content or not; parent-child
potentials tie neighbours, and each node's words (tag, class and id words, size and link share of a block)
weigh its label. Messages passed from the leaves to the root and back (sum-product) give every block's marginal;
blocks above one half are the text. Potentials are counted from labelled pages: those that ``labelled_pages``
builds from templates (a bounded number, seeded), or any that the caller labels.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
two newlines. A tag ends at the next ``>`` outside a value that a quote opened right after ``=``. Null and empty pages give an empty
text; other null columns pass through; rows that repeat are read alike; ids may be of any type; an empty table gives
an empty result. Nothing is dropped or capped, however long or deep a page is: what elements pass on to the blocks
below is summed up on one walk down the tree, so time grows with the page alone.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.arrays import pieces

# How HTML's elements nest.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("button script style noscript template svg iframe title canvas audio video select".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img object".split())
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace semantics annotation".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select", "div", "section", "article", "aside", "nav", "form", "blockquote", "body"}

SECTIONS = set("article aside details dialog footer form header main nav section table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element, or a block of text where ``text`` is set; ``names`` are what the blocks below an element inherit."""

    parent: int
    features: list[str]
    text: str | None = None
    linked: int = 0
    names: tuple[str, ...] = ()


def tree_of(page: str) -> list[Node]:
    """The page's nodes, parents before children, blocks in page order."""
    nodes = [Node(-1, ["tag=root"])]
    stack: list[tuple[str, int]] = [("root", 0)]  # inline elements keep their block's node
    open_ = Counter()  # tags on the stack
    run: list[tuple[str, bool]] = []
    at = 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            linked = sum(len(t.strip()) for t, link in run if link)
            owner = stack[-1][1]
            share = linked / max(1, len(text))
            size = f"len={min(6, int(math.log2(len(text.split()) + 1)))}"
            end = "ends" if text[-1:] in ".!?\"”»…" else "open"
            nodes.append(Node(owner, ["block", size, f"links={min(3, int(share * 4))}", f"end={end}", *(["sign"] if text[0] in "©|»›" else [])], text, linked))
        run.clear()

    def cut(upto: int) -> None:
        open_.subtract(t for t, _ in stack[upto:])
        del stack[upto:]

    def last(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if open_[tag] > 0 else 0

    linked = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            run.append((html.unescape(page[at : m.start()]), linked > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = 0
            if tag in INLINE:
                continue
            flush()
            if k := last(tag):
                cut(k)
            continue
        if tag == "head":  # it ends where something comes that can't stand in it, and what can is hidden by itself
            continue
        if tag in INLINE:
            if tag == "br":
                run.append((" ", linked > 0))
            elif tag == "a":
                linked = 1
            continue
        if tag in HIDDEN:
            flush()
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>|$", re.I).search(page, at)
                at = stop.end()
            continue
        flush()
        if tag in CLOSES_P:
            k = last("p")
            if k and not any(t in HOLDS for t, _ in stack[k + 1 :]):
                cut(k)
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    cut(i)
                    break
                if stack[i][0] in HOLDS:
                    break
        if tag in VOID:
            continue
        found = [f"tag={tag}"]
        for name in _ATTRIBUTE.findall(m[3] or ""):
            found += [f"name={w}" for w in dict.fromkeys(_NAME.findall((name[1] or name[2] or name[3]).lower()))]
        if re.search(r"\bhidden\b|display\s*:\s*none", m[3] or "", re.I):
            found.append("unseen")
        nodes.append(Node(stack[-1][1], found))
        stack.append((tag, len(nodes) - 1))
        open_[tag] += 1
    if at < len(page):
        run.append((html.unescape(page[at:]), linked > 0))
    flush()
    return _described(nodes)


def _described(nodes: list[Node]) -> list[Node]:
    """The nodes with how much of the text below an element is links, and with what their blocks inherit."""
    size, links = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if x.text is not None:
            size[i], links[i] = len(x.text), min(x.linked, len(x.text))
        size[x.parent] += size[i]
        links[x.parent] += links[i]
    for i, x in enumerate(nodes):
        if x.text is None:
            x.names = tuple(dict.fromkeys(f"in {f}" for f in x.features if f.startswith("name=") or f[4:] in SECTIONS and f.startswith("tag=")))
            x.features[0] += f" links={min(3, links[i] * 4 // max(1, size[i]))}"  # one feature: tags and links go together
    return nodes


def inherited(nodes: list[Node]) -> Iterator[tuple[int, Counter]]:
    """Each block with the names of all elements above it, in the time of one walk; the names are good until the next."""
    names: Counter = Counter()
    path: list[int] = []
    for i, x in enumerate(nodes):
        while path and path[-1] != x.parent:
            names.subtract(nodes[path.pop()].names)
        if x.text is None:
            path.append(i)
            names.update(x.names)
        else:
            yield i, names


def described(nodes: list[Node]) -> list[list[str]]:
    """All features of every node."""
    out = [list(x.features) for x in nodes]
    for i, names in inherited(nodes):
        out[i] += [f for f, n in names.items() if n > 0]
    return out


# --- labelled pages ------------------------------------------------------------------------------------

# Names that parts of pages go by.
CONTENT_NAMES = ["article", "content", "main", "post", "entry", "body", "story", "text", "article-body", "entry-content", "post-content", "page", "single", "prose"]
WRAP_NAMES = ["wrapper", "container", "row", "col", "layout", "page", "site", "inner", "grid", "root", "app", "outer"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "topnav", "toc", "skip"],
    "header": ["header", "masthead", "top", "branding", "logo", "topbar", "site-header", "byline", "meta"],
    "footer": ["footer", "bottom", "copyright", "legal", "site-footer", "colophon", "credits", "imprint"],
    "aside": ["sidebar", "aside", "side", "widget", "related", "rail", "recommended", "more", "popular", "trending", "tags", "author-box"],
    "div": ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "social", "sharing", "follow", "gdpr", "privacy", "warning", "message", "teaser", "boilerplate"],
    "form": ["form", "search", "login", "contact", "newsletter", "subscribe", "signup", "feedback"],
    "section": ["comments", "comment", "comment-list", "reply", "replies", "respond", "discussion", "disqus", "reviews", "responses", "thread", "related", "notice"],
}
TRAIN_PAGES = 1500


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 5) -> Iterator[tuple[str, list[bool]]]:
    """Pages built from templates, with the label of each block in page order."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bcdfglmnprstv") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))

    def words(low: int, high: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(draw.randint(low, high))).capitalize() + stop

    def content(low: int, high: int, stop: str = ".", whole: float = 0.14) -> str:
        """Words of which some, or all, may be a link."""
        text, chance = words(low, high, stop), draw.random()
        if chance < whole:
            return f'<a href="/x">{text}</a>'
        if chance < whole + 0.2:
            return f'{words(1, 8, "")} <a href="/x">{words(1, 5, "")}</a> {text}'
        return text

    def named(names: list[str], often: float = 0.8) -> str:
        if draw.random() > often:
            return ""
        n = draw.choice(names)
        if draw.random() < 0.3:
            n += draw.choice(["-1", " left", " box", "-area", " block", " wide", "_2"])
        return f' {draw.choice(["class", "class", "id"])}="{n}"'

    for _ in range(count):
        out: list[str] = []
        labels: list[bool] = []

        def block(tag: str, text: str, content: bool, out=out, labels=labels) -> None:
            out.append(f"<{tag}>{text}</{tag}>")
            labels.append(content)

        def other(kind: str, out=out, labels=labels, block=block) -> None:
            tag = kind if draw.random() < 0.65 and kind != "div" else draw.choice(["div", "section", "aside"] if kind != "div" else ["div", "div", "aside", "section"])
            out.append(f"<{tag}{named(OTHER_NAMES[kind], 0.6 if tag == kind and kind != 'div' and kind != 'section' else 1.0)}>")
            if kind in ("nav", "aside") and draw.random() < 0.7:
                out.append("<ul>")
                for _ in range(draw.randint(2, 8)):
                    block("li", f'<a href="/x">{words(1, 5, "")}</a>', False)
                out.append("</ul>")
            elif kind == "section":
                for _ in range(draw.randint(1, 4)):
                    block("p", words(3, 60), False)
            elif kind == "form":
                block(draw.choice(["label", "p"]) if 0 else "p", words(1, 6, ":"), False)
            elif kind == "footer":
                out.append(f"&copy; {words(2, 14)}")
                labels.append(False)
            elif draw.random() < 0.5:
                out.append(words(2, 30))
                labels.append(False)
            else:
                for _ in range(draw.randint(1, 3)):
                    block(draw.choice(["p", "h3", "div"]), words(2, 30), False)
            out.append(f"</{tag}>")

        deep = draw.randint(0, 2)
        for _ in range(deep):
            out.append(f"<div{named(WRAP_NAMES)}>")
        for kind in ("header", "nav", "div"):
            if draw.random() < 0.7:
                other(kind)
        if draw.random() < 0.3:
            other("aside")
        outer = draw.random() < 0.4
        if outer:
            out.append(f"<{draw.choice(['main', 'div'])}{named(WRAP_NAMES + CONTENT_NAMES)}>")
        tag = draw.choice(["article", "article", "article", "main", "div", "div", "section"])
        out.append(f"<{tag}{named(CONTENT_NAMES, 0.4 if tag in ('article', 'main') else 1.0)}>")
        if draw.random() < 0.25:
            other("header")
        if draw.random() < 0.75:
            block("h1", words(1, 12, draw.choice(["", "."])), True)
        inner = draw.random() < 0.3
        if inner:
            out.append(f"<div{named(CONTENT_NAMES)}>")
        for _ in range(draw.randint(1, 12)):
            what = draw.random()
            if what < 0.72:
                block("p", content(1, 120), True)
            elif what < 0.80:
                block(draw.choice(["h2", "h3", "blockquote", "pre"]), words(1, 14, draw.choice(["", "."])), True)
            elif what < 0.86:
                out.append("<ul>" if draw.random() < 0.5 else "<ol>")
                for _ in range(draw.randint(1, 5)):
                    block("li", content(1, 16, draw.choice(["", "."]), 0.65), True)
                out.append("</ul>")
            elif what < 0.90:
                out.append("<table><tr>")
                for _ in range(draw.randint(1, 4)):
                    block("td", words(1, 5, ""), True)
                out.append("</tr></table>")
            elif what < 0.93:
                out.append("<figure>")
                block("figcaption", words(2, 14), True)
                out.append("</figure>")
            else:
                other(draw.choice(["div", "aside", "nav", "form", "div"]))
        if inner:
            out.append("</div>")
        if draw.random() < 0.25:
            other("section")
        if draw.random() < 0.2:
            other("footer")
        out.append(f"</{tag}>")
        for kind in ("section", "aside", "form", "div"):
            if draw.random() < 0.35:
                other(kind)
        out.append("</div>" if outer else "")
        if draw.random() < 0.8:
            other("footer")
        out.append("</div>" * deep)
        yield "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(out) + "</body></html>", labels


# --- the model -----------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Log potentials: ``pair[parent label, child label]`` and ``word[feature][label]``."""

    root: np.ndarray
    pair: np.ndarray
    word: dict[str, tuple[float, float]]

    def weights(self, nodes: list[Node]) -> list[list[float]]:
        """What each node's features weigh for either label. What a block inherits is summed up on the way down."""
        here = [[0.0, 0.0] for _ in nodes]
        seen: Counter = Counter()
        path: list[int] = []
        sums = [(0.0, 0.0)]
        for i, (own, x) in enumerate(zip(here, nodes, strict=True)):
            for f in x.features:
                if w := self.word.get(f):
                    own[0] += w[0]
                    own[1] += w[1]
            while path and path[-1] != x.parent:
                seen.subtract(nodes[path.pop()].names)
                sums.pop()
            a, b = sums[-1]
            if x.text is not None:
                own[0] += a
                own[1] += b
                continue
            for f in x.names:
                if not seen[f] and (w := self.word.get(f)):
                    a, b = a + w[0], b + w[1]
                seen[f] += 1
            path.append(i)
            sums.append((a, b))
        return here

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content."""
        n = len(nodes)
        here = self.weights(nodes)
        (p00, p01), (p10, p11) = self.pair.tolist()
        up = [(0.0, 0.0)] * n  # the message of each node to its parent
        for i in range(n - 1, 0, -1):
            a, b = here[i]
            up[i] = (_add(p00 + a, p01 + b), _add(p10 + a, p11 + b))
            own = here[nodes[i].parent]
            own[0] += up[i][0]
            own[1] += up[i][1]
        here[0][0] += float(self.root[0])
        here[0][1] += float(self.root[1])
        belief = [(0.0, 0.0)] * n
        belief[0] = tuple(here[0])
        for i in range(1, n):
            x, y = belief[nodes[i].parent]
            x, y = x - up[i][0], y - up[i][1]  # the parent without what this child told it
            belief[i] = (_add(x + p00, y + p10) + here[i][0], _add(x + p01, y + p11) + here[i][1])
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in belief]


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def fit(pages: Iterator[tuple[str, list[bool]]], smooth: float = 0.5) -> TreeModel:
    """Potentials counted from (page, label of each block); an element is content where most of its blocks are."""
    pair, total = np.full((2, 2), smooth), np.full(2, smooth)
    counts: dict[str, np.ndarray] = {}
    for page, labels in pages:
        nodes = tree_of(page)
        blocks = [i for i, x in enumerate(nodes) if x.text is not None]
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        share = np.zeros((len(nodes), 2))
        share[blocks] = [[not y, y] for y in labels]
        for i in range(len(nodes) - 1, 0, -1):
            share[nodes[i].parent] += share[i]
        label = (share[:, 1] > share[:, 0]).astype(int)
        for i, (x, features) in enumerate(zip(nodes, described(nodes), strict=True)):
            if i:
                pair[label[x.parent], label[i]] += 1
            total[label[i]] += 1
            for f in features:
                counts.setdefault(f, np.full(2, smooth))[label[i]] += 1
    log = {f: tuple(np.log(c / (total + 2 * smooth)).tolist()) for f, c in counts.items()}
    return TreeModel(np.log(np.array([0.5, 0.5])), np.log(pair / pair.sum(1, keepdims=True)), log)


@cache
def trained() -> TreeModel:
    """The model of the built-in labelled pages; fitted once in a process."""
    return fit(labelled_pages())


def blocks_of(page: str, model: TreeModel) -> list[tuple[str, float]]:
    """Every block of the page with its content marginal, in page order; a page without elements is all content."""
    nodes = tree_of(page)
    if all(x.text is not None for x in nodes[1:]):
        return [(x.text, 1.0) for x in nodes[1:]]
    return [(x.text, p) for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.text is not None]


def extract(pages: DataFrame, page: str = "html", model: TreeModel | None = None) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars, n_blocks, n_kept."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    use = model or trained()  # a few hundred potentials, shipped with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_page"):
            texts, sizes, kept = [], [], []
            for content in batch.column(2).to_pylist():
                blocks = blocks_of(content, use) if content else []
                chosen = [t for t, p in blocks if p > 0.5]
                texts.append("\n\n".join(chosen))
                sizes.append(len(blocks))
                kept.append(len(chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    picked = pages.select("page_id", "url", F.col(page).alias("_page"))
    return picked.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
