"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

Block elements are the nodes; inline markup belongs to the block around it, and text that stands beside
blocks is a leaf of its own. Every node gets log-odds of being main text from its subtree's density, its
attribute tokens (hashed; their weights are learnt from the training pages), depth and siblings. Decoding takes
the most likely labelling in which nothing below a dropped node is kept, so an ancestor and its
descendants never contradict each other.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right as bisect
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .html_pages import PageMaker
from .shared import arrow_map

TRAINING_PAGES, TOKEN_PAGES = 700, 300
TRAINING_SEED = 11
BATCH_NODES = 20_000
TOKEN_BUCKETS = 4096
TOKEN_DOUBT = 4.0

# fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title svg math iframe object select textarea button canvas audio video".split()
)
BLOCKS = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary hr "
    "center menu dialog"
).split()
KINDS = {
    "article": 1, "main": 1, "section": 2, "div": 2, "p": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4,
    "ul": 5, "ol": 5, "li": 6, "dl": 5, "dt": 6, "dd": 6, "table": 7, "tr": 7, "td": 7, "th": 7, "blockquote": 8, "pre": 8,
    "nav": 9, "menu": 9, "header": 10, "footer": 11, "aside": 12, "form": 13, "html": 14, "body": 14,
    "#text": 15,
}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_BLOCK = frozenset(BLOCKS)
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "label", "chars", "link", "words", "stops", "tags", "inputs", "kids", "before", "own")

    def __init__(self, tag, parent, depth, attrs):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.tokens = ()
        self.label = None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                self.tokens += tuple(crc32(t.encode()) % TOKEN_BUCKETS for t in _TOKEN.findall(value.lower()))
            elif name == "data-m":
                self.label = value == "1"
        self.chars = self.link = self.words = self.stops = self.tags = self.inputs = self.kids = self.before = self.own = 0


class Run:
    """Text between two block borders or line breaks, and the node it belongs to."""

    __slots__ = ("node", "text", "chars", "link", "words", "stops", "before", "label", "goes_on")


class Dom(HTMLParser):
    """Block nodes (parents before their children) and the runs of text in page order.

    Open elements are found through the places of each tag, so every tag costs constant time and
    what it closes, whatever is left unclosed before it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse(self, html: str):
        self.reset()
        self.nodes = [Node("html", -1, 0, ())]
        # open elements: (tag, block it is in, is skipped, is a link)
        self.open = [("html", 0, False, False)]
        self.blocks = [0]  # places of open blocks
        self.places: dict[str, list[int]] = {}
        self.runs, self.pieces = [], []
        self.sums = [0, 0, 0, 0]
        self.seen, self.mark, self.broken = 0, None, False
        self.feed(html)
        self.close()
        self._flush()
        self._own_leaves()
        return self

    def parse_marked_section(self, i, report=1):
        # "<![" is no more than a comment up to the next ">"
        return self.parse_bogus_comment(i, report)

    def handle_comment(self, data):
        if data in ("m0", "m1"):
            # training pages say so of the text that follows
            self.mark = data == "m1"

    def _flush(self):
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            run = Run()
            run.node, run.text, run.label, run.goes_on = self.open[-1][1], text, self.mark, self.broken
            run.chars, run.link, run.words, run.stops = self.sums
            run.before = self.seen
            self.seen += run.chars
            self.runs.append(run)
            self.mark, self.broken = None, False
        self.sums = [0, 0, 0, 0]

    def _own_leaves(self):
        """Text beside blocks, or right in the page, becomes a leaf; other text is its block's own."""
        nodes = self.nodes
        holders = {n.parent for n in nodes}
        for run in self.runs:
            block = nodes[run.node]
            if run.node in holders or block.tag in ("html", "body"):
                leaf = Node("#text", run.node, block.depth + 1, ())
                leaf.before = run.before
                leaf.label = False if run.label is None and block.label is False else run.label
                run.node = len(nodes)
                nodes.append(leaf)
            n = nodes[run.node]
            n.chars += run.chars
            n.own += run.chars
            n.link += run.link
            n.words += run.words
            n.stops += run.stops

    def _push(self, tag, block, skipped, link):
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, block, skipped, link))

    def _close_to(self, at: int):
        if self.blocks[-1] >= at:
            self._flush()
            self.broken = False
        while len(self.open) > at:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            # white space inside the block, though what stands before and after is judged apart
            self._flush()
            self.broken = True
            return
        if tag == "hr":
            self._flush()
            self.broken = False
            return
        _, block, skipped, link = self.open[-1]
        if tag in ("body", "html"):
            # leaves an unclosed head; a second one only adds its attributes
            self._close_to(1)
            block, skipped, link = 0, False, False
            if tag == "html":
                for name, value in attrs:
                    if name == "data-m":
                        self.nodes[0].label = value == "1"
                return
        if tag in _BLOCK:
            stop = len(self.open)
            if tag in CLOSED_BY:
                same, border = CLOSED_BY[tag]
                last = self._last(same)
                # the outermost open one of the kind inside the border: a cell closes with its row
                edge = self._last(border)
                if last > edge:
                    stop = min(p[bisect(p, edge)] for p in map(self.places.get, same) if p and p[-1] > edge)
            elif self.open[self.blocks[-1]][0] == "p":
                stop = self.blocks[-1]
            self._flush()
            self.broken = False
            self._close_to(stop)
            _, block, skipped, link = self.open[-1]
            if not skipped:
                self.nodes.append(Node(tag, block, len(self.blocks), attrs))
                self.nodes[-1].before = self.seen
                block = len(self.nodes) - 1
        elif tag in VOID:
            if tag == "input":
                self.nodes[block].inputs += 1
            return
        else:
            self.nodes[block].tags += 1
            if tag in ("select", "textarea", "button"):
                self.nodes[block].inputs += 1
        self._push(tag, block, skipped or tag in SKIPPED, link or tag == "a")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        places = self.places.get(tag)
        # an inline end tag closes nothing beyond the block it stands in
        if places and (tag in _BLOCK or places[-1] > self.blocks[-1] or tag in SKIPPED):
            self._close_to(places[-1])

    def handle_data(self, data):
        _, _, skipped, link = self.open[-1]
        if skipped:
            return
        self.pieces.append(data)
        words = data.split()
        size = sum(map(len, words))
        sums = self.sums
        sums[0] += size
        if link:
            sums[1] += size
        sums[2] += len(words)
        sums[3] += data.count(".") + data.count(",") + data.count("?")


def features(nodes: list[Node], tokens: list[float]) -> list[list[float]]:
    """One row per node; subtree sums are gathered bottom-up into the nodes first.

    ``tokens`` has the weight of each bucket of attribute tokens.
    """
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].parent]
        up.chars += n.chars
        up.link += n.link
        up.words += n.words
        up.stops += n.stops
        up.tags += n.tags + 1
        up.inputs += n.inputs
        up.kids += 1
    total = nodes[0].chars or 1
    own, above, worst, inside = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes), [0] * len(nodes)
    same_tag: dict[tuple, int] = {}
    for i, n in enumerate(nodes):
        if n.tokens:
            own[i] = sum(map(tokens.__getitem__, n.tokens))
        if i:
            above[i] = above[n.parent] + own[n.parent]
            worst[i] = min(worst[n.parent], own[n.parent])
            inside[i] = max(inside[n.parent], _family(n.tag))
            same_tag[n.parent, n.tag] = same_tag.get((n.parent, n.tag), 0) + 1
    out = []
    for i, n in enumerate(nodes):
        up = nodes[n.parent] if i else n
        out.append(
            [
                KINDS.get(n.tag, 0),
                _family(n.tag),
                inside[n.parent] if i else 0,
                n.depth,
                own[i],
                above[i],
                worst[i],
                math.log1p(n.chars),
                n.chars / (n.tags + 1),
                n.link / (n.chars or 1),
                n.words / (n.stops + 1),
                n.own / (n.chars or 1),
                n.inputs,
                n.kids,
                up.kids,
                same_tag.get((n.parent, n.tag), 1) / (up.kids or 1),
                n.chars / (up.chars or 1),
                n.chars / total,
                n.before / total,
                KINDS.get(up.tag, 0),
                up.link / (up.chars or 1),
                math.log1p(up.chars),
            ]
        )
    return out


def _family(tag: str) -> int:
    """0 neutral, 1 main, 2 boilerplate by its tag."""
    return 1 if tag in ("article", "main") else 2 if tag in ("nav", "menu", "header", "footer", "aside", "form") else 0


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Most likely labels with everything below a dropped node dropped."""
    n = len(nodes)
    keep, drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        # log(p) and log(1 - p); the root is only a container
        weight = 0.0 if i == 0 else 1.0
        o = odds[i]
        keep[i] -= weight * (math.log1p(math.exp(-abs(o))) + max(-o, 0.0))
        drop[i] -= weight * (math.log1p(math.exp(-abs(o))) + max(o, 0.0))
        if i:
            up = nodes[i].parent
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
    kept = [False] * n
    for i in range(n):
        kept[i] = (i == 0 or kept[nodes[i].parent]) and keep[i] >= drop[i]
    return kept


class Extractor(NamedTuple):
    """Weights of attribute tokens and the trees over the nodes' features."""

    tokens: list[float]
    trees: Boosted

    def odds(self, rows: list[list[float]]) -> list[float]:
        return self.trees.score(np.array(rows)).tolist() if rows else []


def token_weights(pages: list[list[Node]]) -> list[float]:
    """Log-odds of main text per bucket of attribute tokens, drawn to zero where a token is rare."""
    counts = np.zeros((2, TOKEN_BUCKETS))
    for nodes in pages:
        for node in nodes:
            if node.label is not None:
                for bucket in set(node.tokens):
                    counts[int(node.label), bucket] += 1
    share = counts.sum(axis=1) / counts.sum()
    counts += TOKEN_DOUBT * share[:, None]
    return (np.log(counts[1] / counts[0]) - math.log(share[1] / share[0])).tolist()


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Extractor:
    """The model, fitted on a bounded number of made-up labelled pages; other pages give the token weights."""
    maker, dom = PageMaker(seed), Dom()
    tokens = token_weights([dom.parse(maker.page()).nodes for _ in range(TOKEN_PAGES)])
    x, y = [], []
    for _ in range(pages):
        nodes = dom.parse(maker.page()).nodes
        for row, node in zip(features(nodes, tokens), nodes, strict=True):
            if node.label is not None and node.parent >= 0:
                x.append(row)
                y.append(node.label)
    return Extractor(tokens, fit(np.array(x), np.array(y)))


def joined(runs: list[Run], kept: list[bool]) -> str:
    """Kept runs, a line each; what a line break alone parts goes on after a space."""
    out: list[str] = []
    before = False
    for run in runs:
        if kept[run.node]:
            if out:
                out.append(" " if run.goes_on and before else "\n")
            out.append(run.text)
        before = kept[run.node]
    return "".join(out)


def texts(pages: list[str | None], model: Extractor) -> list[str]:
    """Main text of each page; nodes of many pages are scored together."""
    dom, out, waiting = Dom(), [], []

    def settle():
        odds = model.odds([row for _, _, feats in waiting for row in feats])
        at = 0
        for nodes, runs, feats in waiting:
            out.append(joined(runs, decode(nodes, odds[at : at + len(feats)])))
            at += len(feats)
        waiting.clear()

    held = 0
    for html in pages:
        dom.parse(html or "")
        waiting.append((dom.nodes, dom.runs, features(dom.nodes, model.tokens)))
        held += len(dom.nodes)
        if held >= BATCH_NODES:
            settle()
            held = 0
    settle()
    return out


def main_text(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks of main text in page order, white space inside a block (a ``<br>`` included) as one space,
    joined by one line feed. Text beside blocks is a block of its own and judged as one. Null, empty and
    textless pages give an empty text. Any markup is read: ``<!`` that opens nothing known is a comment up
    to the next ``>``, end tags of nothing open are ignored. Rows repeat as they are; other columns of
    ``pages`` are ignored.
    """
    known = model or trained()

    def of_batch(batch):
        html = batch.column("html")
        lo = 0
        while lo < batch.num_rows:
            # a few megabytes of markup at a time
            hi, size = lo, 0
            while hi < batch.num_rows and size < 4 << 20:
                size += len(html[hi].as_py() or "")
                hi += 1
            found = texts(html.slice(lo, hi - lo).to_pylist(), known)
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id").slice(lo, hi - lo),
                    "url": batch.column("url").slice(lo, hi - lo),
                    "text": pa.array(found, pa.string()),
                    "n_chars": pa.array([len(t) for t in found], pa.int64()),
                }
            )
            lo = hi

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return arrow_map(rows, of_batch, "page_id long, url string, text string, n_chars long")
