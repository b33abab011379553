"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block elements from the root to it. Per path, the length and
the punctuation of its blocks are summed and divided by the number of nodes that have the path; link text counts
against it, and so does all text of parts that elements, roles or class names mark as menus, headers, footers, sidebars,
notices, adverts, forms or comments: their paths are kept apart (``!``) and have the ratio 0. Parts whose names have to do with such parts, but say more, are kept
apart as well (``?``) and have to reach the threshold by their own ratios. The ratios are smoothed
over paths in page order and fused by their product, and paths that reach a threshold taken from the spread of the
scores are content.

Their nodes lie in content elements: article or main elements if those hold at least half of their scores, else the smallest element that
holds them all and the div or section elements around it that add more than links. Inside a content element a
second smoothing lets each path share in the best score there, in proportion to the part of its text that counts for it;
headings, short paragraphs and tables so reach the same threshold, lists of links and marked parts do not. What reaches
it is the main text.

Defined cases: null and empty pages, and pages without any content block, give an empty text; truncated pages end
where they end, a tag cut off included; repeated rows and null ids are kept row by row; an empty table gives no rows;
other columns are ignored. The heading of an article stays if its header element holds it, and a heading that is a link counts as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp")
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<({'|'.join(RAW)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form head menu button select dialog fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner sidebar side "
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr alert popup modal "
    "newsletter subscribe signup login share sharing social related recommended comment comments commentlist reply replies respond "
    "disqus toolbar pagination pager widget skip".split()
)
#: words that say where or how large a part is, or of what it is a part, not what it holds: beside them a word of MARKS names the whole part
SHAPES = frozenset(
    "article blog body entry global page post reader readers story text title top user users view web area bar block box btn button buttons col column container content grid group inner item items left link links list main outer panel primary right row secondary section site slot "
    "small tertiary top bottom unit widgets wide wrap wrapper x m s l xl".split()
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: what an opening tag closes when it is still open in the same container
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table div section article main body td th blockquote select".split())
IN_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol pre blockquote td tr tbody table".split())
KERNEL = np.exp(-np.arange(-1, 2) ** 2 / 0.5) / np.exp(-np.arange(-1, 2) ** 2 / 0.5).sum()
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")


def marked(tag: str, attributes: str, inside: bool) -> int:
    """3 for an element that is one of the parts that never are content, 2 for one whose name only has to do with such parts, 1 for a header, which may hold a heading.

    A class name or id marks a part if all its words do (``comment-list``); one that says more (``social-history``, ``notice-board``) leaves the decision to the ratios.
    ``inside`` says whether an article or main element is open; class names of the outermost one don't mark it.
    """
    found = 0
    if tag in LEFT_OUT:
        found = 1 if tag == "header" else 3
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" and not value:
            return 3
        if name.lower() == "role" and value in ROLES:
            return 3
        if name.lower() in ("class", "id") and tag not in ("html", "body") and (inside or tag not in ("article", "main")):
            for one in value.split():
                words = {w for w in re.split(r"[^a-z]+", one) if w}
                marks = words & MARKS
                if marks:
                    found = max(found, 2 if words - MARKS - SHAPES else 1 if marks == {"header"} else 3)
    return found


def plain(pieces: list[str]) -> str:
    """The text of pieces of source: references decoded, white space as single spaces."""
    return " ".join(unescape("".join(pieces)).split())


class Block:
    """A run of text inside one block element: its tags and node numbers from the root, text and link text."""

    __slots__ = ("tags", "path", "nodes", "text", "links", "out", "doubtful")

    def __init__(self, stack: list[tuple[str, int, int]]):
        self.tags, self.nodes, marks = tuple(zip(*stack, strict=True)) if stack else ((), (), ())
        heading = any(t in HEADINGS for t in self.tags) and not MAIN.isdisjoint(self.tags)
        self.out = 3 in marks or (1 in marks and not heading)
        self.doubtful = 2 in marks and not self.out
        self.path = ("!" if self.out else "?" if self.doubtful else "") + "/".join(self.tags)
        self.text, self.links = [], []

    @property
    def link_chars(self) -> int:
        return len(plain(self.links)) if self.links else 0


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order; inline elements don't start a block."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, node number, mark
    block, links, number, at = None, 0, 0, 0

    def text(s: str) -> None:
        nonlocal block
        if not s:
            return
        if block is None:
            if s.isspace():
                return
            block = Block(stack)
            found.append(block)
        block.text.append(s)
        if links and HEADINGS.isdisjoint(block.tags):
            block.links.append(s)

    for m in TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            if block is not None:
                block.text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        block = None
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        if tag in VOID:
            continue
        if tag in IN_P and stack and stack[-1][0] == "p":
            stack.pop()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] in HOLDERS:
                break
        if tag == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        number += 1
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, number, marked(tag, attributes, any(t in MAIN for t, _, _ in stack))))
    text(html[at:])
    return found


def path_ratios(blocks: list[tuple[Block, str]]) -> dict[str, tuple[float, float, float]]:
    """(length, punctuation, part that counts) of each path in page order: sums over its blocks, by number of nodes."""
    sums: dict[str, list[float]] = {}
    for b, s in blocks:
        x = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        x[3] += len(s)
        x[2] += 1
        if not b.out:
            x[0] += max(0, len(s) - b.link_chars)
            x[1] += len(PUNCTUATION.findall(s))
    return {k: (x[0] / x[2], x[1] / x[2], x[0] / x[3]) for k, x in sums.items()}


def path_scores(ratios: dict[str, tuple[float, float, float]]) -> dict[str, float]:
    """Fused and smoothed ratio of each path; paths of marked parts neither get nor give a share in the smoothing."""
    open_ = [k for k in ratios if not k.startswith("!")]
    scores = dict.fromkeys(ratios, 0.0)
    if open_:
        a = np.array([ratios[k] for k in open_])
        smooth = lambda v: np.convolve(np.pad(v, 1, mode="edge"), KERNEL, mode="valid")
        scores.update(zip(open_, (smooth(a[:, 0]) * (smooth(a[:, 1]) + 0.1)).tolist(), strict=True))
    return scores


def threshold(scores: dict[str, float]) -> float:
    """The least score of content: the mean of the scores above 0, or less where the best stands out less."""
    v = np.array([x for x in scores.values() if x > 0])
    return float(min(v.mean(), v.max() - v.std())) if len(v) else float("inf")


def content_elements(strong: list[Block], blocks: list[tuple[Block, str]], scores: dict[str, float]) -> set[int]:
    """Node numbers of the elements that hold the content whose paths scored.

    Article or main elements are taken if they hold at least half of the scores of these nodes.
    """
    total = sum(scores[b.path] for b in strong)
    for tag in ("article", "main"):
        held = [b for b in strong if tag in b.tags]
        if held and 2 * sum(scores[b.path] for b in held) >= total:
            return {b.nodes[b.tags.index(tag)] for b in held}
    shared, names = strong[0].nodes, strong[0].tags
    for b in strong[1:]:
        n = 0
        while n < min(len(shared), len(b.nodes)) and shared[n] == b.nodes[n]:
            n += 1
        shared = shared[:n]
    n = len(shared)
    while n > 1 and names[n - 1] in PARTS:
        n -= 1
    while n > 1 and names[n - 1] in ("div", "section") and names[n - 2] in ("div", "section"):
        added = [(b, s) for b, s in blocks if b.nodes[: n - 1] == shared[: n - 1] and b.nodes[:n] != shared[:n] and not b.out]
        if 2 * sum(b.link_chars for b, _ in added) > sum(len(s) for _, s in added):
            break
        n -= 1
    return {shared[n - 1]} if n else {0}


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by one space."""
    if not html:
        return ""
    blocks = [(b, s) for b in blocks_of(html.replace("\0", "")) if (s := plain(b.text))]
    ratios = path_ratios(blocks)
    scores = path_scores(ratios)
    limit = threshold(scores)
    strong = [b for b, _ in blocks if scores[b.path] >= limit]
    if not strong:
        return ""
    holders = content_elements(strong, blocks, scores)
    inside = [(b, s) for b, s in blocks if holders == {0} or not holders.isdisjoint(b.nodes)]
    best = max(scores[b.path] for b, _ in inside)
    shared = lambda b: 0.0 if b.doubtful else best * ratios[b.path][2]
    return " ".join(s for b, s in inside if max(scores[b.path], shared(b)) >= limit)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
