"""Main text of web pages by tag-path ratios.

Text is aggregated by its tag path from the root to the leaf: characters and punctuation marks a node. Both ratios are
smoothed along the page, fused, and weighed down where a class, id or role names something else than main text. Paths
whose score reaches the page's standard deviation of scores are content. What stands between content in the same part
of the page (headings, short paragraphs, lists) belongs to it, links apart.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed by HTML: elements whose content is not markup, elements without content, elements that make blocks.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
#: Never main text, wherever they stand.
NOT_TEXT = {"head", "script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "audio", "video", "select", "option", "datalist", "button", "nav", "menu", "footer", "aside", "dialog", "noembed", "noframes", "xmp", "input"}
#: Words of class, id and role that name parts around the main text: a path through one weighs less.
NOT_TEXT_NAMES = {
    "ad", "ads", "adbox", "advert", "advertisement", "adverts", "advertising", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup",
    "site-header", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "tooltip", "topbar", "warning", "widget",
}
#: An open element that a new one of a kind ends, up to the nearest of its own container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "caption", "html", "button", "object", "template"}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
MARK = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: What a path through a named part weighs, in an article or main element and elsewhere.
WEIGHT_INSIDE, WEIGHT_OUTSIDE = 0.5, 0.01
#: Elements that belong to the text around them, even if what they hold is short.
FLOW = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "ul", "ol", "dl", "li", "dt", "dd", "table", "blockquote", "pre", "figure", "figcaption", "hr", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PUNCTUATION = frozenset(".,;:!?…。，、؟")


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    parent: int
    block: int  # the nearest element at or above it that makes a block
    out: bool = False
    bound: bool = False  # in an article or main element, or one itself
    named: bool = False  # its name speaks against it
    link: bool = False


@dataclass
class Page:
    """Elements in page order, text pieces as (element, block number, text), and the weight of each tag path."""

    elements: list[Element] = field(default_factory=lambda: [Element("", 0, -1, 0)])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [1.0])


class Stack:
    """The open elements; where the last one of each tag is takes no search, so deep pages take linear time."""

    def __init__(self):
        self.items: list[tuple[int, str]] = [(0, "")]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []  # depths of elements that make a block or a scope

    def push(self, element: int, tag: str) -> None:
        self.depths[tag].append(len(self.items))
        if tag in SCOPE or tag in BLOCK:
            self.walls.append(len(self.items))
        self.items.append((element, tag))

    def cut(self, depth: int) -> None:
        while len(self.items) > depth:
            tag = self.items.pop()[1]
            self.depths[tag].pop()
            if self.walls and self.walls[-1] == len(self.items):
                self.walls.pop()

    def nearest(self, tags) -> int:
        """The depth of the last open element with one of the tags, or 0."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)


def described(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """The step of a tag path, whether the element is never main text, and whether its names speak against it."""
    step, out, named = tag, tag in NOT_TEXT or (tag == "header" and not inside), False
    if attributes:
        for name, *values in NAMES.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                out = True
            elif name in ("class", "id", "role"):
                words = value.split()
                if name == "class" and words:
                    step += "." + words[0]
                if tag not in ("html", "body", "article", "main"):
                    named |= any(w in NOT_TEXT_NAMES or any(part in NOT_TEXT_NAMES for part in re.split(r"[-_]+", w)) for w in words)
    return step, out, named


def parse(source: str) -> Page:
    """A tolerant reading of tags: ends that are missing are implied, ends without a start are passed over."""
    page, stack, block, at, size = Page(), Stack(), 0, 0, len(source)

    def text(piece: str) -> None:
        if piece:
            page.pieces.append((stack.items[-1][0], block, html.unescape(piece)))

    while at < size:
        mark = MARK.search(source, at)
        if mark is None:
            text(source[at:])
            break
        text(source[at : mark.start()])
        at = mark.end()
        closing, tag, attributes = mark.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            depth = stack.nearest((tag,))
            if depth and (tag in BLOCK or not stack.walls or stack.walls[-1] <= depth):  # an inline end across blocks ends nothing
                stack.cut(depth)
            block += tag in BLOCK
            continue
        if tag in ENDS_P and (depth := stack.nearest(("p",))) and depth > stack.nearest(SCOPE):
            stack.cut(depth)
        if tag in ENDS:
            ended, within = ENDS[tag]
            while (depth := stack.nearest(ended)) > stack.nearest(within):
                stack.cut(depth)
                if tag != "tr":
                    break
        block += tag in BLOCK
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        inside = bool(stack.nearest(("article", "main")))
        step, out, named = described(tag, attributes, inside)
        parent = stack.items[-1][0]
        above = page.elements[parent]
        key = (above.path, step + "!" * named)
        if key not in page.paths:
            page.paths[key] = len(page.weights)
            page.weights.append(min(page.weights[above.path], (WEIGHT_INSIDE if inside else WEIGHT_OUTSIDE) if named else 1.0))
        i = len(page.elements)
        page.elements.append(Element(tag, page.paths[key], parent, i if tag in BLOCK else above.block, out or above.out, above.bound or tag in ("article", "main"), named, tag == "a" or above.link))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = end.start() if end else size
            end = source.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        if not attributes.endswith("/") or tag in BLOCK:
            stack.push(i, tag)
    settle_forms(page)
    return page


def settle_forms(page: Page) -> None:
    """Forms are no text, but for one around the page's own text: half of all text and more, with headings of the page, an
    article or two paragraphs in it. Of such a form only labels and legends go, besides the controls."""
    elements, n = page.elements, len(page.elements)
    if not any(e.tag == "form" for e in elements):
        return
    chars, parts, heads = [0] * n, [0] * n, [False] * n
    for element, _, piece in page.pieces:
        if not elements[element].out:
            chars[element] += len(piece.strip())
    for i in range(n - 1, 0, -1):
        e = elements[i]
        if not e.out:
            up = e.parent
            chars[up] += chars[i]
            parts[up] += parts[i] + (e.tag == "p" and chars[i] > 0)
            heads[up] |= heads[i] or e.tag in ("article", "main", "h1")
    around = [False] * n
    for i, e in enumerate(elements[1:], 1):
        form = e.tag == "form"
        around[i] = (around[e.parent] and not form) or (form and 2 * chars[i] >= chars[0] and (heads[i] or parts[i] > 1))
        e.out = e.out or elements[e.parent].out or (form and not around[i]) or (around[i] and e.tag in ("label", "legend"))


def smooth(values: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian means of neighbours."""
    if len(values) < 2:
        return values
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def path_scores(page: Page) -> dict[int, float]:
    """For each tag path with text: characters a node and punctuation a node, over the path's nodes on the page, as they
    are and smoothed along the order in which paths first appear, fused by their geometric mean and weighed."""
    chars, marks, nodes = {}, {}, {}
    for element, _, piece in page.pieces:
        if page.elements[element].out or not (piece := piece.strip()):
            continue
        path = page.elements[element].path
        chars[path] = chars.get(path, 0) + len(piece)
        marks[path] = marks.get(path, 0) + sum(map(piece.count, PUNCTUATION))
        nodes[path] = nodes.get(path, 0) + 1
    if not chars:
        return {}
    count = np.array([nodes[p] for p in chars], float)
    tpr = np.array([chars[p] for p in chars], float) / count
    ppr = np.array([marks[p] for p in chars], float) / count
    fused = np.sqrt(tpr * (1 + ppr) * smooth(tpr) * (1 + smooth(ppr)))
    return dict(zip(chars, np.sqrt(fused * np.array([page.weights[p] for p in chars])), strict=True))


def content_paths(page: Page) -> set[int]:
    """The paths whose score reaches the standard deviation of the page's scores."""
    scores = path_scores(page)
    values = np.array(list(scores.values()))
    limit = min(values.std(), values.max()) if scores else 0.0
    return {p for p, s in scores.items() if s >= limit}


def main_text(source: str | None) -> str:
    """The text of the content nodes, blocks joined by two new lines; empty if there is none.

    A block belongs to the text if its own path, or that of inline text in it, is a content path. Around content
    there are containers: the parent of a block on a content path, elements with content in two parts or more, and what
    has content in these. Blocks of low ratios that stand in a container are text too where they are running text
    (headings, paragraphs, lists, tables and the like; in article and main elements any), unless a name speaks against
    them or they are lists of links.
    """
    if not source:
        return ""
    page = parse(source)
    elements, content = page.elements, content_paths(page)
    n = len(elements)
    chars, links, n_links, parts, high = [0] * n, [0] * n, [0] * n, [0] * n, set()
    found, inner = [False] * n, [False] * n
    for element, _, piece in page.pieces:
        e = elements[element]
        if e.out or not (size := len(piece.strip())):
            continue
        chars[element] += size
        links[element] += size * e.link
        if e.path in content:
            high.add(elements[e.block].path)
            found[e.block] = True
    for i, e in enumerate(elements):
        n_links[i] += e.tag == "a"
        if e.block == i and e.path in high and not e.out:
            found[i] = True
    for i in range(n - 1, 0, -1):  # elements come in page order, parents first
        up = elements[i].parent
        chars[up] += chars[i]
        links[up] += links[i]
        n_links[up] += n_links[i]
        if found[i]:
            inner[elements[up].block] |= elements[i].block == i and elements[i].path in high
            parts[up] += 1
            found[up] = True
    lifted, container, named = [False] * n, [False] * n, [False] * n  # named: by a name at or above it, and without content
    for i, e in enumerate(elements):
        up = e.parent
        named[i] = (e.named and not found[i]) or (up >= 0 and named[up])
        container[i] = found[i] and (inner[i] or parts[i] > 1 or e.path in high or (up >= 0 and container[up]))
        if up < 0 or e.out or named[i]:
            continue
        listed = n_links[i] > 1 and 2 * links[i] >= chars[i] and e.tag not in HEADINGS
        running = e.tag in FLOW or e.tag not in BLOCK or e.bound
        lifted[i] = (lifted[up] or (container[up] and running)) and not listed and not found[i]
    blocks, last = [], None
    for element, block, piece in page.pieces:
        e = elements[element]
        if not e.out and (lifted[element] or elements[e.block].path in high or not named[element] and (lifted[e.block] or (container[e.block] and e.bound))):
            if block != last:
                blocks.append([])
            blocks[-1].append(piece)
            last = block
        elif not e.out or piece.strip():
            last = None if block != last else last
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages, each from its whole html.

    A null or empty html, or one without main text, gives an empty text. Null ids and urls stay null, repeated rows
    give repeated rows, further columns go. Each page is worked on alone, so nothing is shuffled.
    """
    return pages.select("page_id", "url", "html").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
