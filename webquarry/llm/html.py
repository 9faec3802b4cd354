"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with the path of open tags above it.  Paths are numbered in a
trie, so a deep page costs its tags and no more.  Per path, the text length and the punctuation of its nodes are aggregated, per
node of the path.  The two ratios are smoothed over the nodes in page order,
fused, and compared with a threshold taken from their spread.  The paths above
it vote for the element that holds the main text; its nodes, less those inside
elements that are boilerplate by their tag or class, are the result.  A class does
not count where the element holds most of the text on content paths, or an article or main element with more
of it than all that lies outside marked elements.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import filled, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、！？]")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "svg", "canvas", "object",
    "audio", "video", "map",
} | RAW
#: Words in a class, id or role that mark an element as boilerplate.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|"
    r"overlay|sidebar|side|aside|nav|navigation|navbar|menu|breadcrumbs?|header|masthead|footer|foot|comments?|disqus|replies|reply|"
    r"respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|"
    r"complementary|contentinfo|skip)(?:$|[\s_-])",
    re.I,
)
#: States of a layout, not names of a part: has-sidebar, no-sidebar, with-comments.
STATE = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
#: What answers a text may be longer than it; most of the text does not make it the main text.
ANSWERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
HOLDERS = ("article", "main")


class Trie:
    """Tag paths by number: the path above, the last label, the depth.  Number 0 is the empty path; a path comes after those it goes on from."""

    def __init__(self) -> None:
        self.parent, self.label, self.depth = [-1], [""], [0]
        self.known: dict[tuple[int, str], int] = {}

    def below(self, path: int, label: str) -> int:
        found = self.known.setdefault((path, label), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
            self.label.append(label)
            self.depth.append(self.depth[path] + 1)
        return found

    def tag(self, path: int) -> str:
        return self.label[path].split(".", 1)[0]

    def summed(self, sizes: dict[int, int]) -> list[int]:
        """Per path, what lies on it and on all that go on from it."""
        total = [0] * len(self.parent)
        for path, size in sizes.items():
            total[path] = size
        for path in range(len(total) - 1, 0, -1):
            total[self.parent[path]] += total[path]
        return total

    def under(self, roots: set[int]) -> list[bool]:
        """Per path, whether it goes on from one of ``roots`` or is one."""
        out = [0 in roots]
        for path in range(1, len(self.parent)):
            out.append(path in roots or out[self.parent[path]])
        return out


class Node:
    """A run of text: its path, the block it belongs to, whether a boilerplate tag is above it, and the innermost of the elements kept in ``Elements``."""

    __slots__ = ("path", "block", "dropped", "element", "text")

    def __init__(self, path: int, block: int, dropped: bool, element: int, text: str):
        self.path, self.block, self.dropped, self.element, self.text = path, block, dropped, element, text


class Elements:
    """Elements marked as boilerplate by class, and article or main elements, each with the one around it; number 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.marked, self.answers, self.holder = [-1], [False], [False], [False]

    def add(self, parent: int, marked: bool, answers: bool) -> int:
        self.parent.append(parent)
        self.marked.append(marked)
        self.answers.append(answers)
        self.holder.append(not marked)
        return len(self.parent) - 1


class OpenTags:
    """The open tags of a page.  The places of every name are at hand, so no step searches through the depth."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.paths, self.drops, self.elements = [0], [0], [0]

    def open(self, name: str, path: int, dropped: bool, element: int) -> None:
        self.places[name].append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.paths.append(path)
        self.drops.append(self.drops[-1] + dropped)
        self.elements.append(element)

    def close(self, down_to: int) -> None:
        while len(self.names) > down_to:
            at = len(self.names) - 1
            self.places[self.names.pop()].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
            self.paths.pop()
            self.drops.pop()
            self.elements.pop()

    def innermost(self, names: set[str]) -> int:
        """The place of the innermost open tag of some names, -1 without any."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close_before(self, tag: str) -> None:
        """Close what a start tag ends without a word."""
        if tag in SCOPE:
            at = self.innermost(CLOSED_BY[tag])
            if at > self.innermost(SCOPE[tag]):
                self.close(at)
        elif tag in ENDS_P and self.blocks and self.names[self.blocks[-1]] == "p":
            self.close(self.blocks[-1])


def text_nodes(page: str) -> tuple[list[Node], Trie, Elements]:
    """The text nodes of a page in order, its tag paths and its marked elements and holders.

    Time and memory grow with the length of the page, however deep its tags are.
    """
    nodes: list[Node] = []
    trie, elements, tags = Trie(), Elements(), OpenTags()
    block, at, size = 0, 0, len(page)

    def add(text: str) -> None:
        if text and not text.isspace():
            text = html.unescape(text) if "&" in text else text
        elif text and nodes:
            text = " "
        else:
            return
        nodes.append(Node(tags.paths[-1], block, tags.drops[-1] > 0, tags.elements[-1], text))

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag == "br":
            nodes.append(Node(tags.paths[-1], block, tags.drops[-1] > 0, tags.elements[-1], " "))
        if tag not in INLINE:
            block += 1
        if found[1]:
            if tags.places.get(tag):
                tags.close(tags.places[tag][-1])
            continue
        tags.close_before(tag)
        if tag in VOID or found[3].endswith("/") and tag not in INLINE and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        marks = CLASS.findall(found[3]) if "=" in found[3] else []
        words = [STATE.sub("", "".join(m)) for m in marks]
        by_class = any(BOILERPLATE.search(w) for w in words)
        element = tags.elements[-1]
        if tag in HOLDERS and not by_class:
            element = elements.add(element, False, False)
        elif by_class and tag not in ("html", "body", *HOLDERS):
            element = elements.add(element, True, any(ANSWERS.search(w) for w in words))
        label = tag if not marks else f"{tag}.{' '.join(''.join(m) for m in marks)}"
        tags.open(tag, trie.below(tags.paths[-1], label), tag in DROPPED, element)
    return nodes, trie, elements


def smoothed(values: list[float]) -> list[float]:
    """A short Gaussian over neighbours in page order."""
    kernel = [math.exp(-(d * d) / 2) for d in range(-2, 3)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + 2], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def path_scores(nodes: list[Node]) -> list[float]:
    """The fused, smoothed ratio of every node's path: text length and punctuation per node of the path."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: Counter = Counter()
    for n in nodes:
        length[n.path] += len(n.text)
        marks[n.path] += len(PUNCTUATION.findall(n.text))
        count[n.path] += 1
    by_length = smoothed([length[n.path] / count[n.path] for n in nodes])
    by_marks = smoothed([marks[n.path] / count[n.path] for n in nodes])
    return [a * (1 + b) for a, b in zip(by_length, by_marks, strict=True)]


def content_paths(live: list[Node]) -> set[int]:
    """The paths whose fused ratio reaches the threshold."""
    scores = path_scores(live)
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    threshold = max(0.0, min(mean, spread))
    return {n.path for n, s in zip(live, scores, strict=True) if s >= threshold}


def boilerplate_dropped(nodes: list[Node], elements: Elements) -> None:
    """Mark the nodes inside elements that are boilerplate by class."""
    live = [n for n in nodes if not n.dropped and n.text != " "]
    count = len(elements.parent)
    held = [0] * count
    if any(elements.marked) and live:
        content = content_paths(live)
        for n in live:
            if n.path in content:
                held[n.element] += len(n.text)
        plain = held[0]
        inside = [False] * count
        for e in range(1, count):
            inside[e] = elements.marked[e] or inside[elements.parent[e]]
            plain += 0 if inside[e] else held[e]
        for e in range(count - 1, 0, -1):
            held[elements.parent[e]] += held[e]
        wide = {e for e in range(1, count) if 2 * held[e] > held[0] and not elements.answers[e]}
        # The article or main element with most of the text clears what is around it, unless the unmarked part of the page has more.
        holders = [e for e in range(1, count) if elements.holder[e]]
        if holders:
            e = max(holders, key=lambda h: (held[h], -h))
            if inside[e] and held[e] > plain:
                while e > 0:
                    wide.add(e)
                    e = elements.parent[e]
    else:
        wide = set()
    bad = [False] * count
    for e in range(1, count):
        bad[e] = bad[elements.parent[e]] or elements.marked[e] and e not in wide
    for n in nodes:
        n.dropped = n.dropped or bad[n.element]


def main_text(page: str) -> str:
    """The main text of a page: blocks in page order, one per line; empty if there is none.

    Headers are left out wherever they stand, those of an article too.
    """
    nodes, trie, elements = text_nodes(page)
    boilerplate_dropped(nodes, elements)
    live = [n for n in nodes if not n.dropped and n.text != " "]
    if not live:
        return ""
    content = content_paths(live)
    # The element that holds most of the text on content paths, an article or main element first.
    sizes: Counter = Counter()
    for n in live:
        if n.path in content:
            sizes[n.path] += len(n.text)
    held = trie.summed(sizes)
    holders = [p for p in range(1, len(held)) if held[p] and trie.tag(p) in HOLDERS]
    if holders:
        root = max(holders, key=lambda p: (held[p], -trie.depth[p]))
        above, at = set(), root
        while at >= 0:
            above.add(at)
            at = trie.parent[at]
        inside = trie.under({root})
        others = {p for p in holders if not inside[p] and p not in above and trie.tag(p) == trie.tag(root)}
        kept = trie.under({root, *others})
        chosen = {n.path for n in live if kept[n.path]}
    else:
        over = [False] * len(held)
        for path in content:
            path = trie.parent[path]
            while path >= 0 and not over[path]:
                over[path] = True
                path = trie.parent[path]
        root = max((p for p in range(len(held)) if over[p] and 2 * held[p] > held[0]), key=lambda p: trie.depth[p], default=0)
        inside = trie.under({root})
        chosen = {p for p in content if inside[p]}
        chosen |= {n.path for n in live if inside[n.path] and re.match(r"h[1-6]\b", trie.label[n.path])}
        if not chosen:
            chosen = content
    blocks: dict[int, list[str]] = defaultdict(list)
    for n in nodes:
        if not n.dropped and n.path in chosen:
            blocks[n.block].append(n.text)
    lines = (SPACE.sub(" ", "".join(parts)).strip(" ") for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns ``keep``, ``text`` and ``n_chars`` of every row.

    Null html counts as empty; a page without main text has the empty text and
    no characters.  Rows stay apart whatever their id or url; an empty table
    gives an empty result, and other columns are not read.
    """
    carried = [id_col, *keep]
    rows = pages.select(*carried, text_of(html_col).alias("__html"))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            texts = [main_text(x) for x in batch["__html"]]
            yield batch[carried].assign(text=texts, n_chars=[len(x) for x in texts])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", text string, n_chars long"
    return rows.mapInPandas(extracted, schema)
