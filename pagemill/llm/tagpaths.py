"""HTML extraction: the main text of a page by tag-path ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import slices, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: A comment, a declaration, or a tag with its attributes; what is cut off at the end runs to it.
MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*(?:>|\Z)|[^>]*(?:>|\Z))|</[^>]*(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names and words of class, id and role.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no sections: a container is looked for above them.
PARTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hgroup address details summary".split())
ASIDE = frozenset("nav footer aside form head select button dialog menu svg canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments commentlist reply replies discussion respond disqus related recommended recommendations share sharing social widget widgets toolbar pagination pager skip".split()
)
NAME_PARTS = re.compile(r"[a-z0-9]+")
#: Elements that never fall out by class or id.
KEPT = frozenset(("html", "body", "article", "main"))
#: An opened element closes these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_BORDER = frozenset(["td", "th", "button", "object", "caption", "body"])
BLANK = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")

#: Nodes on either side that smoothing takes in, and the share of a standard deviation that a node
#: must exceed.
RADIUS, SHARE = 2, 1.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold the whole page, side matter too.
WHOLE = frozenset(("", "html", "body", "main"))


@dataclass
class Element:
    name: str
    parent: int
    out: bool  # menu, header, footer, side matter
    path: int  # number of its tag path from the root
    depth: int
    linked: bool  # in a link
    article: int  # the nearest article that it is or is in, 0 for none


@dataclass
class Node:
    """A run of text between tags: its element, block number and text."""

    element: int
    block: int
    text: str


def aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether the element holds side matter by its name, role, class or id."""
    if name in ASIDE:
        return True
    if name == "header":
        return not in_article
    if not attributes or name in KEPT:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key == "hidden":
            return True
        if key in ("class", "id", "role"):
            words = NAME_PARTS.findall((m[2] or m[3] or m[4] or "").lower())
            if not (ROLES if key == "role" else NAMES).isdisjoint(words):
                return True
    return False


def shredded(html: str) -> tuple[list[Element], list[Node]]:
    """Elements and text nodes in page order; end tags that are left out are put in."""
    elements = [Element("", -1, False, 0, 0, False, 0)]
    nodes: list[Node] = []
    paths: dict[tuple[int, str], int] = {}
    stack, block = [0], 0
    opened: Counter[str] = Counter()

    def closed(k: int) -> None:
        opened.subtract(elements[i].name for i in stack[k:])
        del stack[k:]

    def text_of(raw: str) -> None:
        if raw and not raw.isspace():
            nodes.append(Node(stack[-1], block, unescape(raw)))
        elif raw and nodes and nodes[-1].block == block:
            nodes[-1].text += " "

    position, size = 0, len(html)
    while position < size:
        m = MARKUP.search(html, position)
        if m is None:
            text_of(html[position:])
            break
        text_of(html[position : m.start()])
        position = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        whole = m[0].endswith(">")
        if m[1]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == name), 0) if opened[name] > 0 else 0
            if found and whole:
                if not INLINE.issuperset(elements[i].name for i in stack[found:]):
                    block += 1
                closed(found)
            elif name not in INLINE:
                block += 1
            continue
        if not whole:
            continue  # a tag cut off by the end of the page
        if name not in INLINE:
            block += 1
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():  # block elements end an open paragraph
                if elements[stack[k]].name == "p":
                    closed(k)
                    break
                if elements[stack[k]].name in P_BORDER:
                    break
        if name in CLOSES:
            ends, border = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[e] > 0 for e in ends) else ():
                if elements[stack[k]].name in border:
                    break
                if elements[stack[k]].name in ends:
                    closed(k)
                    break
        if name == "br" or name == "hr" or name == "img":
            if nodes and nodes[-1].block == block and name != "img":
                nodes[-1].text += " "
            continue
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, position)
            position = close.end() if close else size
            continue
        if m[3].endswith("/>") and name in ("svg", "path", "g", "use", "rect", "circle"):
            continue
        up = elements[stack[-1]]
        out = up.out or aside(name, m[3][:-1], up.article > 0)
        stack.append(len(elements))
        opened[name] += 1
        path = paths.setdefault((up.path, name), len(paths) + 1)
        article = stack[-1] if name == "article" else up.article
        elements.append(Element(name, stack[-2], out, path, up.depth + 1, up.linked or name == "a", article))
    return elements, nodes


def selected(elements: list[Element], nodes: list[Node]) -> tuple[list[bool], list[bool]]:
    """Of each node whether it is content by tag-path ratios, and whether it is on the main path.

    Over the nodes of each root-to-leaf path the mean text length and the mean punctuation are
    taken; each node gets the logarithms of those of its path (one very long node would raise the
    threshold above all others), smoothed over its neighbours; the fused value is their
    product, lessened by the path's share of linked text. A path whose nodes' mean value is above a
    share of the standard deviation is content with all its nodes. Of these paths the one with most
    text outside links, times the root of its number of nodes, is the main one; text of less than a
    punctuation mark a node counts less.
    """
    lengths = np.array([len(n.text.strip()) for n in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in nodes], float)
    linked = np.array([elements[n.element].linked for n in nodes], float)
    numbers: dict[int, int] = {}
    path = np.array([numbers.setdefault(elements[n.element].path, len(numbers)) for n in nodes])
    count = np.bincount(path)
    held = np.bincount(path, lengths)
    ratio, punctuation = held / count, np.bincount(path, marks) / count
    unlinked = 1 - np.bincount(path, lengths * linked) / np.maximum(1, held)
    window = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / (RADIUS / 2)) ** 2)

    def smooth(x: np.ndarray) -> np.ndarray:
        total = np.convolve(x, window)[RADIUS : RADIUS + len(x)]
        return total / np.convolve(np.ones(len(x)), window)[RADIUS : RADIUS + len(x)]

    fused = smooth(np.log1p(ratio[path])) * (1 + smooth(np.log1p(punctuation[path]))) * unlinked[path]
    value = np.bincount(path, fused) / count
    content = value >= SHARE * fused.std()
    main = int(np.where(content, held * np.sqrt(count) * np.minimum(1, punctuation + 0.1) * unlinked, -1).argmax())
    return content[path].tolist(), (path == main).tolist()


def container(elements: list[Element], nodes: list[Node], main: list[bool]) -> int:
    """The deepest section that holds all nodes of the main path; the article around it, if any."""
    count = [0] * len(elements)
    for n, own in zip(nodes, main):
        count[n.element] += own
    for i in range(len(elements) - 1, 0, -1):
        count[elements[i].parent] += count[i]
    best = max((i for i, c in enumerate(count) if c == count[0]), key=lambda i: (elements[i].depth, i))
    while best and elements[best].name in PARTS:
        best = elements[best].parent
    return elements[best].article or best


@dataclass
class Part:
    """What an element beside or in the container holds."""

    heading: bool = True  # nothing but headings
    content: bool = False  # a content node
    deep: bool = False  # a content node in an element of its own
    main: bool = False
    size: int = 0
    linked: int = 0


def children(elements: list[Element], nodes: list[Node], up: int, content: list[bool], main: list[bool]) -> dict[int, Part]:
    """The children of the element *up* that hold text."""
    child, heading = [0] * len(elements), [False] * len(elements)
    for i in range(1, len(elements)):
        above = elements[i].parent
        child[i] = i if above == up else child[above]
        heading[i] = heading[above] or elements[i].name in HEADINGS
    parts: dict[int, Part] = {}
    for n, chosen, own in zip(nodes, content, main):
        if at := child[n.element]:
            part = parts.setdefault(at, Part())
            part.heading &= heading[n.element]
            part.content |= chosen
            part.deep |= chosen and n.element != at
            part.main |= own
            part.size += len(n.text)
            part.linked += len(n.text) * elements[n.element].linked
    return parts


def article(elements: list[Element], nodes: list[Node]) -> tuple[set[int], set[int]]:
    """Elements whose text is the article, and elements in these that are not.

    The container of the main path goes whole, but for sections of mostly linked text without
    content. If it is the page's body, sections before the first and after the last that hold the
    main path stay only if they hold content in elements of their own. Beside the container
    headings before it stay; unless it is an article, also paragraphs, lists and the like that are
    content, and sections on the container's own tag path that hold content in elements of theirs.
    """
    content, main = selected(elements, nodes)
    root = container(elements, nodes, main)
    kept, dropped = {root}, set()
    own = elements[root]
    if root:
        for i, part in children(elements, nodes, own.parent, content, main).items():
            e = elements[i]
            if i < root and part.heading:
                kept.add(i)
            elif i != root and own.name not in WHOLE and own.name != "article":
                if part.content if e.name in PARTS and part.linked * 2 < part.size else e.path == own.path and part.deep:
                    kept.add(i)
    if own.name != "article":
        inside = children(elements, nodes, root, content, main)
        holding = [i for i, part in inside.items() if part.main] or [root]
        for i, part in inside.items():
            if elements[i].name in PARTS or part.main or part.heading:
                continue
            if not part.content and part.linked * 2 > part.size:
                dropped.add(i)
            elif own.name in WHOLE and not min(holding) < i < max(holding) and not part.deep:
                dropped.add(i)
    return kept, dropped


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there is none."""
    if not html:
        return ""
    elements, nodes = shredded(html)
    nodes = [n for n in nodes if not elements[n.element].out]
    if not nodes:
        return ""
    kept, dropped = article(elements, nodes)
    inside = [False] * len(elements)
    inside[0] = 0 in kept
    for i in range(1, len(elements)):
        inside[i] = i in kept or inside[elements[i].parent] and i not in dropped
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if inside[n.element]:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (BLANK.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page from its whole markup.

    What an element, role, class or id calls navigation, header, footer, side matter, advert,
    notice, form or reader comments goes first. Among the rest tag-path ratios select content, and
    the lowest section that holds the main path is the result (:func:`article`), whole, with the
    headings beside it. NULL, empty or textless markup gives an empty text; repeated rows come back
    as often as they came in. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            made = [main_text(h) for h in texts(part, "html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
