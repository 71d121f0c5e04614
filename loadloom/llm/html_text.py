"""The main text of web pages by tree scoring.

A tolerant tokenizer builds the tree of a page's blocks. Subtrees that are furniture by their element
or by a word of their class, id or role (menus, headers, footers, sidebars, notices, adverts, forms, comments) are cut; a furniture word
outweighs any other word of the same name. Each block left gives points for its length and commas to its container, half of
them to the next and less further up, and a container's points are discounted by its link density. ``article`` and ``main`` add
a few points and decide nothing else. From the best container the choice goes up to an ancestor that holds clearly more such points; its
blocks are kept, with those of its siblings that are not mostly links.

Optional end tags may be left out: a head ends where the body or its first content begins, a paragraph, list item or cell where the next one does, a button or select where a
block begins, a menu where the main part does. What a style hides is not seen. A container that begins with a heading for comments or replies is the readers'.

Defined results. A null or empty page, and one without text, gives an empty text. Markup
that never ends is read as text up to the end. Pages are taken whole, whatever their length. Repeated rows give equal results, an empty table none.
Of containers with equal points the one whose text begins first counts, an inner one before an outer one.
Columns of the input with the name of one of the operator's own are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import buffers, slices, without

#: Elements by their part in the layout of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu head".split())
#: Controls within a line, which hold no block; what a head holds; what can't stand within what.
INLINE = frozenset("button select".split())
OF_HEAD = frozenset("head title meta link base script style noscript template".split())
NEVER_WITHIN = {"main": {"nav", "aside", "header", "footer", "menu", "dialog"}, "article": {"nav", "menu"}, "nav": {"nav"}, "footer": {"nav", "footer"}, "body": {"head", "nav", "header", "aside"}}
LEAVES = frozenset("p li pre blockquote td th dd dt h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of class and id names. Furniture, words that undo it before it, and words with which "header" is an article's own.
AWAY = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|menubar|breadcrumbs?|header|masthead|topbar|footer|foot|sidebars?|aside|widgets?|related|recommend\w*|"
    r"shar(?:e|ing)|social|cookies?|consent|gdpr|notices?|popup|modal|overlay|subscri\w*|newsletter|signup|login|search|forms?|comments?|commentlist|disqus|respond|repl(?:y|ies)|pager|pagination|toolbar|skip"
)
UNDOES = frozenset("has with no not without".split())
OWN_HEADER = frozenset("article entry post story content title".split())
ADDS = frozenset("article main content post story entry body text".split())
#: Headings under which readers write, and styles that hide.
REPLIES = re.compile(r"\W*(?:(?:\d+|no|all|reader|readers'|user|latest|recent|join the|leave a|leave your|post a|add a|write a|view|show)\s+)*(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|commentaires?|comentarios?)\W*(?:\(?\d+\)?)?\W*", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: A block of fewer characters gives a small part of its points.
LEAST_PARAGRAPH, SHORT_SHARE = 25, 0.1
#: What article and main, and a name with a word of ADDS, add to the points of a container that has some.
ELEMENT_BONUS, NAME_BONUS = 5.0, 2.0
#: How much more points than the best container an ancestor must hold to take its place.
CLEARLY = 1.2


class Node:
    __slots__ = ("tag", "parent", "away", "sure", "title", "points", "total", "chars", "link_chars", "bonus")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        #: Furniture, and whether that is beyond doubt; whether a top heading stands below.
        self.away, self.sure, self.title = False, False, False
        #: Points as a container, points of all blocks below, and characters below, all of them and those in links.
        self.points, self.total, self.chars, self.link_chars, self.bonus = 0.0, 0.0, 0, 0, 0.0

    @property
    def density(self) -> float:
        """The share of its text that is in links."""
        return self.link_chars / max(1, self.chars)


@functools.lru_cache(maxsize=4096)
def judged(value: str) -> tuple[bool, bool]:
    """Whether a class or id attribute has a furniture word, and whether it has a word of content."""
    away = adds = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        joined = "".join(words)
        for before, word in zip(["", *words], [*words, ""], strict=True):
            adds = adds or word in ADDS
            if word and AWAY.fullmatch(word) and before not in UNDOES and not (word == "header" and OWN_HEADER.intersection(words)):
                away = True
        away = away or bool(AWAY.fullmatch(joined))
    return away, adds


def _new(tag: str, marks: str, parent: Node) -> Node:
    node = Node(tag, parent)
    node.away, node.sure = tag in FURNITURE, tag in FURNITURE and tag != "form"
    if tag in ("article", "main"):
        node.bonus = ELEMENT_BONUS
    elif tag == "header":
        # An article's own header holds its title; any other is the page's.
        up = parent
        while up.parent and up.tag not in ("article", "main"):
            up = up.parent
        node.away = node.sure = up.tag not in ("article", "main")
    elif tag == "h1":
        up = node
        while up and not up.title:
            up.title, up = True, up.parent
    if marks and tag not in ("html", "body", "main"):
        for name, a, b, c in _MARKS.findall(marks):
            name, value = name.lower(), a or b or c
            if name == "role":
                node.away = node.sure = node.away or value.lower() in ROLES
            elif name == "hidden" or name == "aria-hidden":
                node.away = node.sure = node.away or name == "hidden" or value.lower() == "true"
            elif name == "style":
                node.away = node.sure = node.away or bool(UNSEEN.search(value))
            elif name in ("class", "id"):
                away, adds = judged(value)
                node.away = node.away or away
                if adds and not away:
                    node.bonus = max(node.bonus, NAME_BONUS)
    return node


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """The text blocks, in page order: node, text, characters in links."""
    root = Node("html", None)
    stack = [root]
    out: list[tuple[Node, str, int]] = []
    buffer: list[tuple[str, bool]] = []
    links = 0
    at, end = 0, len(page)

    def text_in(lo: int, hi: int) -> None:
        if hi > lo and stack[-1].tag == "head" and not page[lo:hi].isspace():
            pop_to(len(stack) - 1)  # text begins the body
        if hi > lo and not stack[-1].sure:
            buffer.append((page[lo:hi], links > 0))

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
            if text:
                linked = len(" ".join(html.unescape(" ".join(t for t, is_link in buffer if is_link)).split())) if any(b for _, b in buffer) else 0
                out.append((stack[-1], text, min(linked, len(text))))
            buffer.clear()

    def pop_to(k: int) -> None:
        flush()
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text_in(at, end)
            break
        text_in(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if stack[-1].tag == "head" and tag not in OF_HEAD and not closing:
            pop_to(len(stack) - 1)  # the end of the head may be left out
        if stack[-1].tag in INLINE and not closing and (tag in BLOCK or tag in FURNITURE):
            stack.pop()  # a control that holds no block ends where one begins
        if tag in RAW:
            if not closing and not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
        elif tag == "br":
            buffer.append((" ", False))
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in INLINE:
            if not closing:
                stack.append(_new(tag, "", stack[-1]))
            elif stack[-1].tag == tag:
                stack.pop()
        elif closing:
            if tag in BLOCK or tag in FURNITURE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if tag == "p" or stack[k].tag in ("article", "main", "td", "th") and tag not in ("article", "main", "body", "html", "table", "tr", "section", "div"):
                        break
                links = 0
        elif tag in BLOCK or tag in FURNITURE:
            flush()
            links = 0
            if stack[-1].tag == "p":
                stack.pop()
            if tag in NEVER_WITHIN:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in NEVER_WITHIN[tag]:
                        pop_to(k)
                    elif stack[k].tag in ("article", "main", "body"):
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPE[tag]:
                        break
            if tag not in VOID:
                stack.append(_new(tag, m[3] or m[6] or "", stack[-1]))
    flush()
    return out


def _upward(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def points(text: str, linked: int) -> float:
    """What a block gives to its container."""
    got = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    return got if len(text) >= LEAST_PARAGRAPH else got * SHORT_SHARE


def outside_furniture(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks outside furniture. A form, or a node with a furniture name, that holds the page's title and most of its points is its frame."""
    all_points = 0.0
    for node, text, linked in found:
        if not any(n.sure for n in _upward(node)):
            got = points(text, linked)
            all_points += got
            for n in _upward(node):
                n.total += got
    seen: set[int] = set()
    for node, text, _ in found:
        around = node.parent
        # A heading that calls for replies, first in a container of its own, makes that theirs.
        if around and node.tag in HEADINGS and around.tag not in ("article", "main", "body", "html") and id(around) not in seen and REPLIES.fullmatch(text):
            around.away = around.sure = True
        seen.update(id(n) for n in _upward(node))
    is_away = lambda n: n.sure or n.away and not (n.title and 2 * n.total > all_points)
    return [x for x in found if not any(is_away(n) for n in _upward(x[0]))]


def best_container(found: list[tuple[Node, str, int]]) -> Node:
    """The node with the most points from its blocks, less its share of text in links."""
    scored: dict[int, Node] = {}
    for node, _, _ in found:
        for up in _upward(node):
            up.points, up.total, up.chars, up.link_chars = 0.0, 0.0, 0, 0
    for node, text, linked in found:
        got = points(text, linked)
        for up in _upward(node):
            up.chars += len(text)
            up.link_chars += linked
            up.total += got
        # A paragraph's container is the node around it; loose text scores for its own node.
        container = node.parent if node.tag in LEAVES and node.parent else node
        for depth, up in enumerate(_upward(container)):
            up.points += got / (1, 2)[depth] if depth < 2 else got / (3 * (depth - 1))
            scored[id(up)] = up
    return max(scored.values(), key=lambda n: (n.points + n.bonus) * (1 - n.density))


def main_text(page: str | None) -> str:
    """The blocks of the best container and its siblings, joined by line ends."""
    found = outside_furniture(blocks(page)) if page else []
    if not found:
        return ""
    best = best_container(found)
    top = best
    for up in _upward(best.parent):
        if up.total * (1 - up.density) >= CLEARLY * top.total * (1 - top.density):
            top = up
    around = top.parent
    framed = around is not None and around.tag not in ("html", "body")

    def kept(node: Node, text: str) -> bool:
        below = node
        for n in _upward(node):
            if n is top:
                return True
            if n is around:
                # A sibling; below the page's body it must be made of paragraphs or headings.
                return 2 * below.density <= 1 and (framed or node.tag in LEAVES)
            below = n
        return False

    return "\n".join(text for node, text, linked in found if kept(node, text))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` (its code points) in the place of the html."""
    base = without(df, *[n for n in ("text", "n_chars") if n != html_col.lower()])
    where = base.columns.index(html_col)
    rest = [f for f in base.schema.fields if f.name != html_col]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = buffers(batch.column(where))
            for i, j in slices(at):
                rows = batch.slice(i, j - i)
                texts = [main_text(p) for p in rows.column(where).to_pylist()]
                others = [c for k, c in enumerate(rows.columns) if k != where]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)
