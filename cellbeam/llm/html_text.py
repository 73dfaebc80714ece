"""HTML extraction by composite text density.

A page is parsed to a tree; every node gets its characters per tag, adjusted for
links; the densities of a node's children are summed; the subtree with the largest
sum holds the main text. The least density on the path from there to the body is
the threshold that other parts of the article must reach to be taken along.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER = frozenset("aside button dialog embed footer form head header iframe input label legend menu nav noscript object script select style svg template textarea title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe".split())
#: Of those, words that settle it for a single paragraph too; beside others its density decides.
SURE_WORDS = frozenset("ad ads advert adverts advertisement comment comments consent cookie cookies newsletter promo sponsor sponsored subscribe".split())
#: Elements that hold one piece of text rather than parts of a page.
PIECES = frozenset("a abbr b blockquote caption cite code em figcaption h1 h2 h3 h4 h5 h6 i li p pre q small span strong td th u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say where or how something stands; beside a boilerplate word they do not change a name.
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons column container group holder inner item items left link links list main message outer page panel primary right secondary section site slot small sticky text title top unit widget wrap wrapper".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("ul ol dl table select".split())
_ITEMS = frozenset(_CLOSES) | _CONTAINERS
_FENCE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())

_MARK_UP = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|"
_PLAIN = r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
#: A tag whose quoted values may hold ">", else one up to the next ">"; and the second form alone.
_TOKEN = re.compile(_MARK_UP + r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|""" + _PLAIN, re.S)
_SIMPLE = re.compile(_MARK_UP + r"()()()" + _PLAIN, re.S)
#: Tags whose quotes do not close before the page ends; after so many, quotes are not looked at.
BROKEN_QUOTES = 8
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Node:
    """An element. ``doubtful``: a piece of text with a name that density must confirm; ``p`` and ``item``: the
    nearest open paragraph, and list or table part, that it may close."""

    __slots__ = ("tag", "parent", "kids", "boiler", "named", "doubtful", "holds", "p", "item", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", boiler: bool, names: int = 0):
        self.doubtful = names == 1 and tag in PIECES
        self.tag, self.parent, self.named, self.holds = tag, parent, names > 0 and not self.doubtful, False
        self.boiler = boiler or self.named
        self.kids: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.p = self if tag == "p" else None if tag in _FENCE or parent is None else parent.p
        self.item = self if tag in _ITEMS else parent and parent.item


def _names(attrs: str) -> int:
    """Whether a class, id or role names boilerplate, by a whole name or one that adds only neutral words: 0 no, 1 yes, 2 for sure."""
    found = 0
    for m in _MARKS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = {x.strip("0123456789") for x in re.split(r"[_-]+", name)} - {""}
            if not BOILER_WORDS.isdisjoint(parts) and parts <= BOILER_WORDS | NEUTRAL_WORDS:
                found = max(found, 1 if SURE_WORDS.isdisjoint(parts) else 2)
    return found


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements end with their parents; stray end tags are skipped.

    An element whose name says boilerplate, and a form, is none if it holds the page's article or main element.
    Every step looks at open elements by counts and links only, no tag is searched beyond the page's last ">", and
    quotes that never close are given up after a few, so a page takes time in proportion to its length.
    """
    root = Node("html", None, False)
    here, at, n = root, 0, len(page)
    end, token, broken = page.rfind(">") + 1, _TOKEN, 0
    wide: Counter = Counter()  # open elements that an end tag may close from within others
    scopes = [Counter()]  # the rest, counted anew inside each fence

    def leave(to: Node) -> Node:
        """Close all open elements below ``to``."""
        up = here
        while up is not to:
            if up.tag in _FENCE:
                scopes.pop()
            (wide if up.tag in _FENCE or up.tag in BOILER else scopes[-1])[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        m = token.search(page, at, end) if at < end else None
        if m is None:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that never ends
        broken += m[5] is not None
        if broken == BROKEN_QUOTES:
            token = _SIMPLE
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in ("html", "body"):
            continue  # one tree serves for both
        if m[1] or m[4]:
            if (wide if tag in _FENCE or tag in BOILER else scopes[-1])[tag] > 0:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up.parent)
            continue
        attrs = m[3] or m[6] or ""
        if (tag in BLOCK or tag in BOILER) and here.p:
            here = leave(here.p.parent)
        if tag in _CLOSES:
            up = here.item
            while up and up.tag not in _CLOSES[tag] and up.tag not in _CONTAINERS:
                up = up.parent.item
            if up and up.tag in _CLOSES[tag]:
                here = leave(up.parent)
        node = Node(tag, here, tag in BOILER, _names(attrs) if attrs and tag not in ("article", "main") else 0)
        here.kids.append(node)
        if tag in ("article", "main"):
            up = here
            while up and not up.holds:
                up.holds = True
                if up.named or up.tag == "form":
                    up.boiler = up.tag in BOILER and up.tag != "form"
                up = up.parent
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, at, end)
            if tag not in BOILER:
                node.kids.append(page[at : close.start() if close else n])
            at = close.end() if close else n
            continue
        here = node
        (wide if tag in _FENCE or tag in BOILER else scopes[-1])[tag] += 1
        if tag in _FENCE:
            scopes.append(Counter())
    return root


def _chars(root: Node) -> int:
    """Characters below a node that are not boilerplate, the node itself apart."""
    total, todo = 0, [root]
    while todo:
        for k in todo.pop().kids:
            if type(k) is str:
                total += 0 if k.isspace() else len(k)
            elif not k.boiler:
                todo.append(k)
    return total


def open_forms(root: Node) -> None:
    """A form around most of the page's text is the page's frame, not a part of it."""
    rest, todo = _chars(root), [root]
    while todo:
        for k in todo.pop().kids:
            if type(k) is Node and not k.boiler:
                todo.append(k)
            elif type(k) is Node and k.tag == "form" and not k.named and _chars(k) > rest:
                k.boiler = False
                todo.append(k)


def measure(root: Node) -> None:
    """Counts and densities of all nodes but boilerplate, from the leaves up."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if type(k) is Node and not k.boiler)
    for node in reversed(order):
        for k in node.kids:
            if type(k) is str:
                node.chars += len(k) if k.isspace() is False else 0
            elif not k.boiler:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            # a base of 1 is its limit: no links at all, so the ratio below is large and only orders nodes
            node.density = c / t * math.log(c / lc * t / lt + 1) / math.log(base + 1)
        node.total = sum(k.density for k in node.kids if type(k) is Node and not k.boiler)


def _is_heading(node: Node) -> bool:
    """A heading, or an element whose whole text is in one."""
    while node.tag not in HEADINGS:
        kids = [k for k in node.kids if type(k) is Node and not k.boiler and k.chars]
        if len(kids) != 1 or kids[0].chars != node.chars:
            return False
        node = kids[0]
    return True


def main_nodes(root: Node) -> list[Node]:
    """The subtree of largest density sum, widened to whole articles and to siblings over the threshold.

    Of the page itself (body) only the siblings over the threshold are taken along, in page order; headings that
    stand before the chosen subtree in the elements around it belong to it. Pieces of text whose names hint at
    boilerplate go if they are mostly links, or, headings apart, not half as dense as the page's other pieces on average.
    """
    best, todo, doubtful, dense, pieces = root, [root], [], 0.0, 0
    while todo:
        node = todo.pop()
        if node.total > best.total:
            best = node
        if node.doubtful:
            doubtful.append(node)
        elif node.tag in PIECES and node.chars and node.tag in BLOCK:
            dense, pieces = dense + node.density, pieces + 1
        todo.extend(k for k in node.kids if type(k) is Node and not k.boiler)
    if not root.chars:
        return []
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for node in doubtful:
        node.boiler = 2 * node.link_chars > node.chars or node.tag not in HEADINGS and 2 * node.density * pieces < dense
    level = 0
    for i, node in enumerate(path):
        wider = 0 < i < len(path) - 1 and any(type(k) is Node and k is not path[i - 1] and not k.boiler and k.density >= threshold for k in node.kids)
        if wider or node.tag in ("article", "main"):
            level = i
    chosen = path[level]
    before: list[Node] = []
    after: list[Node] = []
    for i in range(len(path) - 1, level, -1):
        page, place = path[i] is root, before
        for k in path[i].kids:
            if k is path[i - 1]:
                place = after
            elif type(k) is Node and not k.boiler and k.chars and (page and k.density >= threshold or place is before and _is_heading(k)):
                place.append(k)
    return [*before, chosen, *after]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order: references decoded, white space made one space, no empty ones."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if type(x) is str:
            line.append(html.unescape(x) if "&" in x else x)
        elif x is None:
            flush()
        elif not x.boiler:
            if x.tag == "br":
                line.append(" ")
                continue
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return out


def extract_text(page: str) -> str:
    root = parse(page)
    open_forms(root)
    measure(root)
    return "\n".join(line for node in main_nodes(root) for line in blocks(node))


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text``, the main text of every whole page; empty if there is none.

    A null or empty page gives an empty text; repeated rows give repeated results. No shuffle.
    """
    src = df.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__html"):
                texts = [extract_text(x) if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
