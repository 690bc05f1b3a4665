"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: characters per tag, adjusted for how many
of them are links (composite text density). A node's density sum adds up its children's
densities, so the node with the greatest sum is the one that holds most text blocks. The
least density on its path to the body is the threshold: what reaches it elsewhere gives
its own best subtree too. Without links densities grow with a node's size, so a node of
several blocks, an article or a main also counts if its characters per tag reach the
least on that path. The headline just before the chosen nodes comes along.

Elements that say what they are (menus, headers, footers, sidebars, forms, scripts, styles)
are left out first, and so are containers that a whole class, id or role names so: every
word of ``cookie-notice`` or ``comment-list`` must be such a name or a word of place,
so ``has-sidebar``, ``social-theory`` and any paragraph stay. No name stands against
the text: what holds most of the text of a page's articles is not left out by name, and
where all that stays has less than a quarter of the text of one part that was left out (an
unclosed menu, a form around the page), that part is taken back. <article> and <main>
never choose the best node.

Character references are decoded, white space inside a block becomes one space, blocks
are joined by a line end. Null or empty pages have empty text. Each row is on its own,
so repeated rows repeat their result. Broken markup is read as browsers do, roughly:
unclosed elements end with their parent, stray end tags are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("script style noscript template nav aside footer form button select option input textarea iframe object svg canvas head title dialog menu noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"), "thead": ("tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "thead": ("table",)}
#: Words of class, id and role that name what is no part of an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies "
    "dialog disclaimer discussion disqus feedback footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall "
    "popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar tooltip topbar widget".split()
)
REMARKS = frozenset("comment comments commentlist discussion disqus replies respond".split())
#: Words that say where or what kind of box something is, and may stand beside a name.
PLACES = frozenset(
    "a area articles bar block bottom box button buttons center col column container content first form global group head heading icons inner item items js l last left list link links lg main "
    "mobile module new notice overlay page panel policy post posts primary r right row secondary section site sm sticky the title top unit us user widget wp wrap wrapper zone".split()
)
CONTAINERS = frozenset("article aside dd details div dl dt fieldset figure form footer header hgroup iframe li ol section span summary table tbody td th tr ul".split())
KEPT = frozenset("html body main article".split())
INLINE = frozenset("br b i em strong span wbr".split())
#: Why a node is left out: by its element, by name, by name as remarks, never shown.
ELEMENT, NAME, REMARK, UNSEEN = 1, 2, 3, 4
NEVER = frozenset("script style noscript template input textarea iframe object svg canvas head title noembed noframes select option button".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WANTED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)


class Node:
    __slots__ = ("tag", "parts", "parent", "why", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total", "peak")

    def __init__(self, tag: str, parent: Node | None, why: int = 0):
        self.tag, self.parent, self.why, self.skip, self.parts = tag, parent, why, why > 0, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.peak = self

    def children(self) -> list[Node]:
        return [p for p in self.parts if type(p) is Node]

    def text(self) -> int:
        return self.chars - self.link_chars


def _named(value: str) -> int:
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if any(w in NAMES for w in words) and all(w in NAMES or w in PLACES for w in words):
            return REMARK if any(w in REMARKS for w in words) else NAME
    return 0


def _unwanted(tag: str, attributes: str) -> int:
    if tag in NEVER:
        return UNSEEN
    why = ELEMENT if tag in DROPPED else 0
    if tag in KEPT and tag != "article" or not attributes or not _WANTED.search(attributes):
        return why
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role") and tag in CONTAINERS:
            why = max(why, _named(value))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return UNSEEN
    return why


def parse(page: str) -> Node:
    """Tree of a page; parts of a node are strings and nodes in page order."""
    root = node = Node("html", None)
    opened: dict[str, int] = {}  # open elements by tag, so that no walk up is in vain
    at, end = 0, len(page)

    def up_to(bottom: Node, top: Node) -> Node:
        while bottom is not top:
            opened[bottom.tag] -= 1
            bottom = bottom.parent
        return top

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = up_to(node, up.parent)
            continue
        if tag == "html":
            continue
        closed = CLOSES.get(tag, ())
        left = sum(opened.get(t, 0) for t in (*closed, "p")) if tag in BLOCK or closed else 0
        if left:
            stops = STOPS.get(tag, ())
            up = top = node
            while left and up.tag not in stops:
                left -= up.tag in closed or up.tag == "p"
                if up.tag in closed or (up.tag == "p" and tag in BLOCK):
                    top = up.parent
                    if up.tag in closed and up.tag == tag:
                        break
                elif up.tag in BLOCK and up.tag not in closed and not closed:
                    break
                up = up.parent
            node = up_to(node, top)
        child = Node(tag, node, _unwanted(tag, m[3]))
        node.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            child.parts.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _count(nodes: list[Node], skipping: bool) -> None:
    """Characters and tags of nodes (parents first), without what is never shown or, by skipping, left out."""
    for n in reversed(nodes):
        children = [c for c in n.children() if not (c.skip if skipping else c.why == UNSEEN)]
        n.chars = sum(len("".join(p.split())) for p in n.parts if type(p) is str) + sum(c.chars for c in children)
        n.tags = sum(c.tags + (c.tag not in INLINE) for c in children)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        else:
            n.link_chars, n.link_tags = sum(c.link_chars for c in children), sum(c.link_tags for c in children)


def _wanted(root: Node, enter=lambda n: not n.skip) -> list[Node]:
    """root and what is wanted below it, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if enter(n):
            out.append(n)
            stack.extend(n.children())
    return out


def _take_back(root: Node, every: list[Node]) -> None:
    """Correct what is left out where the text speaks against it."""
    _count(every, False)
    within: dict[Node, bool] = {root: False}
    articles = 0
    for n in every:
        own = n.tag in ("article", "main") and n.why < NAME
        if own and n.tag == "article" and not within[n]:
            articles += n.chars
        for c in n.children():
            within[c] = within[n] or own
    if not articles:
        articles = max((n.chars for n in every if n.tag == "main"), default=0)
    held: dict[Node, int] = {}
    blocks_: dict[Node, int] = {}
    for n in reversed(every):
        below = sum(held[c] for c in n.children())
        held[n] = max(below, n.chars if n.tag in ("article", "main") and n.why < NAME else 0)
        blocks_[n] = sum(blocks_[c] for c in n.children()) + (n.tag in ("p", "h1", "h2", "h3", "article", "main"))
    for n in every:
        if n.tag == "header" and n.why == 0:
            n.why, n.skip = (0, False) if within[n] else (ELEMENT, True)
        if n.why in (NAME, REMARK) or n.tag == "form" and n.why == ELEMENT:
            n.skip = not (articles and 2 * held[n] > articles)
    while True:
        stays, out = 0, []
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            n, linked = stack.pop()
            if n.skip:
                if n.why != UNSEEN:
                    out.append(n)
                continue
            linked = linked or n.tag == "a"
            if not linked:
                stays += sum(len("".join(p.split())) for p in n.parts if type(p) is str)
            stack.extend((c, linked) for c in n.children())
        back = max((n for n in out if n.text() > 4 * stays and blocks_[n] > 2 and (n.why != REMARK or held[n])), key=Node.text, default=None)
        if back is None:
            return
        back.skip = False


def measure(root: Node) -> list[Node]:
    """Densities of all wanted nodes, parents first."""
    _take_back(root, _wanted(root, lambda n: True))
    wanted = _wanted(root)
    _count(wanted, True)
    body = next((n for n in wanted if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for n in wanted:
        if n.chars:
            base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
            ratio = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            n.density = n.chars / max(n.tags, 1) * (math.log(max(ratio, 1)) / math.log(base) if base > 1 else math.log(max(ratio, 1)))
    for n in reversed(wanted):
        children = [c for c in n.children() if not c.skip]
        n.total = sum(c.density for c in children)
        n.peak = max([n, *(c.peak for c in children)], key=lambda m: m.total)
    return wanted


def content(root: Node) -> list[Node]:
    """Nodes that hold the main text, in page order."""
    wanted = measure(root)
    best = max(wanted, key=lambda n: (n.total, n.density))
    if not best.chars:
        return []
    if not best.total:
        best = max(wanted, key=lambda n: n.density)
    least, plain, up = math.inf, math.inf, best
    while up is not None:
        if up.chars:
            least, plain = min(least, up.density), min(plain, up.chars / max(up.tags, 1))
        up = up.parent

    def reaches(n: Node) -> bool:
        if n.density >= least:
            return True
        several = n.tag in ("article", "main") or sum(c.tag in BLOCK and c.chars > 0 and not c.skip for c in n.children()) > 1
        return several and n.chars / max(n.tags, 1) >= plain

    chosen = {best}
    top = next((n for n in wanted if n.tag == "body"), root)
    stack = [c for c in top.children() if not c.skip]
    while stack:
        n = stack.pop()
        if n.tag in BLOCK and n is not best and 2 * n.link_chars < n.chars and reaches(n):
            chosen.add(n.peak if n.peak.total else n)
        stack.extend(c for c in n.children() if not c.skip)
    out, stack = [], [root]
    headline = None
    while stack:
        n = stack.pop()
        if n in chosen:
            out.append(n)
        elif not n.skip:
            if not out and n.tag == "h1" and 2 * n.link_chars < n.chars:
                headline = n
            stack.extend(reversed(n.children()))
    if headline is not None and not any(m.tag == "h1" for n in out for m in _wanted(n)):
        out.insert(0, headline)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in nodes, white space made one space."""
    out: list[list[str]] = [[]]

    def walk(top: Node) -> None:
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                out.append([])
            elif type(item) is str:
                out[-1].append(html.unescape(item))
            elif item.tag == "br":
                out[-1].append(" ")
            elif not item.skip:
                if item.tag in BLOCK:
                    out.append([])
                    stack.append(None)
                stack.extend(reversed(item.parts))

    for n in nodes:
        out.append([])
        walk(n)
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    return "\n".join(blocks(content(parse(page))))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
