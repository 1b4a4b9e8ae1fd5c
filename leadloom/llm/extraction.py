"""HTML extraction: a tree-structured graphical model over the DOM, with sum-product messages up and down."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages

#: A quotation mark opens a value only behind an equals sign, as in the HTML standard; possessive, so that no page is slow.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PIECE = re.compile(r"[a-z]+")

#: Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title select button head".split())
_RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
#: An open element of the value's tags ends where the key begins.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Where looking for an element that ends stops.
_SCOPE = frozenset("table ul ol dl div article section main aside body html td th nav header footer form blockquote".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "y", "n", "linked", "a", "b", "m", "ua", "ub", "da", "db", "p")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children, self.text, self.y = tag, attrs, parent, [], None, None
        self.n = self.linked = 0
        if parent is not None:
            parent.children.append(self)


def parse(html: str) -> Node:
    """The tree of a page; text stands in nodes of tag #text. Broken and cut off pages give the tree of what is there."""
    root = Node("#root", "", None)
    at, here = 0, root
    n = len(html)

    def add(raw):
        if raw and not raw.isspace():
            Node("#text", "", here).text = entities.unescape(raw)
        elif raw:
            Node("#text", "", here).text = " "

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            tail = html[at:]
            cut = re.search(r"<[/A-Za-z!?]", tail)  # a tag that the page's end cuts off
            add(tail[: cut.start()] if cut else tail)
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            x = here
            while x is not root and x.tag != name and not (x.tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "body", "html")):
                x = x.parent
            if x.tag == name:
                here = x.parent
            continue
        if name in _ENDS:
            x = here
            while x is not root and x.tag not in _ENDS[name] and x.tag not in _SCOPE - set(_ENDS[name]):
                x = x.parent
            if x.tag in _ENDS[name]:
                here = x.parent
                if name == "tr" and x.tag in ("td", "th") and here.tag == "tr":
                    here = here.parent
        elif name in BLOCK:  # a block ends an open paragraph
            x = here
            while x is not root and x.tag != "p" and x.tag not in BLOCK:
                x = x.parent
            if x.tag == "p":
                here = x.parent
        node = Node(name, m[3] or "", here)
        if name in _RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not m[0].endswith("/>"):
            here = node
    return root


def order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.children))
    return out


def amount(node: Node) -> str:
    """How much text a node holds, and which share of it is in links, as steps."""
    n = node.n
    if not n:
        return "l:x"
    share = node.linked / n
    step = 0 if n <= 25 else 1 if n <= 200 else 2 if n <= 1000 else 3
    if node.tag == "form":  # to fill in, or around a whole page
        return f"l:form:{step}"
    return f"l:{0 if share == 0 else 1 if share <= 0.3 else 2 if share <= 0.8 else 3}:{step}"


def kind(node: Node) -> str:
    """Which parent-child potential a node has: text and inline elements nearly always go with their parent."""
    return "text" if node.tag == "#text" else "inline" if node.tag in INLINE else "leafy" if node.tag in ("p", "li", "td", "th", "br", "img") else "block"


def features(node: Node) -> list[str]:
    """What is seen of a node: tag, pieces of class, id and role, amount of text and share of it in links.

    Text and plain inline elements show nothing of their own; what they hold counts for the block around.
    """
    if node.tag == "#text" or node.tag in INLINE and not node.attrs:
        return []
    out = [] if node.tag in INLINE or node.tag == "form" else ["g:" + node.tag]
    if node.tag in ("div", "section") and not any(k.lower() in ("class", "id", "role") for k, *_ in _ATTR.findall(node.attrs)):
        out.append("c:")
    if node.attrs:
        for k, *v in _ATTR.findall(node.attrs):
            if k.lower() in ("class", "id", "role"):
                out += ["c:" + p for p in _PIECE.findall("".join(v).lower())]
    if node.tag not in INLINE:
        out.append(amount(node))
    return out


def measure(nodes: list[Node]) -> None:
    for x in reversed(nodes):
        if x.text is not None:
            x.n = len(x.text.strip())
        else:
            x.n = sum(c.n for c in x.children)
            x.linked = x.n if x.tag == "a" else sum(c.linked for c in x.children)


def fit(pages: list[str]) -> dict:
    """Potentials from labelled pages: log P(child's state | parent's, kind of child) and log P(feature | state), smoothed."""
    moves: dict = defaultdict(lambda: [[1.0, 1.0], [1.0, 1.0]])
    seen, total, starts = [Counter(), Counter()], [0.0, 0.0], [1.0, 1.0]
    for page in pages:
        root = parse(page)
        nodes = order(root)
        measure(nodes)
        root.y = None
        for x in nodes:
            y = re.search(r'data-y="(\d)"', x.attrs)
            x.y = int(y[1]) if y else (x.parent.y if x.parent else None)
        for x in reversed(nodes):  # what holds article and other parts is article if any child is
            if x.y is None:
                x.y = max([c.y or 0 for c in x.children], default=0)
        for x in nodes:
            if x.tag in RAW:
                continue
            if x.parent is None:
                starts[x.y] += 1
            else:
                moves[kind(x)][x.parent.y][x.y] += 1
            for f in features(x):
                seen[x.y][f] += 1
                total[x.y] += 1
    words = set(seen[0]) | set(seen[1])
    emit = {f: [math.log((seen[s][f] + 0.1) / (total[s] + 0.1 * len(words))) for s in (0, 1)] for f in words}
    move = {k: [[math.log(c / sum(row)) for c in row] for row in rows] for k, rows in moves.items()}
    return {"emit": {f: b - a for f, (a, b) in emit.items()}, "move": move, "start": math.log(starts[1] / starts[0])}


class Potentials:
    """The fitted potentials in the form that messages use; what is seen of a tag and its attributes is looked up once."""

    def __init__(self, model: dict):
        self.emit = model["emit"]
        self.odds = math.exp(model["start"])
        self.move = {k: tuple(math.exp(v) for row in rows for v in row) for k, rows in model["move"].items()}
        self.known: dict[tuple[str, str], tuple[float, tuple]] = {}

    def of(self, node: Node) -> tuple[float, tuple]:
        """(score of tag and attributes, potential towards the parent)."""
        key = node.tag, node.attrs
        if (found := self.known.get(key)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            seen = sum(self.emit.get(f, 0.0) for f in features(node) if f[0] != "l")
            found = self.known[key] = seen, self.move.get(kind(node), (0.5, 0.5, 0.5, 0.5))
        return found


def marginals(nodes: list[Node], model: Potentials) -> None:
    """Sets p, P(article), of each node by one pass of messages from the leaves to the root and one back."""
    for x in reversed(nodes):
        seen, m = model.of(x)
        if x.tag != "#text" and x.tag not in INLINE:
            seen += model.emit.get(amount(x), 0.0)
        if seen > 0:
            a, b = math.exp(-min(seen, 30.0)), 1.0
        else:
            a, b = 1.0, math.exp(max(seen, -30.0))
        for c in x.children:
            a *= c.ua
            b *= c.ub
            z = a + b
            a /= z
            b /= z
        x.a, x.b, x.m = a, b, m
        x.ua, x.ub = m[0] * a + m[1] * b, m[2] * a + m[3] * b
    nodes[0].da, nodes[0].db = 1 / (1 + model.odds), model.odds / (1 + model.odds)
    for x in nodes:
        pa, pb = x.a * x.da, x.b * x.db
        x.p = pb / (pa + pb)
        for c in x.children:
            qa, qb = pa / c.ua, pb / c.ub  # all that x knows but what c told it
            z, m = qa + qb, c.m
            c.da, c.db = (qa * m[0] + qb * m[2]) / z, (qa * m[1] + qb * m[3]) / z


def extract(html: str | None, model: Potentials) -> str:
    """The article's blocks in page order, joined by newlines."""
    if not html:
        return ""
    root = parse(html)
    nodes = order(root)
    for x in nodes:
        x.children = [c for c in x.children if c.tag not in RAW]
    shown = order(root)
    measure(shown)
    marginals(shown, model)
    blocks, now = [], []

    def close():
        if now and (text := " ".join("".join(now).split())):
            blocks.append(text)
        now.clear()

    todo: list = [(root, False)]
    while todo:
        x, ends = todo.pop()
        if ends:
            close()
        elif x.text is not None:
            if x.p >= 0.5 or x.n == 0:
                now.append(x.text)
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCK:
                close()
                todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.children))
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html); the whole page counts.

    Null, empty and text-free pages give empty text; repeated rows are extracted alike; a null page_id or url
    stays null; further columns are ignored; an empty table gives no rows. The model is fitted from the
    labelled pages of html_pages, a fixed number.
    """
    model = model or fit(labelled_pages())

    def run(batches):
        import pyarrow as pa

        potentials = Potentials(model)
        for b in batches:
            text = [extract(x.as_py(), potentials) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
