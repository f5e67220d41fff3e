"""HTML extraction: a tree builder and a renderer that keeps the layout of what is visible.

The builder knows void elements, raw-text elements (script, style, ...) and implied tags: a
block closes an open paragraph, an item closes an item, a cell a cell, a row a row, an
option an option; stray end tags are ignored. Hidden are the head, scripts, styles,
templates, fallbacks of embedded media, options that are not chosen, what SVG and MathML
hold beside their text (descriptions, definitions, annotations), and elements with an attribute ``hidden`` or a
style of ``display: none``, with their descendants; ``visibility: hidden`` hides text but
not that of descendants that are ``visible`` again.

The renderer emits all visible text: white space collapses, except in ``pre``; blocks start
new lines, paragraphs and headings stand between blank lines; list items carry a dash or
their number, indented by depth; cells of a table are aligned in columns, and what a cell
covers beyond its first column and row stays blank. Everything is
iterative, so any depth of nesting works, and linear in the page apart from table padding.

Defined cases: a null page gives null text; an empty or unparsable one gives what text it
has; tags that never close end with the page; rows that repeat are rendered each.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript datalist iframe noembed noframes object audio video canvas title meta link rp".split())
#: within these, until HTML begins again: what they hold beside what they show
FOREIGN = {"svg": frozenset("desc defs metadata symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option optgroup legend caption".split())
#: an opening tag closes these, up to the nearest of the elements behind the colon
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption button object template html".split())
_OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s/][^\s/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|\S*))?""")
_DECLARED = re.compile(r"""(?:[^;"'(]|"[^"]*"|'[^']*'|\((?:[^)"']|"[^"]*"|'[^']*')*\)|["'(])+""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_START = re.compile(r"\s*([+-]?\d{1,9})")
#: rows that collapse are taken out of their table
ROWS = frozenset("tr thead tbody tfoot".split())


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> Node:
    """The tree; text is kept as str among the children."""
    root = Node("html")
    stack, at = [root], 0
    where: dict[str, int] = {"html": 1}  # how many of each element are open

    def close(to: int) -> None:
        while len(stack) > to:
            where[stack.pop().tag] -= 1

    tag_at, last = _TAG, page.rfind(">")
    while True:
        m, look = None, at
        while not m and (o := _OPEN.search(page, look)) and (o.start() < last or page.startswith("<!--", o.start())):
            m = _OTHER.match(page, o.start()) or tag_at.match(page, o.start())
            if not m and tag_at is _TAG:  # a quote never closes: from here on tags end at the next ">"
                tag_at, look = _PLAIN, o.start()
            else:
                look = o.end()
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        if m.re is _OTHER:
            continue
        tag = m[2].lower()
        if m[1]:
            if where.get(tag) and tag != "html":
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if tag in BLOCK or not any(n.tag in SCOPE for n in stack[k + 1 :]):
                    close(k)
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and where.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    cut = k
                    if tag in ("li", "dt", "dd", "option"):
                        break
            if cut is not None:
                close(cut)
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not (m[3].endswith("/") and (where.get("svg") or where.get("math"))):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.kids.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else len(page)
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append(node)
            where[tag] = where.get(tag, 0) + 1


class Out:
    """Lines of text, with white space collapsed as pages show it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.space = False
        self.prefix = ""  # marker of an item, due with its first text
        self.indent = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first, True)
            for part in rest:
                self.end(True)
                self._put(part, True)
            return
        words = _SPACE.split(s)
        for i, w in enumerate(words):
            if i:
                self.space = True
            if w:
                self._put(w, False)

    def _put(self, s: str, pre: bool) -> None:
        if not s:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line.append("  " * max(0, self.indent - bool(self.prefix)) + self.prefix)
            self.prefix = ""
        elif self.space and not pre:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def end(self, forced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line) if forced else "".join(self.line).rstrip())
            self.line = []
        elif forced and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = 1

    def add(self, lines: list[str]) -> None:
        for s in lines:
            self._put(s, True)
            self.end(True)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def attributes(attrs: str) -> dict[str, str]:
    """Values by name, in lower case; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value))
    return out


def declarations(style: str) -> dict[str, str]:
    """Values of a style attribute by property; the last counts, but for important ones."""
    out: dict[str, str] = {}
    urgent = set()
    for part in _DECLARED.findall(_COMMENT.sub(" ", style)):
        name, colon, value = part.partition(":")
        name, (value, bang, _) = name.strip().lower(), value.lower().partition("!")
        if colon and (bang or name not in urgent):
            out[name] = value.strip()
            urgent |= {name} if bang else set()
    return out


def visible(node: Node, shown: bool = True) -> tuple[bool, bool]:
    """Whether the element is rendered at all, and whether its own text shows (``shown``: its parent's does)."""
    if node.tag in HIDDEN:
        return False, False
    named = attributes(node.attrs) if node.attrs else {}
    if "hidden" in named or (node.tag == "dialog" and "open" not in named):
        return False, False
    style = declarations(named["style"]) if "style" in named else {}
    seen = style.get("visibility")
    if style.get("display") == "none" or (seen == "collapse" and node.tag in ROWS):
        return False, False
    return True, (seen in ("visible", "initial") or (shown and seen not in ("hidden", "collapse")))


def chosen(select: Node) -> list:
    """What a select shows: all options of a list box, and of a menu what the last selected or else the first holds."""
    named = attributes(select.attrs)
    options, todo = [], list(reversed(select.kids))
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and visible(node)[0]:
            if node.tag == "option":
                options.append(node)
            else:
                todo += reversed(node.kids)
    if "multiple" in named or ((size := named.get("size", "").strip()).isdecimal() and int(size) > 1):
        return options
    first = [o for o in options if "disabled" not in attributes(o.attrs)] or options
    shown = ([o for o in options if "selected" in attributes(o.attrs)] or first[:1])[-1:]
    return [kid for o in shown for kid in o.kids]


def _span(named: dict[str, str], name: str, most: int) -> int:
    """How many columns or rows a cell covers; 0 rows are all that follow."""
    m = _START.match(named.get(name, ""))
    n = int(m[1]) if m else 1
    return most if n == 0 and name == "rowspan" else min(max(n, 1), most)


Cell = tuple[list[str], int, int]  # lines, columns and rows covered


def _grid(rows: list[list[Cell]]) -> list[list[tuple[list[str], bool]]]:
    """Cells (lines, whether over one column) by column: covered places are blank, columns in which no cell begins are left out."""
    placed: list[dict[int, tuple[list[str], bool]]] = []
    covered: dict[int, int] = {}
    for row in rows:
        cells, below, at = {}, {}, 0
        for lines, across, down in row:
            while at in covered:
                at += 1
            cells[at] = lines, across > 1
            if down > 1:
                below |= dict.fromkeys(range(at, at + across), down)
            at += across
        placed.append(cells)
        covered = {k: n - 1 for k, n in (covered | below).items() if n > 1}
    columns = sorted(set().union(*placed))
    return [[cells.get(k, ([], True)) for k in columns if k <= max(cells)] if cells else [] for cells in placed]


def _aligned(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells, in columns."""
    grid = _grid(rows)
    width = [0] * max(map(len, grid), default=0)
    for row in grid:
        for k, (cell, wide) in enumerate(row):
            if len(row) > 1 and not wide:
                width[k] = max(width[k], max(map(len, cell), default=0))
    out = []
    for row in grid:
        for i in range(max((len(c) for c, _ in row), default=0)):
            cells = [(c[i] if i < len(c) else "") for c, _ in row]
            out.append(" | ".join(c.ljust(width[k]) if k < len(cells) - 1 else c for k, c in enumerate(cells)).rstrip())
    return out


def render(root: Node) -> str:
    """Visible text of the tree. ``todo`` holds nodes to enter and actions to run on leaving."""
    outs = [Out()]
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []
    todo: list = [(root, False, True, "")]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, pre, shown, foreign = item
        out = outs[-1]
        if isinstance(node, str):
            if shown:
                out.text(node, pre)
            continue
        tag = node.tag
        rendered, shown = visible(node, shown)
        if not rendered or tag in FOREIGN.get(foreign, ()):
            continue
        if tag == "br":
            out.end(shown)
            continue
        if tag == "hr":
            out.block(False)
            continue
        if tag == "img":
            continue
        if tag in FOREIGN or (foreign == "svg" and tag == "foreignobject"):
            foreign = tag if tag in FOREIGN else ""
        kids = node.kids
        if tag == "select" or (foreign == "svg" and tag == "text"):  # these stand apart from what is around them
            out.space = True
            todo.append(lambda o=out: setattr(o, "space", True))
        if tag == "select":
            kids = chosen(node)
        elif tag == "textarea" and kids:
            kids = [kids[0].removeprefix("\r").removeprefix("\n")]
            out.block(False)
            todo.append(lambda o=out: o.block(False))
        pre = pre or tag in ("pre", "textarea")
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu") and lists)
        if tag in BLOCK and not (tag in ("td", "th", "tr") and tables):
            out.block(spaced)
            todo.append(lambda o=out, s=spaced: o.block(s))
        if tag in ("ul", "ol", "menu"):
            m = _START.match(attributes(node.attrs).get("start", "")) if tag == "ol" else None
            lists.append([tag, int(m[1]) if m else 1])
            out.indent += 1
            todo.append(lambda o=out: (lists.pop(), setattr(o, "indent", o.indent - 1)))
        elif tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            out.prefix = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            todo.append(lambda o=out: setattr(o, "prefix", ""))
        elif tag in ("dd", "blockquote"):
            out.indent += 1
            todo.append(lambda o=out: setattr(o, "indent", o.indent - 1))
        elif tag == "table":
            tables.append([])

            def leave(o=out):
                rows = tables.pop()
                o.end()
                o.add(_aligned(rows))

            todo.append(leave)
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            outs.append(Out())
            held, lists = lists, []

            named = attributes(node.attrs) if node.attrs else {}

            def leave_cell(row=tables[-1][-1], held=held, spans=(_span(named, "colspan", 1000), _span(named, "rowspan", 65534))):
                nonlocal lists
                row.append((outs.pop().done(), *spans))
                lists = held

            todo.append(leave_cell)
        todo += [(k, pre, shown, foreign) for k in reversed(kids)]
    return "\n".join(outs[0].done())


def to_text(page: str) -> str:
    return render(parse(page))


def _task(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [None if p is None else to_text(p) for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def extract_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``text``, one row for each row of ``pages``."""
    bound_batches(spark)
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_task, "id long, text string").withColumnRenamed("id", id_col)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page."""
    return extract_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
