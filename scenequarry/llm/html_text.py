"""Layout-aware text of HTML pages.

A small tree builder supplies the tags that authors leave out and drops what isn't shown; the renderer
then walks the tree: blocks are apart, paragraphs by an empty line, list items carry a marker
and their depth, cells of a table stand in columns. Each page is one row's work; Spark spreads the pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
EXACT = frozenset("pre xmp textarea plaintext listing".split())
HIDDEN = frozenset("script style title head template noscript iframe noembed noframes audio video canvas datalist progress meter rp meta link base param".split())
BLOCK = frozenset("plaintext listing address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("plaintext listing p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr xmp menu dir".split())
#: An opening tag closes an open element on the left, looked for up to the elements on the right.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("plaintext listing address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
P_SCOPE = frozenset("table td th caption button html object".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: Elements of SVG and MathML that show nothing themselves, and those with HTML inside.
FOREIGN_HIDDEN = {"svg": frozenset("clippath defs desc filter lineargradient marker mask metadata pattern radialgradient script style symbol title".split()), "math": frozenset("annotation annotation-xml script style".split())}
HTML_INSIDE = {"svg": frozenset("desc foreignobject title".split()), "math": frozenset("mi mn mo ms mtext".split())}
#: Opening one of these ends an open SVG or MathML element.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements whose attributes say how they show.
KEPT = frozenset("select option optgroup ol li td th details".split())
#: Elements nested deeper are put on this level; their text stays.
MAX_DEPTH = 200

# As the tokenizer of the HTML standard has it: a quote opens a value only right after "=", elsewhere it is a character like others.
_VALUE = r"""[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+)?+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|--!>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_VALUE})?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+))?+)?+""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    """``visible``: whether its own text shows; ``space``: svg, math or none; ``attributes`` are kept for lists and cells only."""

    __slots__ = ("tag", "children", "hidden", "visible", "space", "attributes")

    def __init__(self, tag: str, hidden: bool = False, visible: bool = True, space: str = "", attributes: dict[str, str] | None = None):
        self.tag, self.hidden, self.visible, self.space, self.attributes = tag, hidden, visible, space, attributes or {}
        self.children: list[Node | str] = []


def _style(style: str) -> dict[str, str]:
    """display and visibility as a style attribute sets them: the last declaration holds, an important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", style).lower().split(";"):
        name, _, value = part.partition(":")
        if (name := name.strip()) in ("display", "visibility"):
            body, bang, word = value.partition("!")
            important = bool(bang) and word.strip() == "important"
            if (important or not bang) and body.strip() and important >= found.get(name, (False, ""))[0]:
                found[name] = important, body.strip()
    return {k: v for k, (_, v) in found.items()}


def build_tree(html: str) -> tuple[Node, str]:
    """The page's element tree, and its title."""
    root = Node("html")
    stack, title, at, n = [root], "", 0, len(html)

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def text(value: str) -> None:
        if not value:
            return
        # Text after a head that was never closed begins the body.
        if stack[-1].tag == "head" and value.strip():
            close({"head"}, set())
        put(unescape(value))

    def put(value: str) -> None:
        # In SVG only what stands in a text element is drawn.
        at_end = stack[-1]
        if at_end.visible and (at_end.space != "svg" or at_end.tag in HTML_INSIDE["svg"] or any(x.tag == "text" and x.space == "svg" for x in stack)):
            at_end.children.append(value)

    def foreign() -> str:
        """svg or math where a tag is read by their rules."""
        return "" if stack[-1].tag in HTML_INSIDE.get(stack[-1].space, ()) else stack[-1].space

    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if foreign() and found[0].startswith("<![CDATA["):
                end = html.find("]]>", found.start())
                put(html[found.start() + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        if foreign() and tag in (("br", "p") if found[1] else ENDS_FOREIGN):
            while foreign():
                stack.pop()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            else:
                close({tag}, {"td", "th", "table", *(("ul", "ol", "menu", "dir") if tag == "li" else ())} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") else set())
            continue
        if tag in ("html", "head", "body") and tag != "head" and tag == "html":
            continue
        space = foreign()
        if stack[-1].tag == "head" and tag not in HEAD_ONLY and tag != "head":
            close({"head"}, set())
        if tag in ("input", "select", "textarea") and not space and any(x.tag == "select" for x in stack):
            close({"select"}, set())
            if tag == "select":
                continue
        if tag in ENDS_P and not space:
            close({"p"}, P_SCOPE)
        if tag in CLOSES and not space:
            close(*CLOSES[tag])
        if not space and tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        # Of repeated attributes the first holds.
        named = _ATTRIBUTE.findall(found[3]) if found[3] else []
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in reversed(named)}
        style = _style(unescape(attributes["style"])) if "style" in attributes else {}
        shown = style.get("visibility")
        space = tag if tag in ("svg", "math") else space
        hidden = tag in (FOREIGN_HIDDEN[space] if space else HIDDEN) or "hidden" in attributes or style.get("display") == "none" or (shown == "collapse" and tag in ("tr", "thead", "tbody", "tfoot"))
        visible = shown in ("visible", "initial") or (stack[-1].visible and shown not in ("hidden", "collapse"))
        # A dialog shows when open; of closed details only the first summary shows.
        # An object shows its fallback only where it names nothing to show.
        hidden = hidden or (not space and ((tag == "dialog" and "open" not in attributes) or (tag == "object" and bool(attributes.get("data")))))
        node = Node(tag, hidden, visible, space, attributes if tag in KEPT else None)
        stack[-1].children.append(node)
        if space:
            # A slash at the end of a bare value belongs to the value.
            single = found[3].endswith("/") and not (named and named[-1][3] and found[3].endswith(named[-1][3]))
            if not single and len(stack) < MAX_DEPTH:
                stack.append(node)
        elif tag == "plaintext":
            if not hidden and visible:
                node.children.append(html[at:])
            at = n
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            inner = html[at : end.start() if end else n]
            at = end.end() if end else n
            if tag == "title" and not title:
                title = _BLANK.sub(" ", unescape(inner)).strip()
            if not hidden and visible:
                node.children.append(unescape(inner) if tag == "textarea" else inner)
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root, title


class _Lines:
    """Lines as they grow: white space collapses, at most one empty line stands between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.blank = False

    def word(self, value: str) -> None:
        if not value:
            return
        if value[0] in " \t\n\r\f":
            self.gap = True
        body = _BLANK.sub(" ", value).strip(" ")
        if body:
            if self.gap and self.line:
                self.line.append(" ")
            self.line.append(body)
            self.gap = value[-1] in " \t\n\r\f"

    def exact(self, value: str) -> None:
        for i, part in enumerate(value.replace("\r\n", "\n").split("\n")):
            if i:
                self.end(keep=True)
            if part:
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        text = "".join(self.line)
        self.line, self.gap = [], False
        if text.strip() or keep:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done.append(text.rstrip())

    def space(self) -> None:
        self.end()
        self.blank = True

    def result(self) -> list[str]:
        self.end()
        return self.done


def _width(text: str) -> int:
    return sum(2 if east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _number(node: Node, name: str, least: int, most: int, default: int) -> int:
    """An attribute that is a whole number, within bounds."""
    found = re.match(r"[ \t\n\r\f]*([+-]?\d{1,9})", node.attributes.get(name, ""))
    return max(least, min(most, int(found[1]))) if found else default


def _table(node: Node, depth: int) -> list[str]:
    """Rows as lines, the table's cells on a grid of columns two blanks apart.

    A cell's lines stand below each other from its first row on. A cell that spans rows keeps its columns in the rows below, to the end of its
    row group at most; one that spans columns is as wide as they are together. A column is as wide as its widest cell, and wider if a spanning one asks for it.
    """
    groups: list[list[list[tuple[list[str], int, int]]]] = [[]]
    captions, below, todo = [], [], [(c, 0) for c in reversed(node.children)]
    while todo:
        x, level = todo.pop()
        if isinstance(x, str):
            if x.strip():
                captions += render_lines(_wrap([x]), depth + 1)
        elif x.hidden:
            continue
        elif x.tag == "tr":
            cells, loose = [], []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if not c.hidden:
                        cells.append((render_lines(c, depth + 1), _number(c, "colspan", 1, 1000, 1), _number(c, "rowspan", 0, 65534, 1)))
                elif not isinstance(c, str) or c.strip():
                    loose.append(c)
            if loose:
                captions += render_lines(_wrap(loose), depth + 1)
            if cells:
                groups[-1].append(cells)
        elif x.tag in ("thead", "tbody", "tfoot"):
            groups.append([])
            todo += [(c, level + 1) for c in reversed(x.children)]
        elif x.tag == "caption" and "bottom" in x.attributes.get("align", ""):
            below += render_lines(_wrap([x]), depth + 1)
        else:
            captions += render_lines(_wrap([x]), depth + 1)
    # Each row's cells by column: (first column, columns, lines).
    rows: list[list[tuple[int, int, list[str]]]] = []
    for group in groups:
        # Columns that cells above still hold, as rising stretches: first, end, and the row from which they are free.
        taken: list[tuple[int, int, int]] = []
        for r, cells in enumerate(group):
            placed, new, at, i = [], [], 0, 0
            for lines, wide, high in cells:
                while i < len(taken) and taken[i][0] <= at:
                    at, i = max(at, taken[i][1]), i + 1
                placed.append((at, wide, lines))
                # No cell reaches beyond its group.
                free = len(group) if high == 0 else min(r + high, len(group))
                if free > r + 1:
                    new.append((at, at + wide, free))
                at += wide
            rows.append(placed)
            taken = _stretches([x for x in taken if x[2] > r + 1], new)
    edges = sorted({e for placed in rows for at, wide, _ in placed for e in (at, at + wide)})
    place = {e: i for i, e in enumerate(edges)}
    widths = [0] * max(0, len(edges) - 1)
    spans = [(place[at], place[at + wide], max(map(_width, lines), default=0)) for placed in rows for at, wide, lines in placed]
    for first, last, need in sorted(spans, key=lambda s: s[1] - s[0]):
        lack = need - sum(widths[first:last]) - 2 * (last - first - 1)
        if lack > 0:
            widths[last - 1] += lack
    start = [0]
    for w in widths:
        start.append(start[-1] + w + 2)
    out = captions
    for placed in rows:
        if not any(lines for _, _, lines in placed):
            continue
        for k in range(max(len(lines) for _, _, lines in placed)):
            line, used = [], 0
            for at, _, lines in placed:
                if k < len(lines) and lines[k]:
                    line.append(" " * max(start[place[at]] - used, 2 if line else 0) + lines[k])
                    used = max(start[place[at]], used + 2 if len(line) > 1 else 0) + _width(lines[k])
            out.append("".join(line).rstrip())
    return out + below


def _stretches(old: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Held columns in order and without overlaps; where old and new stretches meet, the later release holds. Neighbours with one release are one."""
    if not new:
        return old
    out: list[tuple[int, int, int]] = []
    edges = sorted({e for a, b, _ in old + new for e in (a, b)})
    both, i, j = (sorted(old), sorted(new)), 0, 0
    for a, b in zip(edges, edges[1:]):
        while i < len(both[0]) and both[0][i][1] <= a:
            i += 1
        while j < len(both[1]) and both[1][j][1] <= a:
            j += 1
        free = max((x[k][2] for x, k in ((both[0], i), (both[1], j)) if k < len(x) and x[k][0] <= a), default=0)
        if free and out and out[-1][1] == a and out[-1][2] == free:
            out[-1] = (out[-1][0], b, free)
        elif free:
            out.append((a, b, free))
    return out


def _words(node: Node) -> str:
    """All text below a node, on one line."""
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or not x.hidden:
            todo += reversed(x.children)
    return _BLANK.sub(" ", "".join(parts)).strip(" ")


def _options(select: Node) -> list[str]:
    """What a select element shows: all options and group names of a list, of a menu the chosen option (the last one marked, or the first that can be chosen)."""
    options, todo = [], [(c, False) for c in reversed(select.children)]
    while todo:
        x, off = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag in ("option", "optgroup"):
            options.append((x, off or "disabled" in x.attributes))
        if x.tag != "option":
            todo += [(c, off or (x.tag == "optgroup" and "disabled" in x.attributes)) for c in reversed(x.children)]
    rows = select.attributes.get("size", "").strip()
    if not ("multiple" in select.attributes or (re.fullmatch(r"\d{1,9}", rows) and int(rows) > 1)):
        options = [(x, off) for x, off in options if x.tag == "option"]
        options = [(x, off) for x, off in options if "selected" in x.attributes][-1:] or [(x, off) for x, off in options if not off][:1]
        options = [(x, off) for x, off in options if select.visible]
    else:
        options = [(x, off) for x, off in options if not x.hidden and x.visible]
    label = lambda x: _BLANK.sub(" ", unescape(x.attributes.get("label", ""))).strip(" ")
    return [s for x, _ in options for s in [label(x) or (_words(x) if x.tag == "option" else "")] if s]


def _wrap(children: list) -> Node:
    node = Node("div")
    node.children = children
    return node


def render_lines(node: Node, depth: int = 0) -> list[str]:
    """Visible text of a node, as lines."""
    out = _Lines()
    if depth > MAX_DEPTH:
        # Lists and tables nested that deep stand as plain lines.
        return [s for s in [_words(node)] if s]

    def walk(x: Node | str, pre: bool) -> None:
        if isinstance(x, str):
            (out.exact if pre else out.word)(x)
            return
        if x.hidden:
            return
        if x.tag == "br":
            out.end(keep=bool(out.done or out.line))
            return
        if x.tag in ("ul", "ol", "menu", "dir", "table"):
            out.space()
            _add(_table(x, depth) if x.tag == "table" else _items(x))
            out.space()
            return
        if x.tag == "select":
            shown = _options(x)
            if len(shown) == 1:
                out.word(shown[0])
            elif shown:
                out.end()
                _add(shown)
            return
        if x.tag == "details" and not x.space and "open" not in x.attributes:
            out.end()
            for child in [c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1] or ["Details"]:
                walk(child, pre)
            out.end()
            return
        block = x.tag in BLOCK if not x.space else x.tag == "text" and x.space == "svg"
        if block:
            (out.space if x.tag in SPACED else out.end)()
        for child in x.children:
            walk(child, pre or x.tag in EXACT)
        if block:
            (out.space if x.tag in SPACED else out.end)()

    def _add(lines: list[str]) -> None:
        for line in lines:
            out.line.append(line)
            out.end(keep=True)

    def _items(x: Node) -> list[str]:
        # Numbers count up from the start, or down from the number of items; an item's own value sets the count.
        own = [c for c in x.children if isinstance(c, Node) and c.tag == "li" and not c.hidden]
        step = -1 if x.tag == "ol" and "reversed" in x.attributes else 1
        lines, number = [], _number(x, "start", -(10**9), 10**9, len(own) if step < 0 else 1)
        for child in x.children:
            if isinstance(child, str):
                lines += [f"  {s}" for s in [_BLANK.sub(" ", child).strip()] if s]
            elif not child.hidden:
                inner = [s for s in render_lines(child if child.tag == "li" else _wrap([child]), depth + 1) if s]
                if child.tag == "li":
                    number = _number(child, "value", -(10**9), 10**9, number) if x.tag == "ol" else number
                mark = (f"{number}. " if x.tag == "ol" else "- ") if child.tag == "li" else "  "
                number += step * (child.tag == "li")
                lines += [(mark if i == 0 else " " * len(mark)) + s for i, s in enumerate(inner)]
        return lines

    for child in node.children:
        walk(child, node.tag in EXACT)
    return out.result()


def render(html: str | None) -> tuple[str, str]:
    """Title and visible text of a page; both empty for null, empty or invisible pages."""
    root, title = build_tree(html or "")
    return title, "\n".join(render_lines(root)).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_chars for every row of ``pages(page_id, html)``.

    Null or empty pages have an empty title and text. Broken mark-up never fails: an unclosed tag ends with the
    page, unknown tags are inline. Repeated rows are rendered each; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [render(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([x for _, x in made], pa.string()), pa.array([len(x) for _, x in made], pa.int64())], ["page_id", "title", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, title string, text string, n_chars long")
