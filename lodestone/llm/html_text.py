"""Visible text of HTML by layout: tree builder, visibility rules, and a renderer.

The tree builder implies the end tags that HTML lets authors leave out and ignores stray ones. The
renderer keeps what a reader would see: paragraphs apart, lists with their marks, table cells in
aligned columns, preformatted text as it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A quote opens a value only right after "="; elsewhere in a tag it is a character like others.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+"""
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:" + re.sub(r"\((?!\?)", "(?:", _VALUE) + r")?+)*+)(?:>|\Z)", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_ESCAPABLE = frozenset(("textarea", "title"))
_HIDDEN = frozenset("head title script style template noembed noframes iframe datalist object audio video canvas area".split())
_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
#: Elements that stand apart from what surrounds them by an empty line, and those that only begin a line.
_APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu fieldset".split())
_BLOCK = _APART | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav option section summary search tr caption xmp optgroup".split())
#: A start tag of the set closes an open element of that name, unless one of the last set lies between.
_CLOSES = {
    **dict.fromkeys(_BLOCK - {"li", "dd", "dt", "option", "optgroup", "tr", "body", "html", "caption"}, (("p",), ("button", "td", "th", "caption", "object"))),
    "li": (("li", "p"), ("ul", "ol", "menu", "td", "th")),
    "dt": (("dt", "dd", "p"), ("dl", "td", "th")),
    "dd": (("dt", "dd", "p"), ("dl", "td", "th")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot", "colgroup", "caption"), (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",))),
    "a": (("a",), ("td", "th", "table", "button")),
    "button": (("button",), ("td", "th")),
    "body": (("head",), ()),
}
#: An end tag looks no further up than these.
_SCOPE = {"li": ("ul", "ol", "menu"), **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), ("table",))}
_FENCE = frozenset(("table", "td", "th", "body", "html", "template"))
#: Deeper elements become children of the one at this depth, as in browsers.
DEEPEST = 512


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of a document or fragment; any input gives one."""
    root = Node("#root")
    stack, at = [root], 0

    def text(value: str) -> None:
        if value:
            if stack[-1].tag == "head" and value.strip():
                stack.pop()
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in names:
                del stack[k:]

    while True:
        match = _TAG.search(source, at)
        if match is None:
            text(source[at:])
            return root
        text(source[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            stops = _SCOPE.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in stops or stack[k].tag in _FENCE and tag not in _SCOPE and tag not in _FENCE:
                    break
            if tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if stack[-1].tag == "head" and tag not in _HEAD:
            stack.pop()
        node = Node(tag, _attributes(match[3]) if match[3] else {})
        stack[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW or tag in _ESCAPABLE:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            inside = source[at : end.start() if end else len(source)]
            node.children.append(html.unescape(inside) if tag in _ESCAPABLE else inside)
            at = end.end() if end else len(source)
            continue
        if tag == "plaintext":
            node.children.append(source[at:])
            return root
        if len(stack) < DEEPEST:
            stack.append(node)


def _hiding(root: Node) -> list[tuple[str, frozenset[str], str]]:
    """Tag, classes and id of the simple selectors that style sheets of the page hide."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            for selectors, body in _RULE.findall("".join(c for c in node.children if isinstance(c, str))):
                if _HIDES.search(body):
                    for selector in selectors.split(","):
                        if (m := _SIMPLE.fullmatch(selector.strip())) and m[0]:
                            marks = re.findall(r"([.#])([\w-]+)", m[2])
                            found.append(((m[1] or "").lower(), frozenset(v for k, v in marks if k == "."), next((v for k, v in marks if k == "#"), "")))
        todo += [c for c in node.children if isinstance(c, Node)]
    return found


_Steps = Generator["_Steps", object, object]


def _finish(steps: _Steps):
    """Result of a generator that yields others and receives their results: calls without Python's own stack."""
    stack, value = [steps], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(call)
            value = None
    return value


class _Renderer:
    """Each step that renders what is nested yields that step and receives its lines (see ``_finish``)."""

    def __init__(self, rules: list[tuple[str, frozenset[str], str]]):
        self.rules = rules
        #: Whether the content last rendered wants an empty line before and after it.
        self.edges = (False, False)

    def hidden(self, node: Node) -> bool:
        own = node.attributes
        if node.tag in _HIDDEN or "hidden" in own and own["hidden"] != "until-found" or node.tag == "dialog" and "open" not in own:
            return True
        if "style" in own and _HIDES.search(own["style"]):
            return True
        if not self.rules:
            return False
        classes = set(own.get("class", "").split())
        return any((not t or t == node.tag) and c <= classes and (not i or i == own.get("id")) for t, c, i in self.rules)

    def lines(self, children: list) -> _Steps:
        """Lines of a node's content; an empty line stands between paragraphs."""
        out: list[str] = []
        run: list[str] = []
        gap = lead = False

        def flush() -> None:
            joined = "".join(run)
            run.clear()
            for k, line in enumerate(joined.split("\n")):
                line = _BLANKS.sub(" ", line).strip(" ")
                if line or k:
                    add([line])

        def add(more: list[str]) -> None:
            nonlocal gap, lead
            lead = lead or gap and not out
            if gap and out and out[-1] and more and more[0]:
                out.append("")
            if more:
                gap = False
            out.extend(more)

        def inside(items: list, before: str = "", after: str = "") -> _Steps:
            nonlocal gap
            if before:
                run.append(before)
            for item in items:
                if isinstance(item, str):
                    run.append(_BLANKS.sub(" ", item))
                    continue
                if self.hidden(item):
                    continue
                tag = item.tag
                if tag == "br":
                    run.append("\n")
                elif tag == "input":
                    if item.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                        run.append(item.attributes.get("value", ""))
                elif tag in _BLOCK or tag in ("tbody", "thead", "tfoot"):
                    flush()
                    self.edges = (False, False)
                    own = yield self.block(item)
                    first, last = (True, True) if tag in _APART else self.edges
                    gap = gap or first
                    add(own)
                    gap = gap or last
                elif tag == "q":
                    yield inside(item.children, "“", "”")
                elif tag in ("td", "th"):
                    yield inside(item.children, "\t", " ")
                elif tag == "textarea":
                    run.append(" ".join(c for c in item.children if isinstance(c, str)))
                else:
                    yield inside(item.children)
            if after:
                run.append(after)

        yield inside(children)
        flush()
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        self.edges = (lead, gap)
        return out

    def block(self, node: Node) -> _Steps:
        if node.tag in ("ul", "ol", "menu"):
            return (yield self.list_(node))
        if node.tag == "table":
            return (yield self.table(node))
        if node.tag in ("pre", "xmp"):
            return _strip_lines(self.plain(node).removeprefix("\n").split("\n"))
        children = node.children
        if node.tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary" and not self.hidden(c)]
        own = yield self.lines(children)
        if node.tag in ("dd", "blockquote"):
            return _indented(own)
        return own

    def plain(self, node: Node) -> str:
        out, todo = [], [node]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag == "br":
                out.append("\n")
            elif item is node or not self.hidden(item):
                todo.extend(reversed(item.children))
        return "".join(out)

    def list_(self, node: Node) -> _Steps:
        out: list[str] = []
        start = node.attributes.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        loose: list = []

        def outside() -> _Steps:
            if loose:
                own = yield self.lines(list(loose))
                out.extend(_indented(own))
                loose.clear()

        for child in node.children:
            if not (isinstance(child, Node) and child.tag == "li"):
                loose.append(child)
                continue
            yield outside()
            if self.hidden(child):
                continue
            value = child.attributes.get("value", "")
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            found = yield self.lines(child.children)
            own = [line for line in found if line] or [""]
            out.append((mark + own[0]).rstrip())
            out.extend(_indented(own[1:]))
        yield outside()
        return out

    def table(self, node: Node) -> _Steps:
        """Text outside rows, captions, then a line per row of cells, each column as wide as its widest cell."""
        captions: list[str] = []
        rows: list[Node] = []
        loose: list = []
        todo = list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    loose.append(child)
            elif self.hidden(child):
                continue
            elif child.tag == "caption":
                captions.extend((yield self.lines(child.children)))
            elif child.tag == "tr":
                rows.append(child)
                loose.extend(c for c in child.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag not in ("td", "th") and not self.hidden(c))
            elif child.tag in ("td", "th"):
                if not rows or rows[-1].attributes is not _IMPLIED:
                    rows.append(Node("tr", _IMPLIED))
                rows[-1].children.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo.extend(reversed(child.children))
            elif child.tag not in ("colgroup", "col"):
                loose.append(child)
        grid: list[list[list[str]]] = []
        below: dict[int, int] = {}
        for row in rows:
            cells: list[list[str]] = []

            def skip() -> None:
                while below.get(len(cells), 0) > 0:
                    below[len(cells)] -= 1
                    cells.append(_EMPTY)

            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th") or self.hidden(cell):
                    continue
                skip()
                wide, high = _span(cell.attributes.get("colspan", ""), 1, _WIDEST), _span(cell.attributes.get("rowspan", ""), 0, _HIGHEST)
                own = yield self.lines(cell.children)
                for k in range(wide):
                    if high != 1:
                        # No number of rows means all that are left.
                        below[len(cells)] = (high or _HIGHEST + 1) - 1
                    cells.append(_EMPTY if k else own)
            skip()
            grid.append(cells)
        widths: dict[int, int] = {}
        for cells in grid:
            for k, cell in enumerate(cells):
                widths[k] = max(widths.get(k, 0), max(map(len, cell), default=0))
        out = (yield self.lines(loose)) + captions
        for cells in grid:
            for k in range(max(map(len, cells), default=0)):
                out.append("  ".join((c[k] if k < len(c) else "").ljust(widths[n]) for n, c in enumerate(cells) if widths[n]).rstrip())
        return out


_IMPLIED: dict[str, str] = {}
_EMPTY: list[str] = []
#: The most columns and rows that a cell spans.
_WIDEST, _HIGHEST = 1000, 65534


def _span(value: str, least: int, most: int) -> int:
    """A span as a page's number: white space and a plus before it, its leading digits count; 1 without any, or below ``least``."""
    digits = re.match(r"[ \t\n\f\r]*\+?([0-9]+)", value)
    number = min(int(digits[1].lstrip("0")[:9] or "0"), most) if digits else 1
    return number if number >= least else 1


#: Columns that lines are indented at most; what lies deeper stands there.
_INDENT = 80


def _indented(lines: list[str]) -> list[str]:
    return ["  " + line if line and not line.startswith(_MARGIN) else line for line in lines]


_MARGIN = " " * _INDENT


def _strip_lines(lines: list[str]) -> list[str]:
    lines = [line.rstrip() for line in lines]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return lines


def render(source: str | None) -> str:
    """The visible text of a page; empty for a null or empty one."""
    if not source:
        return ""
    root = parse(source)
    return "\n".join(_finish(_Renderer(_hiding(root)).lines(root.children)))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every row, from its whole source.

    A null or empty page has the empty text, and so has one with nothing visible. Broken markup is
    rendered as far as it goes, never rejected. Ids may be null or repeat; other columns are ignored;
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(h) for h in part.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
