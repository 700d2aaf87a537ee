"""Visible text of web pages, laid out: a tree builder with implied tags, then rendering.

`parse` reads markup as browsers do where it matters for text: start tags that imply ends
(a paragraph ends at the next block, an item at the next item, a cell at the next cell),
missing table parts, ends without a start, void elements, raw text, unfinished tags and
comments. `render` walks the tree: it leaves out what isn't shown (head, scripts, templates,
`hidden`, `display:none` and `visibility:hidden` in style attributes and in simple rules of
style sheets, closed details but for their summary, closed dialogs; of rules the important, then
the more specific, then the later one wins, and rules for media other than a screen of SCREEN
pixels don't apply), collapses white space
outside `pre`, puts blocks on lines of their own with a blank line around paragraphs,
headings, lists and tables, writes list items with bullets or numbers and nested indents, and
aligns the cells of table rows in columns.

Neither calls itself, so nesting may be as deep as it likes; each page is read whole and by
itself. A null page has null text, an empty one or one without visible text the empty text.
Repeated pages get equal texts; a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumeria.llm.frames import by_chunk

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist meta link base param source track svg math audio video canvas object area map rp".split())
#: Elements that end an open paragraph, and stand on lines of their own.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption dd dt html legend optgroup option tbody td tfoot th thead tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr fieldset".split())
#: A start tag ends the nearest open element of the second set, looked for up to one of the third.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "td", "th", "table")),
    "dt": (("dt", "dd"), ("dl", "td", "th", "table")),
    "dd": (("dt", "dd"), ("dl", "td", "th", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup",), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
#: A head that is left open goes on with these; any other start tag, and text, ends it.
HEAD_PARTS = frozenset("head title meta link style script base basefont bgsound template noscript noframes".split())
#: An end tag finds no element beyond these.
SCOPE = frozenset("table td th caption template html".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption colgroup".split())
BULLETS = ("-", "*", "+")
CELL_GAP = "  "
MOST_SPAN = 1000

#: Width and height in pixels that rules for screens are read for.
SCREEN = {"width": 1280, "height": 720}

_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/\"'][^\s=>/]*|[\"'=][^\s=>/]*)(?:\s*=\s*([\"']|[^\s>]+)?)?")
_TAG_SKIP = re.compile(r"[\s/]*")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_SHOWN = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)(?:\s+[\w-]+)*\s*(!\s*important)?", re.I)
_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_PIECE = re.compile(r"([^{};]*)([{};])")
_QUERY = re.compile(r"(?:(not|only)\s+)?(?:([a-z][a-z-]*)\b)?((?:\s*(?:and\s*)?\([^()]*\))*)")
_FEATURE = re.compile(r"\(\s*(?:(min|max)-)?(width|height)\s*(:|<=?|>=?)\s*([\d.]+)(px|r?em)\s*\)")
_SELECTOR = re.compile(r"(?:([a-zA-Z][a-zA-Z0-9]*)|\*)?(?:([.#])([\w-]+))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(text, data, {}), (start, tag, attributes), (end, tag, {}) in order of appearance."""
    at, size, plain = 0, len(html), 0
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        c = html[at + 1]
        close = c == "/"
        name = _NAME.match(html, at + 2 if close else at + 1)
        if name is None and c not in "!?/":
            at += 1
            continue
        if at > plain:
            yield "text", html[plain:at], {}
        if name is None:
            if html.startswith("<!--", at):
                # `<!-->` and `<!--->` are whole comments.
                end = html.find("-->", at + 2)
                end = end + 3 if end >= 0 else size
            else:
                end = html.find(">", at)
                end = end + 1 if end >= 0 else size
            at = plain = end
            continue
        tag, attributes, end = name.group().lower(), {}, name.end()
        while True:
            end = _TAG_SKIP.match(html, end).end()
            if end >= size:
                return
            if html[end] == ">":
                end += 1
                break
            found = _ATTRIBUTE.match(html, end)
            if found is None:
                end += 1
                continue
            key, value = found.group(1).lower(), found.group(2) or ""
            end = found.end()
            if value in ('"', "'"):
                quote = html.find(value, end)
                if quote < 0:
                    return
                value, end = html[end:quote], quote + 1
            attributes.setdefault(key, unescape(value) if "&" in value else value)
        at = plain = end
        if close:
            yield "end", tag, {}
            continue
        yield "start", tag, attributes
        if tag in RAW:
            stop = _RAW_END[tag].search(html, end)
            at = plain = stop.start() if stop else size
            if at > end:
                yield "raw", html[end:at], {}
    if plain < size:
        yield "text", html[plain:], {}


def parse(html: str) -> Node:
    """The tree of a page; its root is an `html` element."""
    root = Node("html", {})
    stack = [root]

    def close_to(tags: tuple[str, ...], stops: frozenset | tuple[str, ...]) -> None:
        """Ends the nearest open element among `tags`, unless one of `stops` comes first."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    def open_(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        stack.append(node)

    def end_head() -> None:
        while stack[-1].tag == "head":
            stack.pop()

    for kind, data, attributes in tokens(html):
        top = stack[-1]
        if kind in ("text", "raw"):
            if kind == "text" and "&" in data:
                data = unescape(data)
            if kind == "text" and top.tag == "head" and _SPACES.sub("", data):
                end_head()
                top = stack[-1]
            if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not data.strip():
                continue
            top.children.append(data)
            continue
        tag = data
        if kind == "start":
            if tag in ("html", "body"):
                if tag == "body":
                    close_to(("head",), ())
                    if any(n.tag == "body" for n in stack):
                        continue
                    open_(tag, attributes)
                else:
                    root.attributes.update(attributes)
                continue
            if tag not in HEAD_PARTS:
                end_head()
            if tag in ENDS_PARAGRAPH or tag == "p":
                if stack[-1].tag != "html" and stack[-1].tag not in SCOPE:
                    close_to(("p",), SCOPE)
            if tag in IMPLIED_ENDS:
                close_to(*IMPLIED_ENDS[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr", {})
            if tag in VOID:
                stack[-1].children.append(Node(tag, attributes))
            else:
                open_(tag, attributes)
        elif tag == "p" and not any(n.tag == "p" for n in stack):
            stack[-1].children.append(Node("p", {}))
        elif tag == "br":
            stack[-1].children.append(Node("br", {}))
        elif tag not in ("html", "body") and tag not in VOID:
            stops = frozenset(("table", "html")) if tag in TABLE_PARTS - {"table"} else frozenset(("html",)) if tag == "table" else SCOPE
            close_to((tag,), stops - {tag})
    return root


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on the screen; a query with a feature that isn't known does not."""

    def holds(query: str) -> bool:
        found = _QUERY.fullmatch(query.strip().lower())
        if found is None or found[2] == "and":
            return False
        told = [_FEATURE.fullmatch(f) for f in re.findall(r"\([^()]*\)", found[3])]
        if None in told:
            return False
        met = found[2] in (None, "all", "screen")
        for least, side, sign, size, unit in (f.groups() for f in told):
            size = float(size if size.count(".") < 2 and size != "." else 0) * (1 if unit == "px" else 16)
            sign = {"min": ">=", "max": "<="}.get(least, sign)
            met &= {">=": SCREEN[side] >= size, "<=": SCREEN[side] <= size, ">": SCREEN[side] > size, "<": SCREEN[side] < size, ":": SCREEN[side] == size}[sign]
        return met != (found[1] == "not")

    return not media.strip() or any(holds(q) for q in media.split(","))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules of a style sheet that apply to the screen; those inside of rules have no selectors."""
    sheet = _NOTE.sub(" ", sheet)
    # What is open: whether it applies, and its selectors and declarations if it is a rule.
    opened: list[tuple[bool, str | None, list[str]]] = [(True, None, [])]
    for before, mark in _PIECE.findall(sheet + "}" * sheet.count("{")):
        applies, selectors, body = opened[-1]
        if mark == "{":
            name, _, rest = before.strip().partition(" ")
            name = name.lower()
            if name.startswith("@media"):
                opened.append((applies and on_screen(before.strip()[6:]), None, []))
            elif name.startswith("@"):
                opened.append((applies and (name == "@layer" or name == "@supports" and not rest.lower().startswith("not")), None, []))
            else:
                opened.append((applies, before if selectors is None else "", []))
            continue
        if selectors is not None:
            body.append(before)
        if mark == "}" and len(opened) > 1:
            opened.pop()
            if applies and selectors:
                yield selectors, ";".join(body)


def declared(body: str) -> Iterator[tuple[str, str, bool]]:
    """(display or visibility, value, whether important) of a list of declarations."""
    for name, value, important in _SHOWN.findall(_NOTE.sub(" ", body) if "/*" in body else body):
        yield name.lower(), value.lower(), bool(important)


class Page:
    """What is hidden on a page by its attributes and by rules of its style sheets."""

    def __init__(self, root: Node) -> None:
        #: By (tag, `.` or `#`, name): for each property the weight and the value of its strongest rule.
        self.rules: dict[tuple[str | None, str | None, str | None], dict[str, tuple[tuple, str]]] = {}
        self.order = 0
        #: Elements that are visible, or hold one that is, though they may stand in one that is not.
        self.reveals: set[int] = set()
        nodes, above = [root], [0]
        for k, node in enumerate(nodes):
            for child in node.children:
                if isinstance(child, Node):
                    nodes.append(child)
                    above.append(k)
        for node in self._sheets(root):
            self._read("".join(x for x in node.children if isinstance(x, str)))
        shown = any(rule["visibility"][1] not in ("hidden", "collapse") for rule in self.rules.values() if "visibility" in rule)
        if shown or any("visibility" in n.attributes.get("style", "").lower() for n in nodes if n.attributes):
            for k in range(len(nodes) - 1, -1, -1):
                if id(nodes[k]) in self.reveals or self.shows(nodes[k])[1]:
                    self.reveals |= {id(nodes[k]), id(nodes[above[k]])}

    @staticmethod
    def _sheets(root: Node) -> Iterator[Node]:
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                if on_screen(node.attributes.get("media", "")):
                    yield node
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def _read(self, sheet: str) -> None:
        for selectors, body in style_rules(sheet):
            told = list(declared(body))
            for selector in selectors.split(",") if told else ():
                found = _SELECTOR.fullmatch(selector.strip())
                if not found or not found.group() and selector.strip() != "*":
                    continue
                tag, mark, name = found.groups()
                rule = self.rules.setdefault((tag and tag.lower(), mark, name), {})
                for key, value, important in told:
                    # Rules come in order, so of equal ones the later wins.
                    self.order += 1
                    weight = (important, mark == "#", mark == ".", tag is not None, self.order)
                    if key not in rule or weight > rule[key][0]:
                        rule[key] = weight, value

    def shows(self, node: Node) -> tuple[bool, bool | None]:
        """Whether an element is displayed, and whether it is visible; None is as visible as what it stands in."""
        if node.tag in HIDDEN:
            return False, None
        own = node.attributes
        if not own and not self.rules:
            return node.tag != "dialog", None
        best: dict[str, tuple[tuple, str]] = {}
        if "hidden" in own or node.tag == "dialog" and "open" not in own:
            best["display"] = (), "none"
        if self.rules:
            names = [(None, None)]
            names += [("#", own["id"])] if "id" in own else []
            names += [(".", c) for c in own.get("class", "").split()]
            for rule in (self.rules.get((tag, *n)) for n in names for tag in (None, node.tag)):
                for key, told in rule.items() if rule else ():
                    if key not in best or told[0] > best[key][0]:
                        best[key] = told
        for key, value, important in declared(own["style"]) if "style" in own else ():
            # A style attribute is stronger than any selector.
            weight = (important, 2)
            if key not in best or weight >= best[key][0]:
                best[key] = weight, value
        displayed = best["display"][1] != "none" if "display" in best else True
        if node.tag == "input" and own.get("type", "").lower() == "hidden":
            displayed = False
        seen = best["visibility"][1] if "visibility" in best else "inherit"
        return displayed, None if seen in ("inherit", "unset", "revert") else seen not in ("hidden", "collapse")


class Canvas:
    """Lines of text that grow word by word; every part of a table cell has its own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.marker = ""

    def words(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if text == " ":
            self.space = True
            return
        if text[0] == " ":
            self.space = True
            text = text[1:]
        after = text[-1] == " "
        if self.line and self.space:
            self.line.append(" ")
        self.line.append(text[:-1] if after else text)
        self.space = after

    def kept(self, text: str) -> None:
        """Preformatted text."""
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.line.append(first)
        for line in rest:
            self.end_line(True)
            if line:
                self.line.append(line)

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            if self.blank and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.blank = False
            head = self.indent
            if self.marker:
                head, self.marker = self.indent[: -len(self.marker)] + self.marker, ""
            self.lines.append((head + "".join(self.line)).replace("\xa0", " ").rstrip())
            self.line = []
        self.space = False

    def margin(self) -> None:
        self.end_line()
        self.blank = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def _span(node: Node) -> int:
    told = node.attributes.get("colspan", "1").strip()
    return min(MOST_SPAN, max(1, int(told))) if told.isdecimal() and len(told) < 6 else 1


def aligned(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Lines of a table: each cell (columns, lines) in its columns, as wide as their widest cell."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for span, lines in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], *map(len, lines), 0)
            at += span
    for row in rows:
        at = 0
        for span, lines in row:
            own = sum(widths[at : at + span]) + len(CELL_GAP) * (span - 1)
            widths[at + span - 1] += max(0, max(map(len, lines), default=0) - own) if span > 1 else 0
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line, at = [], 0
            for span, lines in row:
                own = sum(widths[at : at + span]) + len(CELL_GAP) * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(own))
                at += span
            out.append(CELL_GAP.join(line).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    page = Page(root)
    canvases = [Canvas()]
    tables: list[list[list[tuple[int, list[str]]]]] = []
    lists: list[list[int | None]] = []
    kept = 0
    todo: list[tuple[str, Node | str, object]] = [("open", root, None)]
    while todo:
        act, node, saved = todo.pop()
        canvas = canvases[-1]
        if isinstance(node, str):
            if saved:
                continue
            if kept:
                canvas.kept(node)
            elif node:
                canvas.words(node)
            continue
        tag = node.tag
        if act == "close":
            if tag == "pre":
                kept -= 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("td", "th"):
                cell = canvases.pop().done()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((_span(node), cell))
                continue
            if tag == "table":
                lines = aligned(tables.pop())
                canvas.margin()
                for line in lines:
                    canvas.line.append(line)
                    canvas.end_line(True)
            if tag in BLOCK:
                canvas.end_line()
                if saved is not None:
                    # An item without text shows its marker all the same.
                    if canvas.marker:
                        canvas.end_line(True)
                    canvas.indent = saved
                if tag in SPACED and not (lists and tag in ("ul", "ol", "dl")):
                    canvas.blank = True
            continue
        displayed, visible = page.shows(node)
        # Of what opens, `saved` tells whether it stands in something invisible.
        unseen = bool(saved) if visible is None else not visible
        if not displayed or unseen and id(node) not in page.reveals:
            continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options, stack = [], [node]
            while stack:
                x = stack.pop()
                stack += [c for c in reversed(x.children) if isinstance(c, Node)]
                if x.tag == "option":
                    options.append(x)
            shown = [o for o in options if "selected" in o.attributes] or options[:1]
            children = [x for o in shown for x in o.children]
        elif tag == "br":
            canvas.end_line(True)
            continue
        elif tag == "input":
            value = node.attributes.get("value") or node.attributes.get("placeholder", "")
            if value.strip() and node.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image", "color", "range"):
                canvas.words(value)
            continue
        elif tag == "hr":
            canvas.margin()
            canvas.line.append("---")
            canvas.margin()
            continue
        saved = None
        if tag in ("td", "th") and tables:
            canvases.append(Canvas())
        elif tag == "table":
            canvas.end_line()
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th"):
            # A cell outside of a table is a block.
            node = Node("div", {})
            node.children = children
            canvas.end_line()
        elif tag in BLOCK:
            if tag in SPACED and not (lists and tag in ("ul", "ol", "dl")):
                canvas.margin()
            else:
                canvas.end_line()
            if tag == "pre":
                kept += 1
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            elif tag in ("ul", "menu", "dir"):
                lists.append([None])
            elif tag == "ol":
                told = node.attributes.get("start", "1").strip()
                lists.append([int(told) if told.lstrip("-").isdecimal() and len(told) < 10 else 1])
            elif tag == "li":
                own = lists[-1] if lists else [None]
                if canvas.marker:
                    canvas.end_line(True)
                if own[0] is None:
                    canvas.marker = BULLETS[(max(len(lists), 1) - 1) % len(BULLETS)] + " "
                else:
                    canvas.marker = f"{own[0]}. "
                    own[0] += 1
                canvas.marker = "" if unseen else canvas.marker
                saved, canvas.indent = canvas.indent, canvas.indent + " " * len(canvas.marker)
            elif tag in ("blockquote", "dd"):
                saved, canvas.indent = canvas.indent, canvas.indent + "  "
        elif tag == "textarea":
            children = [c for c in children if isinstance(c, str)]
        todo.append(("close", node, saved))
        todo += [("open", c, unseen) for c in reversed(children)]
    while len(canvases) > 1:
        canvases.pop()
    return "\n".join(canvases[0].done())


def visible_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """The pages with their visible text."""
    pages = pages.drop(name)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [visible_text(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
        return part.append_column(name, pa.array(made, pa.string()))

    return pages.mapInArrow(by_chunk(work, column), T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text")
