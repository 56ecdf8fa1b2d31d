"""Layout-aware text of HTML (operator 3).

A tokenizer and a tree builder in the manner of browsers: void elements, raw
text elements, optional end tags (a `<p>` ends at the next block, `<li>`,
`<dt>`, `<td>`, `<tr>`, `<option>` at their siblings, table parts imply one
another), stray end tags are ignored, open elements end with the input. A quote
stands for a value only after `=`; one that is never closed is an ordinary
character, so the tag ends at its `>`.
Visibility: `hidden`, `display:none`, `visibility:hidden` in a style attribute
or in a rule of a `<style>` sheet whose selector is a tag, a class, an id or a
tag with a class or id, outside of `@media` queries other than `all` and
`screen` and of other conditional at-rules; `head`, `script`, `style`, `template`, `noscript` and
embedded media are never shown. A `<textarea>` shows its text, a button its
label, a `<select>` its selected option or else its first, all with `multiple`.

Rendering collapses white space, ends lines at blocks and `<br>`, leaves one
blank line around paragraphs, headings, lists, tables and quotes, marks list
items by `- ` or their number and indents nested ones, keeps `<pre>` as it is,
and pads table cells so that the columns of a table are aligned, ` | ` between.
What stands in a table outside of its cells comes before it, as browsers do.

Defined results: null html gives the empty text. Tags are case-insensitive,
unknown ones are inline. Very long and very deep pages: nothing recurses with
the depth of the page, and time grows with its length. For that, layout has
bounds that change no word and no visibility: a line's indent and marks stop growing at
`WIDEST` characters, a cell that is wider than that doesn't widen its column,
and a table inside of `DEEPEST_TABLE` others is laid out a cell a line.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import map_batches

WIDEST, DEEPEST_TABLE = 120, 8
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = frozenset("head script style template noscript title iframe noembed noframes object svg math datalist audio video canvas".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr caption ul search".split()
)
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu".split())
_ENDS_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend summary".split()) | {"legend", "summary"}
#: Opening one of these ends an open element of the set, looked for up to the given bounds.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
_BOUNDS = frozenset("table td th caption button object template html".split())

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<(?:[!?]|/[^A-Za-z])[^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=][^\s<>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_LONG_NUMBER = re.compile(r"&#0*([0-9]*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"(?:^|[;{\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?", re.S)
_CSS_MARK = re.compile(r"[{};]")
_SHOWN_MEDIA = frozenset(("", "all", "screen", "only screen", "only all"))
_SELECTOR = re.compile(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?\Z")


_PARTS = frozenset("tr td th tbody thead tfoot".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """parts: whether rows or cells of the table around it stand in the node."""

    __slots__ = ("tag", "attrs", "children", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.parts = False


def _unescape(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:  # a number of thousands of digits
        return entities.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m.group(1)[:9] or 0}", text))


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m.group(2) if m.group(2) is not None else m.group(3) if m.group(3) is not None else m.group(4) or ""
        out.setdefault(m.group(1).lower(), _unescape(value))
    return out


class _Builder:
    """The stack of open elements; the places of each tag in it, so that no search walks the stack."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    def text(self, piece: str) -> None:
        if piece:
            self.stack[-1].children.append(_unescape(piece))

    def last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.places[self.stack.pop().tag].pop()

    def close_to(self, tags, bounds) -> None:
        """Ends the innermost open element of tags and all in it, unless one of bounds is inside of it."""
        at = self.last(tags)
        if at and at >= self.last(bounds):
            self.cut(at)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        if tag in _PARTS:
            for above in reversed(self.stack):
                if above.parts or above.tag == "table":
                    break
                above.parts = True
        self.stack[-1].children.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree and the texts of its style sheets."""
    made = _Builder()
    stack, text, close_to, push = made.stack, made.text, made.close_to, made.push
    sheets: list[str] = []
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        m = _MARKUP.match(source, lt)
        if not m:  # a bare less-than sign
            text(source[at : lt + 1])
            at = lt + 1
            continue
        text(source[at:lt])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "p" and not made.places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close_to({tag}, _BOUNDS if tag not in _BOUNDS and tag not in ("tr", "tbody", "thead", "tfoot", "body") else {"html"})
            continue
        if tag in ("html", "body") and made.places.get(tag):
            continue
        if tag in _ENDS_P:
            close_to({"p"}, _BOUNDS)
        if tag == "body":
            close_to({"head"}, ())
        if tag in _SIBLINGS:
            close_to(*_SIBLINGS[tag])
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            made.cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        attrs = _attributes(m.group(3)) if m.group(3) and not m.group(3).isspace() else {}
        if tag in _VOID:
            stack[-1].children.append(Node(tag, attrs))
        elif tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
            inner = source[at : end.start() if end else size]
            if tag == "style" and _on_screen(attrs.get("media", "")):
                sheets.append(inner)
            node = Node(tag, attrs)
            node.children.append(_unescape(inner) if tag in ("textarea", "title") else inner)
            stack[-1].children.append(node)
            at = end.end() if end else size
        else:
            push(tag, attrs)
            if m.group(3).endswith("/") and tag in ("svg", "math", "path"):
                made.cut(len(stack) - 1)
    return made.root, sheets


def _on_screen(media: str) -> bool:
    """Whether a media list holds on every screen; conditions are taken as not met, so that nothing is hidden by them."""
    return any(" ".join(q.lower().split()) in _SHOWN_MEDIA for q in media.split(","))


def _rules(css: str) -> list[tuple[str, str]]:
    """(selectors, own declarations) of the style rules that always hold, at any depth of `@media screen` and `@layer`."""
    out, open_, at = [], [], 0  # open blocks: (holds, selectors or None, declarations)
    for m in [*_CSS_MARK.finditer(css), None]:
        piece, at, mark = (css[at : m.start()].strip(), m.end(), m.group()) if m else (css[at:].strip(), len(css), "")
        holds, selectors, own = open_[-1] if open_ else (True, None, [])
        if mark == "{":
            if piece.startswith("@"):
                word, query = (piece[1:].replace("(", " (", 1).split(None, 1) + ["", ""])[:2]
                shown = word.lower() == "layer" or (word.lower() == "media" and _on_screen(query))
                open_.append((holds and shown and selectors is None, None, []))
            else:  # a rule inside of a rule depends on its parent: it isn't judged
                open_.append((holds and selectors is None, piece, []))
            continue
        own.append(piece)
        for holds, selectors, own in [open_.pop()] if mark == "}" and open_ else open_[::-1] if not mark else []:
            if holds and selectors is not None:
                out.append((selectors, ";".join(own)))
    return out


def hiding_rules(sheets: list[str]) -> set[tuple[str, str, str]]:
    """(tag, kind, name) of selectors that hide; kind is `.`, `#` or empty."""
    out = set()
    for sheet in sheets:
        for selectors, body in _rules(_CSS_NOISE.sub(" ", sheet)):
            if _HIDES.search(body):
                for selector in selectors.split(","):
                    m = _SELECTOR.match(selector.strip())
                    if m and m.group():
                        out.add(((m.group(1) or "").lower(), m.group(2) or "", m.group(3) or ""))
    return out


def visible(node: Node, rules: set[tuple[str, str, str]]) -> bool:
    attrs = node.attrs
    if node.tag in _NEVER or "hidden" in attrs or ("style" in attrs and _HIDES.search(attrs["style"])):
        return False
    if not rules:
        return True
    names = [("#", attrs["id"])] if "id" in attrs else []
    names += [(".", c) for c in attrs.get("class", "").split()]
    return (node.tag, "", "") not in rules and not any((t, *n) in rules for n in names for t in ("", node.tag))


class _Lines:
    """Output lines: collapsed inline text, breaks and at most one blank line between blocks.

    A context, of a list item or a quote, puts `mark` before its first line and
    `prefix` before the others. Blank lines at its start and its end don't count.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # white space that waits for a word
        self.gap_line: str | None = None  # a blank line that waits for a line
        self.prefix = self.mark = ""
        self.fresh = True  # no line in this context yet
        self.outer: list[tuple] = []

    def add(self, text: str) -> None:
        parts = [p for p in _SPACE.split(text) if p]
        if not parts:
            self.space = self.space or bool(text)
            return
        if self.now and (self.space or text[0] in " \t\n\r\f"):
            self.now.append(" ")
        self.now.append(" ".join(parts))
        self.space = text[-1] in " \t\n\r\f"

    def end(self, always: bool = False) -> None:
        if self.now or always:
            self.put("".join(self.now))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap_line is not None:
            self.lines.append(self.gap_line)
            self.gap_line = None
        before = self.mark if self.fresh else self.prefix
        self.lines.append(before + line if line else before.rstrip())
        self.fresh = False

    def gap(self) -> None:
        self.end()
        if not self.fresh:
            self.gap_line = self.prefix.rstrip()

    def enter(self, mark: str, prefix: str, always: bool = False) -> None:
        """always: the context has a line even where nothing stands in it."""
        self.end()
        self.outer.append((self.prefix, self.mark, self.fresh, self.gap_line, always))
        wide = len(self.prefix) + len(prefix) > WIDEST
        self.mark = (self.mark if self.fresh else self.prefix) + ("" if wide else mark)
        self.prefix, self.fresh = self.prefix + ("" if wide else prefix), True

    def leave(self) -> None:
        self.end()
        if self.fresh and self.outer[-1][4]:
            self.put("")
        said = not self.fresh
        self.prefix, self.mark, self.fresh, waiting, _ = self.outer.pop()
        self.gap_line = None if said else waiting
        self.fresh = self.fresh and not said


def _cells(table: Node, rules, depth: int) -> tuple[list[list[tuple[list[str], int]]], Node]:
    """Rows of (lines, columns taken) in the order head, bodies, foot as they stand, and what stands outside of cells."""
    rows: list = []
    loose = Node("div", {})
    todo: list[list] = [[iter(table.children), None, None]]  # children, row around them, row now
    while todo:
        frame = todo[-1]
        child = next(frame[0], None)
        if child is None:
            todo.pop()
            if todo:
                loose.children.append(" ")
        elif isinstance(child, str):
            loose.children.append(child)
        elif not visible(child, rules) or (child.tag == "caption" and len(todo) == 1):
            continue
        elif child.tag in ("td", "th"):
            if frame[2] is None:
                frame[2] = []
                rows.append(frame[2])
            span = child.attrs.get("colspan", "1")
            span = min(1000, max(1, int(span))) if span.isascii() and span.isdigit() and len(span) < 5 else 1
            frame[2].append((render(child, rules, depth + 1), span))
        elif child.tag in _PARTS or child.tag == "colgroup" or (child.parts and child.tag != "table"):
            inner = frame[1]
            if child.tag == "tr":
                inner = []
                rows.append(inner)
            loose.children.append(" ")
            frame[2] = frame[1]
            todo.append([iter(child.children), inner, inner])
        else:
            loose.children.append(child)
    return rows, loose


def _table(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    rows = [r for r in rows if r]
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max((len(x) for x in lines if len(x) <= WIDEST), default=0))
            at += span
    known = max(widths, default=-1) + 1
    out = []
    for row in rows:
        places, at = [], 0
        for _, span in row:
            own = range(at, min(at + span, max(known, at + 1)))
            places.append(min(WIDEST, sum(widths.get(c, 0) for c in own) + 3 * (len(own) - 1)))
            at += span
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            out.append(" | ".join((x[i] if i < len(x) else "").ljust(w) for (x, _), w in zip(row, places)).rstrip())
    return out


def render(node: Node, rules, depth: int = 0) -> list[str]:
    """Lines of a node's content. depth: tables around it."""
    out = _Lines()
    todo: list = node.children[::-1]  # nodes, texts and things to do after them

    def inside(children: list, mark: str, prefix: str, always: bool = False) -> None:
        todo.append(out.leave)
        todo.extend(children[::-1])
        todo.append(lambda: out.enter(mark, prefix, always))

    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.add(child)
            continue
        if type(child) is not Node:
            child()
            continue
        tag = child.tag
        if tag == "br":
            out.end(always=True)
            continue
        if not visible(child, rules):
            continue
        if tag == "img":
            out.add(child.attrs.get("alt", ""))
            continue
        if tag == "input":
            if child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.add(child.attrs.get("value", ""))
            continue
        if tag == "select":
            todo.extend(_options(child, rules)[::-1])
            continue
        if tag not in _BLOCK:
            todo.extend(child.children[::-1])
            continue
        after = out.gap if tag in _SPACED else out.end
        after()
        todo.append(after)
        if tag == "hr":
            out.put("---")
        elif tag == "pre":
            for line in _text(child, rules).removeprefix("\n").rstrip("\n").split("\n"):
                out.put(line)
        elif tag == "table" and depth < DEEPEST_TABLE:
            rows, loose = _cells(child, rules, depth)
            lines = _table(rows)
            todo.append(lambda lines=lines: [out.put(x) for x in lines])
            inside(loose.children, "", "")
            for caption in reversed([c for c in child.children if not isinstance(c, str) and c.tag == "caption" and visible(c, rules)]):
                inside(caption.children, "", "")
        elif tag in ("ul", "ol", "menu"):
            todo.extend(reversed(_items(child, out, rules)))
        elif tag == "blockquote":
            inside(child.children, "> ", "> ")
        elif tag == "dd":
            inside(child.children, "  ", "  ")
        else:
            todo.extend(child.children[::-1])
    out.end()
    return out.lines


def _items(node: Node, out: _Lines, rules) -> list:
    """What is to be done for the children of a list, in order."""
    start = node.attrs.get("start", "1")
    number = int(start) if start.isascii() and start.lstrip("-").isdigit() and len(start) < 9 else 1
    made: list = []
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            made += [lambda: out.enter("  ", "  "), child, out.leave]
        elif visible(child, rules):
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            made += [lambda mark=mark: out.enter(mark, " " * len(mark), True), *child.children, out.leave]
    return made


def _options(select: Node, rules) -> list:
    """Texts that a select shows, with spaces around."""
    options, todo = [], select.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str) or not visible(child, rules):
            continue
        if child.tag == "option":
            options.append(child)
        else:
            todo.extend(child.children[::-1])
    if "multiple" not in select.attrs:
        options = ([o for o in options if "selected" in o.attrs] or options)[:1]
    return [f" {_text(o, rules)} " for o in options]


def _text(node: Node, rules) -> str:
    parts, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif visible(child, rules):
            todo.extend(child.children[::-1])
    return "".join(parts)


def to_text(source: str | None) -> str:
    if not source:
        return ""
    root, sheets = parse(source)
    return "\n".join(render(root, hiding_rules(sheets)))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of pages, without html, with the column text."""
    kept = [c for c in pages.columns if c not in (html, "text")]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {c: batch.column(c) for c in kept}
        columns["text"] = pa.array([to_text(x) for x in batch.column(html).to_pylist()], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "text string"])
    return map_batches(pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`")), one, schema)
