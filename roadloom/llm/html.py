"""Operator 8: layout-aware rendering of HTML pages as plain text."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import chunks, map_batches, pick

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[ \t\n\r\f/>])[^>]*>?|\Z", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
HIDDEN = set("head script style template noscript iframe object datalist audio video canvas noembed noframes annotation annotation-xml mphantom".split())
#: Parts of a drawing that are not drawn themselves; of the others, text and foreignObject hold what is read.
UNDRAWN = set("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Elements of svg and math whose content is HTML again, and HTML tags that end an open svg or math.
POINTS = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol
p pre ruby s small span strong strike sub sup table tt u ul var""".split())
#: Formulas whose parts stand apart, so that a half is no 12.
APART = set("mfrac msub msup msubsup mroot munder mover munderover mmultiscripts mtable mtr mtd".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
tfoot thead tr td th ul caption""".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset article section hr".split())
#: Opening one of the values' tags ends an open element of the key, up to the first of its bounds.
P_ENDERS = BLOCK - set("html body td th tr tbody thead tfoot caption option optgroup legend summary".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HEAD_ONLY = set("base basefont bgsound link meta title style script noscript template head".split())
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: Columns and rows that a cell may span, as browsers have it, and the width up to which columns are padded.
MOST_COLUMNS, MOST_ROWS, ALIGNED = 1000, 65534, 60
WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def build(source: str) -> Node:
    """The tree. Tags that the author left out are implied; stray end tags are ignored; anything open ends with the page."""
    root = Node("#root", {})
    stack, at = [root], 0
    drawings = re.search("<(?:svg|math)", source, re.I) is not None

    def foreign(inside=False):
        """svg or math, if a tag here belongs to it (inside: if the open element itself does), or else an empty text."""
        for i in range(len(stack) - 1, 0, -1) if drawings else ():
            if (tag := stack[i].tag) in ("svg", "math"):
                return tag
            if tag in POINTS and not (inside and i == len(stack) - 1):
                break
        return ""

    def end_within(tags, bounds):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                end_within(tags, bounds)
                return
            if stack[i].tag in bounds:
                return

    def put(text):
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].kids.append(text)

    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            put(entities.unescape(source[at:]))
            break
        if source.startswith("<![CDATA[", lt) and foreign(True):
            put(entities.unescape(source[at:lt]))
            end = source.find("]]>", lt)
            put(source[lt + 9 : end if end >= 0 else len(source)])
            at = end + 3 if end >= 0 else len(source)
            continue
        m = TOKEN.match(source, lt)
        if not m:
            put(entities.unescape(source[at : lt + 1]))
            at = lt + 1
            continue
        put(entities.unescape(source[at:lt]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
        elif tag := (m[2] or m[4] or "").lower():
            extra = (m[3] if m[2] else m[5]) or ""
            if stack[-1].tag == "head" and tag not in HEAD_ONLY:
                stack.pop()
            if (kind := foreign()) and tag in BREAKOUT:
                while stack[-1].tag not in ("svg", "math"):
                    stack.pop()
                stack.pop()
                kind = ""
            if tag in P_ENDERS:
                end_within({"p"}, {"table", "td", "th", "button", "object"})
            if tag in IMPLIED:
                end_within(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                stack[-1].kids.append(row := Node("tr", {}))
                stack.append(row)
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                stack.pop()
            stack[-1].kids.append(node := Node(tag, attributes(extra) if extra.strip(" /") else {}))
            if kind == "svg" and (tag in UNDRAWN or node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse")):
                node.attrs["hidden"] = ""
            if tag in RAW and not kind:
                stop = RAW[tag].search(source, at)
                raw = source[at : stop.start()]
                node.kids.append(entities.unescape(raw) if tag in ("textarea", "title") else raw)
                at = stop.end()
            elif tag not in VOID and not (extra.endswith("/") and (kind or tag in ("svg", "math"))):
                stack.append(node)
    return root


def visible(node: Node) -> bool:
    """Whether the element and what it holds takes part in the page. visibility: hidden is another thing: a child may undo it."""
    a = node.attrs
    return node.tag not in HIDDEN and not (node.tag == "dialog" and "open" not in a) and not (a and ("hidden" in a or UNSEEN.search(a.get("style", "")) or node.tag == "input" and a.get("type", "").lower() == "hidden"))


def shown(node: Node, before: bool) -> bool:
    """Whether text of the element is seen: its own visibility, or else that of what it stands in."""
    own = VISIBILITY.search(node.attrs.get("style", "")) if node.attrs else None
    return before if own is None or own[1].lower() == "inherit" else own[1].lower() not in ("hidden", "collapse")


def unfolded(details: Node) -> list[Node | str]:
    """What a details element shows: all if it is open, or else its first summary."""
    return details.kids if "open" in details.attrs else [k for k in details.kids if isinstance(k, Node) and k.tag == "summary"][:1]


def drawn(svg: Node) -> list[Node | str]:
    """The texts of a drawing that are shown, in their order, with white space between them."""
    out, todo = [" "], svg.kids[::-1]
    while todo:
        n = todo.pop()
        if isinstance(n, str) or not visible(n):
            continue
        if n.tag in ("text", "foreignobject"):
            out += [n, " "]
        else:
            todo += n.kids[::-1]
    return out


def options(select: Node) -> tuple[bool, list[str]]:
    """Whether a select is a list box, and the options that it shows: all, or else the chosen one, by default the first that isn't disabled."""
    found, todo = [], [(k, False) for k in reversed(select.kids)]
    while todo:
        n, off = todo.pop()
        if isinstance(n, str):
            continue
        off = off or n.tag in ("option", "optgroup") and "disabled" in n.attrs
        if n.tag != "option":
            todo += [(k, off) for k in reversed(n.kids)]
            continue
        parts, inner = [], n.kids[::-1]
        while inner:
            k = inner.pop()
            if isinstance(k, str):
                parts.append(k)
            elif k.tag not in ("script", "style", "template"):
                inner += k.kids[::-1]
        found.append((n.attrs.get("label") or WHITE.sub(" ", "".join(parts)).strip(), "selected" in n.attrs, off, visible(n)))
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or size.isdigit() and len(size) < 9 and int(size) > 1:
        return True, [text for text, _, _, seen in found if seen]
    return False, ([x[0] for x in found if x[1]][-1:] or [x[0] for x in found if not x[2]][:1])


class Writer:
    """Lines of text; white space collapses, blank lines stand between spaced blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.prefix: list[str] = []
        self.mark = ""
        self.gap = False

    def text(self, s: str) -> None:
        s = WHITE.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def line(self, s: str, indent: bool = True) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        pad = "".join(self.prefix) if indent else ""
        if self.mark:
            pad, self.mark = pad[: -len(self.mark)] + self.mark if len(pad) >= len(self.mark) else self.mark, ""
        self.lines.append((pad + s).rstrip())

    def end_line(self, blank: bool = False) -> None:
        s = "".join(self.now).strip(" ")
        self.now = []
        if s:
            self.line(s)
        self.gap |= blank

    def br(self) -> None:
        s = "".join(self.now).strip(" ")
        self.now = []
        if s or self.lines and self.lines[-1] and not self.gap:
            self.line(s)

    def done(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows) as lines with aligned columns, two spaces between them.

    A cell of several lines makes its row as high. A cell that spans rows leaves its columns empty below. Columns are as
    wide as their widest line of up to ALIGNED characters, so padding stays in proportion to the number of cells; longer
    lines stand whole and push what follows.
    """
    placed: list[list[tuple[int, list[str], int]]] = []
    widths: list[int] = []
    below: dict[int, int] = {}  # rows that a column is still taken
    for row in rows:
        c, out = 0, []
        new: dict[int, int] = {}
        for lines, span, down in row:
            while below.get(c, 0) > 0:
                c += 1
            out.append((c, lines, span))
            if len(widths) < c + span:
                widths += [0] * (c + span - len(widths))
            if span == 1:
                widths[c] = max([widths[c], *[len(x) for x in lines if len(x) <= ALIGNED]])
            if down > 1:
                new |= {k: down for k in range(c, c + span)}
            c += span
        below = {k: n - 1 for k, n in (below | new).items() if n > 1}
        placed.append(out)
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    lines_out = []
    for row in placed:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, used = [], 0
            for c, lines, _ in row:
                if i < len(lines) and lines[i]:
                    pad = max(starts[c] - used, 2 if used else 0)
                    line.append(" " * pad + lines[i])
                    used += pad + len(lines[i])
            lines_out.append("".join(line).rstrip())
    return lines_out


def _number(node: Node, name: str, most: int) -> int:
    s = node.attrs.get(name, "1").strip()
    return max(1, min(most, int(s))) if s.isdigit() and len(s) < 9 else 1


def render(source: str) -> str:
    """All visible text of a page. Lists get marks, table cells are aligned, pre keeps its lines, alt stands for images.

    Of a drawing its texts are given, of a formula its symbols, of a select the option that it shows or, as a list box, all.
    """
    out = Writer()
    writers, tables, lists, pre, seen = [out], [], [], 0, [True]
    todo: list[tuple] = [(build(source), 0)]
    while todo:
        node, phase = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if not seen[-1]:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                w.now.append(first)
                for x in rest:
                    w.line("".join(w.now))
                    w.now = [x]
            elif not (tables and tables[-1]["bare"] and node.isspace()):
                w.text(node)
            continue
        tag = node.tag
        if phase == 0:
            if not visible(node):
                continue
            if tag == "br":
                w.br()
                continue
            if tag in ("img", "input", "select") and not shown(node, seen[-1]):
                continue
            if tag == "img":
                w.text(node.attrs.get("alt", ""))
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", ""):
                    w.text(node.attrs.get("value", ""))
                continue
            if tag == "hr":
                w.end_line(True)
                continue
            if tag == "wbr":
                continue
            if tag == "select":
                box, texts = options(node)
                for x in texts:
                    if box:
                        w.end_line()
                    w.text(x)
                if box:
                    w.end_line()
                continue
            if tag == "table":
                w.end_line(True)
                tables.append({"rows": [], "caption": [], "bare": True})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th", "caption") and tables:
                writers.append(Writer())
                tables[-1]["bare"] = False
                seen.append(shown(node, seen[-1]))
                todo.append((node, 1))
                todo += [(k, 0) for k in reversed(node.kids)]
                lists.append(None)
                continue
            elif tag in BLOCK:
                w.end_line(tag in SPACED and not (tag in ("ul", "ol") and any(lists)))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isdigit() and len(start) < 9 else 1])
                w.prefix.append("")
            elif tag == "li":
                top = lists[-1] if lists and lists[-1] else ["ul", 1]
                mark = f"{top[1]}. " if top[0] == "ol" else "- "
                top[1] += 1
                w.prefix.append(" " * len(mark))
                w.mark = mark
            elif tag in ("dd", "blockquote"):
                w.prefix.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "q":
                w.text('"')
            seen.append(shown(node, seen[-1]))
            kids = drawn(node) if tag == "svg" else unfolded(node) if tag == "details" else [x for k in node.kids for x in (k, " ")] if tag in APART else node.kids
            todo.append((node, 1))
            todo += [(k, 0) for k in reversed(kids)]
            continue
        seen.pop()
        if tag in ("td", "th", "caption") and tables:
            lists.pop()
            lines = writers.pop().done().split("\n")
            tables[-1]["bare"] = True
            if tag == "caption":
                tables[-1]["caption"] += lines
            else:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1]["rows"][-1].append((lines, _number(node, "colspan", MOST_COLUMNS), _number(node, "rowspan", MOST_ROWS)))
            continue
        if tag == "table":
            t = tables.pop()
            w.end_line()
            rows = [r for r in t["rows"] if any(any(c[0]) or c[2] > 1 for c in r)]
            for x in [*t["caption"], *grid(rows)]:
                if x:
                    w.line(x)
            w.gap = True
            continue
        if tag == "pre":
            pre -= 1
            if w.now and "".join(w.now).strip():
                w.line("".join(w.now).rstrip())
            w.now, w.gap = [], True
        elif tag == "q":
            w.text('"')
        elif tag in BLOCK:
            w.end_line(tag in SPACED and not (tag in ("ul", "ol") and sum(map(bool, lists)) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            w.prefix.pop()
        elif tag in ("li", "dd", "blockquote"):
            w.prefix.pop()
            if tag == "li":
                w.mark = ""
    return out.done()


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, text for every row: the page as a reader sees it, whole. Null and empty pages give an empty text.

    Rows are rendered one at a time, so memory holds one page; repeated rows repeat; other columns are not read.
    """

    def run(batches):
        for batch in chunks(batches, "html", 4 << 20):
            ids, pages_ = pick(batch, "k", "html")
            yield pa.RecordBatch.from_arrays([ids, pa.array([render(x) if x else "" for x in pages_.to_pylist()], pa.string())], [key, "text"])

    kind = pages.schema[key].dataType.simpleString()
    return map_batches(pages.select(F.col(key).alias("k"), F.col(source).alias("html")), run, f"{key} {kind}, text string")
