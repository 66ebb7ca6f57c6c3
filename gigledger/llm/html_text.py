"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, lists and aligned tables."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BODY = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_NUMBER = re.compile(r"\s*(-?[0-9]{1,9})(?![0-9])", re.A)
_BLANK = re.compile(r"[ \t\n\r\f]+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {name: re.compile("</" + name + r"(?=[\s/>])", re.I) for name in RAW}
UNSEEN = frozenset("head script style template title noscript iframe object audio video canvas datalist noembed noframes select".split())
#: What may stand in an open head; anything else ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Unseen parts of svg and math elements.
FOREIGN_UNSEEN = frozenset("desc defs annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
LISTS = frozenset(("ol", "ul", "menu", "dir"))
#: What a start tag closes when it is open, and where the search for it stops.
CLOSES = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("table", "tr"))),
    "th": (("td", "th"), frozenset(("table", "tr"))),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), frozenset(("table",))),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), frozenset(("table",))),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), frozenset(("table",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "body": (("head",), frozenset()),
}
_SCOPE = frozenset(("table", "td", "th", "caption", "html", "template", "object"))


class _Canvas:
    """Lines of one flow of text; table cells and list items have canvases of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0

    def write(self, text: str) -> None:
        self.inline.append(text)

    def end_line(self, forced: bool = False) -> None:
        text = "".join(self.inline)
        self.inline = []
        text = "\n".join(_BLANK.sub(" ", p).strip(" ") if i % 2 == 0 else p for i, p in enumerate(text.split("\x00"))).strip("\n") if "\x00" in text else _BLANK.sub(" ", text).strip(" ")
        if text or forced:
            self.put(text.split("\n"))

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines

    def space(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def text(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(text: str | None, otherwise: int) -> int:
    """A whole number of at most nine ASCII digits, as attributes give it."""
    found = _NUMBER.match(text or "")
    return int(found.group(1)) if found else otherwise


def _table(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells of lines, cells padded to columns; a cell of several lines goes on below its first."""
    width = [0] * max((len(r) for r in rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            width[i] = max(width[i], max(map(len, cell), default=0))
    out = []
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            line = " | ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row))
            out.append(line.rstrip(" |") if k else line.rstrip())
    return out


class _Scanner:
    """Finds tags in one pass over a page, however broken its markup."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = True  # quoted values may hold >; not any more once a tag has not ended for its quotes

    def end_of_tag(self, at: int) -> int:
        """Where the tag whose attributes begin here has its >; -1 without one."""
        page = self.page
        if at > self.last:
            return -1
        begin = at
        while self.quotes:
            at = _BODY.match(page, at).end()
            if at >= len(page):
                self.quotes = False
            elif page[at] == ">":
                return at
            else:
                at = page.find(page[at], at + 1) + 1
                if not at:
                    self.quotes = False
        return page.find(">", begin)

    def parts(self):
        """(text, closing, name, attributes): text, or a tag with its name; a raw element's text is taken with `skip`."""
        page, at = self.page, 0
        while at < len(page):
            start = page.find("<", at)
            if start < 0:
                yield page[at:], "", "", ""
                return
            if start > at:
                yield page[at:start], "", "", ""
            if page.startswith("<!--", start):
                short = next((n for n in (5, 6) if page[start : start + n] in ("<!-->", "<!--->")), 0)
                end = start + short if short else page.find("-->", start + 4) + 3
                if end < start + 4:
                    return
                at = end
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                at = page.find(">", start) + 1
                if not at:
                    return
                continue
            tag = _TAG.match(page, start)
            end = self.end_of_tag(tag.end()) if tag else -1
            if end < 0:
                if tag and start > self.last:
                    yield page[start:], "", "", ""
                    return
                yield "<", "", "", ""
                at = start + 1
                continue
            self.at = end + 1
            yield None, tag.group(1), tag.group(2).lower(), page[tag.end() : end]
            at = self.at


class Renderer:
    """Builds the tree tag by tag and renders as elements close; no recursion, so any depth will do."""

    def __init__(self):
        self.stack: list[dict] = []
        self.open: Counter = Counter()  # how many elements of each name are open
        self.canvas = _Canvas()
        self.hidden = self.pre = 0

    def render(self, page: str | None) -> str:
        page = page or ""
        scanner = _Scanner(page)
        for text, closing, name, raw in scanner.parts():
            if text is not None:
                self.characters(text)
            elif closing:
                self.end(name)
            else:
                self.start(name, raw)
                if name in RAW and self.stack and self.stack[-1]["name"] == name:
                    end = _RAW_END[name].search(page, scanner.at)
                    stop = end.start() if end else len(page)
                    if name in ("textarea", "xmp"):
                        self.characters(page[scanner.at : stop])
                    scanner.at = stop
        while self.stack:
            self.pop()
        return "\n".join(self.canvas.text()).strip("\n")

    def end_head(self) -> None:
        """Both </head> and <body> may be left out."""
        if self.stack and self.stack[-1]["name"] == "head":
            self.pop()

    def characters(self, text: str) -> None:
        if text.strip(" \t\n\r\f"):
            self.end_head()
        if self.hidden or not text or self.stack and (self.stack[-1]["dim"] or self.stack[-1]["closed"]):
            return
        text = html.unescape(text).replace("\x00", "")
        if self.pre:
            self.canvas.write("\x00" + text + "\x00")
        else:
            self.canvas.write(text)

    def start(self, name: str, raw: str) -> None:
        if name not in HEAD:
            self.end_head()
        foreign = self.open["svg"] or self.open["math"]
        found = CLOSES.get(name)
        if found:
            self.close_open(*found)
        elif name in BLOCKS and name not in ("html", "body"):
            self.close_open(("p",), _SCOPE)
            if name[0] == "h" and name[1:].isdigit():
                self.close_open(("h1", "h2", "h3", "h4", "h5", "h6"), _SCOPE | BLOCKS - {"h1", "h2", "h3", "h4", "h5", "h6"})
        attrs = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}
        style = attrs.get("style", "")
        unseen = name in UNSEEN or foreign and name in FOREIGN_UNSEEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(style)) or name == "dialog" and "open" not in attrs
        parent = self.stack[-1] if self.stack else {"dim": False, "closed": False}
        if parent["closed"]:  # of closed details only the first summary shows
            unseen = unseen or name != "summary" or parent.get("summed", False)
            parent["summed"] = parent.get("summed", False) or name == "summary"
        said = _VISIBILITY.search(style)
        dim = said.group(1).lower() != "visible" if said else parent["dim"]  # takes up its place, but its own text does not show
        if name in VOID:
            if not (self.hidden or unseen or dim and name != "br"):
                self.void(name, attrs)
            return
        if foreign and raw.endswith("/"):
            return
        node = {"name": name, "unseen": bool(unseen), "outer": None, "dim": dim, "closed": name == "details" and "open" not in attrs}
        self.stack.append(node)
        self.open[name] += 1
        if unseen:
            self.hidden += 1
        if self.hidden:
            return
        if name in BLOCKS:
            self.canvas.space(1 if name in SPACED and not self.inside(LISTS, name) else 0)
        if name == "pre":
            self.pre += 1
        if name == "ol":
            node["next"] = _number(attrs.get("start"), 1)
        elif name == "table":
            node["rows"] = []
        elif name == "tr":
            node["cells"] = []
        if name in ("li", "td", "th", "caption", "dd", "blockquote"):
            node["outer"], self.canvas = self.canvas, _Canvas()
            if name == "td" or name == "th":
                node["span"] = min(1000, max(1, _number(attrs.get("colspan"), 1)))

    def inside(self, names: frozenset, name: str) -> bool:
        return name in names and sum(self.open[n] for n in names) > 1

    def void(self, name: str, attrs: dict) -> None:
        if name == "br":
            self.canvas.end_line(forced=True)
        elif name == "wbr":
            return
        elif name == "hr":
            self.canvas.space(1)
            self.canvas.put(["---"])
            self.canvas.space(1)
        elif name == "img" and attrs.get("alt"):
            self.canvas.write(attrs["alt"])
        elif name == "input" and attrs.get("type", "text").lower() in ("submit", "button", "reset") and attrs.get("value"):
            self.canvas.write(attrs["value"])

    def close_open(self, names: tuple, stop: frozenset) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i]["name"]
            if name in names:
                while len(self.stack) > i:
                    self.pop()
            elif name in stop:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        if name == "p" and not self.open["p"]:
            self.start("p", "")
        if not self.open[name]:
            return
        edge = frozenset(("table",)) if name not in ("table", "html", "body") else frozenset()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["name"] == name:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i]["name"] in edge:
                return

    def pop(self) -> None:
        node = self.stack.pop()
        name = node["name"]
        self.open[name] -= 1
        if node["unseen"]:
            self.hidden -= 1
            return
        if self.hidden:
            return
        if name == "pre":
            self.pre -= 1
        if node["outer"] is not None:
            lines, self.canvas = self.canvas.text(), node["outer"]
            if name in ("td", "th"):
                row = next((n for n in reversed(self.stack) if n["name"] in ("tr", "table")), None)
                cells = [[x for x in lines if x.strip()], *[[] for _ in range(node["span"] - 1)]]
                if row is None:
                    self.canvas.write(" ".join(x.strip() for x in cells[0]))
                elif row["name"] == "tr":
                    row.setdefault("cells", []).extend(cells)
                else:
                    row["rows"].append(cells)
            elif name == "li":
                parent = next((n for n in reversed(self.stack) if n["name"] in LISTS), None)
                mark = "- "
                if parent is not None and parent["name"] == "ol":
                    mark = f"{parent['next']}. "
                    parent["next"] += 1
                pad = " " * len(mark)
                if lines or not node["dim"]:
                    self.canvas.put([(mark if i == 0 else pad if x else "") + x for i, x in enumerate(lines)] or [mark.rstrip()])
            elif lines:
                self.canvas.put([("  " if x and name != "caption" else "") + x for x in lines])
        elif name == "tr" and "cells" in node:
            table = next((n for n in reversed(self.stack) if n["name"] == "table"), None)
            if table is not None and "rows" in table:
                table["rows"].append(node["cells"])
            else:
                self.canvas.put(_table([node["cells"]]))
        elif name == "table" and node.get("rows"):
            self.canvas.end_line()
            self.canvas.put(_table(node["rows"]))
        if name in BLOCKS:
            self.canvas.space(1 if name in SPACED and not (name in LISTS and any(self.open[n] for n in LISTS)) else 0)


def page_text(page: str | None) -> str:
    """The visible text of one whole page."""
    return Renderer().render(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per input row: page_id, text, n_chars, n_lines.

    All visible text in reading order: blocks on lines of their own, an empty line around
    paragraphs, headings, lists and tables, list items marked and indented, table cells padded to
    columns, lines of a cell below each other. Scripts, styles, head, templates, hidden and aria-hidden elements and those styled
    display:none are left out, as are closed details but for their summary; of visibility:hidden
    elements those parts show that are visible again. Null and empty pages give an empty text;
    broken markup is repaired by implied tags, a quote that nothing closes ends with its tag, and a
    last tag without > is text; repeated rows each give a row, null ids pass through, other
    columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [page_text(p.as_py()) for p in part.column(1)]
                arrays = [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
