"""Layout-aware text of web pages.

A tree builder with implied tags walks each page and a renderer follows it: what
is visible is kept, in reading order, blocks are set apart by line ends or blank
lines, list items carry marks, table cells stand in aligned columns, with their
own lines, paragraphs and lists; cells that span columns or rows keep the others in
place. A row with a line of more than WIDEST characters in a cell of several lines
is a layout, its cells follow one another as blocks. Hidden is what the standard,
an attribute, an own style or a simple selector of a style sheet hides. The walk
keeps its own stack, so deep nesting costs no recursion; only an unclosed tag at
the end of a page is skipped.

Null or empty pages give empty text. Repeated pages and ids are rendered row by
row. An empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm.common import lean, slices, table

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""", re.S
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed values of the HTML standard: elements without content, raw text, and their default display.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template iframe noembed noframes noscript datalist audio video canvas title meta link base param rp area".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCK = SPACED | set(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav "
    "optgroup option search section select summary caption thead tbody tfoot tr td th".split()
)
#: Start tags that close an open element of these kinds, up to a limit.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = {"td", "th", "caption", "table", "html", "button", "object"}
#: Start tags that may follow in a head without closing it.
IN_HEAD = set("title meta link base script style template noscript".split())
#: Columns wider than this are not padded.
WIDEST = 40
WHITE = " \t\n\r\f"
PART = re.compile(f"[^{WHITE}]+")
AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})|/\*.*?\*/", re.S)
STYLE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"[\w-]*(?:[.#][\w-]+)?")


def attributes(rest: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTR.findall(rest)}


def unseen_style(text: str) -> bool | None:
    """Whether declarations hide, or show; None if they say nothing."""
    text = re.sub(r"\s+", "", text.lower())
    if "display:none" in text or "visibility:hidden" in text:
        return True
    return False if "display:" in text or "visibility:" in text else None


def style_rules(sheet: str) -> dict[str, bool]:
    """What a style sheet says of simple selectors (an element, a class, an id, or an element with one of these); the last word counts."""
    found = {}
    for names, text in STYLE.findall(AT_RULE.sub(" ", sheet)):
        says = unseen_style(text)
        for name in names.split(","):
            if says is not None and SELECTOR.fullmatch(name.strip()):
                found[name.strip()] = says
    return found


def hides(name: str, rest: str, rules: dict[str, bool] | None = None) -> bool:
    """Whether an element and all below it stay unseen."""
    if name in HIDDEN:
        return True
    said = bool(rules) and rules.get(name, False)
    low = rest.lower() if rest else ""
    if low and ("hid" in low or "none" in low or "style" in low or rules and ("class" in low or "id" in low)):
        attrs = attributes(rest)
        if rules:
            marks = ["." + c for c in attrs.get("class", "").split()] + (["#" + attrs["id"]] if "id" in attrs else [])
            for m in [*marks, *(name + m for m in marks)]:
                said = rules.get(m, said)
        own = unseen_style(attrs.get("style", ""))
        return "hidden" in attrs or (said if own is None else own)
    return said


def span(rest: str, name: str) -> int:
    """A cell's colspan or rowspan."""
    if not rest or name not in rest.lower():
        return 1
    n = attributes(rest).get(name, "")
    return min(1000, max(1, int(n))) if n.isascii() and n.isdigit() else 1


class Flow:
    """Lines of text being laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line ends that must come before what follows
        self.mark = ""  # of a list item that has no text yet
        self.space = False

    def text(self, s: str, indent: str, pre: bool) -> None:
        if pre:
            head, *more = s.split("\n")
            self.word(head, indent)
            for x in more:
                self.end_line()
                self.now = [indent, x] if x else []
            return
        parts = PART.findall(s)
        if not parts:
            self.space = True
            return
        if s[0] in WHITE:
            self.space = True
        self.word(" ".join(parts), indent)
        self.space = s[-1] in WHITE

    def word(self, s: str, indent: str) -> None:
        if not s:
            return
        if not self.now:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.now.append(indent[: len(indent) - len(self.mark)] + self.mark)
            self.mark = ""
        elif self.space:
            self.now.append(" ")
        self.now.append(s)
        self.space = False

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def part(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        return [x.replace("\xa0", " ").rstrip() for x in self.lines]


#: A cell: its lines, the columns and the rows that it spans.
Cell = tuple[list[str], int, int]


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Table rows as lines, cells two blanks apart in columns of equal width; a row of layout as its cells' lines."""
    placed: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
    busy: dict[int, int] = {}
    for r in rows:
        at, out, held = 0, [], {c: n - 1 for c, n in busy.items() if n > 1}
        for lines, wide, tall in r:
            while at in busy:
                at += 1
            out.append((at, wide, lines))
            if tall > 1:
                held |= dict.fromkeys(range(at, at + wide), tall - 1)
            at += wide
        busy = held
        placed.append(out)
    layout = [any(len(lines) > 1 and max(map(len, lines)) > WIDEST for *_, lines in r) for r in placed]
    width: dict[int, int] = {}
    for r, blocks in zip(placed, layout, strict=True):
        for c, wide, lines in r:
            size = max(map(len, lines), default=0)
            if not blocks and wide == 1 and size <= WIDEST:
                width[c] = max(width.get(c, 0), size)
            else:
                width.setdefault(c, 0)
    starts, total = {}, 0
    for c in range(max(width, default=-1) + 1):
        starts[c] = total
        total += width[c] + 2 if c in width else 0
    out = []
    for r, blocks in zip(placed, layout, strict=True):
        if blocks:
            out += [x for _, _, lines in r for x in lines]
            continue
        for k in range(max((len(lines) for *_, lines in r), default=0)):
            line = ""
            for c, _, lines in r:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[c]) if len(line) < starts[c] or not line else line + "  "
                    line += lines[k]
            out.append(line.rstrip())
    return out


class Page:
    """The open elements of a page, and the flows and tables that they write to."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []  # name, whether it starts what is unseen
        self.open: dict[str, int] = {}
        self.unseen = 0
        self.pre = 0
        self.lists: list[list] = []  # kind, items so far
        self.indents: list[str] = [""]
        self.flows = [Flow()]
        self.tables: list[list[list[Cell]]] = []
        self.spans: list[tuple[int, int]] = []  # of the open cells
        self.rules: dict[str, bool] = {}

    def text(self, s: str) -> None:
        if not self.unseen and s:
            self.flows[-1].text(unescape(s) if "&" in s else s, self.indents[-1], self.pre > 0)

    def start(self, name: str, rest: str) -> None:
        if name in CLOSES:
            self.imply(*CLOSES[name])
        elif name in BLOCK and self.open.get("p"):
            self.close_within("p")
        if self.open.get("head") and name not in IN_HEAD and name not in ("head", "html"):
            self.close_within("head")
        if name in ("html", "body") and self.open.get(name):
            return
        unseen = hides(name, rest, self.rules)
        if name in VOID:
            if not self.unseen and not unseen:
                if name == "br":
                    f = self.flows[-1]
                    if f.now:
                        f.part(1)
                    elif f.lines:
                        f.gap += 1
                elif name == "hr":
                    self.flows[-1].part(2)
            return
        if name in ("td", "th") and not self.open.get("tr") or name == "tr" and not self.tables:
            if self.tables and name != "tr":
                self.start("tr", "")
            elif not self.tables:
                name = "div"  # a cell outside any table is a block
        self.push(name, unseen, rest)

    def push(self, name: str, unseen: bool, rest: str = "") -> None:
        self.stack.append((name, unseen))
        self.open[name] = self.open.get(name, 0) + 1
        self.unseen += unseen
        if self.unseen:
            return
        flow = self.flows[-1]
        if name in ("td", "th"):
            self.flows.append(Flow())
            self.indents.append("")
            self.spans.append((span(rest, "colspan"), span(rest, "rowspan")))
        elif name == "tr":
            self.tables[-1].append([])
        elif name == "table":
            flow.part(2)
            self.tables.append([])
        elif name == "caption":
            self.flows.append(Flow())
            self.indents.append("")
        elif name in BLOCK:
            flow.part(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)
            if name in ("ul", "ol", "menu"):
                self.lists.append([name, 0])
                self.indents.append(self.indents[-1])
            elif name == "li":
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                flow.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                self.indents.append(self.indents[-1] + " " * len(flow.mark))
            elif name in ("dd", "blockquote"):
                self.indents.append(self.indents[-1] + "  ")
            elif name == "pre":
                self.pre += 1

    def pop(self) -> None:
        name, own = self.stack.pop()
        self.open[name] -= 1
        seen = not self.unseen
        self.unseen -= own
        if not seen:
            return
        if name in ("td", "th"):
            self.indents.pop()
            self.tables[-1][-1].append((self.flows.pop().done(), *self.spans.pop()))
        elif name == "caption":
            self.indents.pop()
            lines = self.flows.pop().done()
            self.flows[-1].part(1)
            for x in lines:
                self.flows[-1].word(x, self.indents[-1])
                self.flows[-1].part(1)
        elif name == "table":
            flow, pre = self.flows[-1], self.indents[-1]
            for line in aligned([r for r in self.tables.pop() if any(c[0] for c in r)]):
                if not line:
                    flow.part(2)
                    continue
                flow.word(line, pre)
                flow.part(1)
            flow.part(2)
        elif name in BLOCK and name != "tr":
            if name in ("ul", "ol", "menu"):
                self.lists.pop()
                self.indents.pop()
            elif name in ("li", "dd", "blockquote"):
                self.indents.pop()
                if name == "li":
                    self.flows[-1].mark = ""
            elif name == "pre":
                self.pre -= 1
            self.flows[-1].part(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)

    def close_within(self, name: str) -> None:
        """Closes the innermost `name`, with all it holds, unless a cell or the like stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in SCOPE:
                return

    def imply(self, kinds: set[str], limit: set[str]) -> None:
        """Closes the outermost open element of these kinds that is within the limit."""
        if not any(self.open.get(k) for k in kinds):
            return
        at = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in kinds:
                at = i
            elif self.stack[i][0] in limit:
                break
        while at is not None and len(self.stack) > at:
            self.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif self.open.get(name):
            stop = set() if name in SCOPE or name in ("tr", "tbody", "thead", "tfoot", "body") else SCOPE
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    while len(self.stack) > i:
                        self.pop()
                    return
                if self.stack[i][0] in stop or self.stack[i][0] == "table" and name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                    return

    def done(self) -> str:
        while self.stack:
            self.pop()
        return "\n".join(self.flows[0].done())


def html_text(html: str | None) -> str:
    """The visible text of a page."""
    html, page, at = html or "", Page(), 0
    while True:
        m = TAG.search(html, at)
        page.text(html[at : m.start() if m else len(html)])
        if not m:
            return page.done()
        at, name = m.end(), m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            page.end(name)
            continue
        page.start(name, m["rest"])
        if name in RAW and not (m["rest"] or "").endswith("/"):
            close = re.compile(f"</{name}", re.I).search(html, at)
            stop = close.start() if close else len(html)
            if name == "style":
                page.rules |= style_rules(html[at:stop])
            page.text(html[at:stop])
            at = stop


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every row's id, text and n_lines."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in (x for b in batches for x in slices(b, 4 << 20)):
            texts = [html_text(x) for x in batch.column(1).to_pylist()]
            lines = [len(t.splitlines()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int32())], [id_col, "text", "n_lines"])

    typed = df.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).cast("string").alias("html"))
    return typed.mapInArrow(render, f"`{id_col}` long, text string, n_lines int")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
