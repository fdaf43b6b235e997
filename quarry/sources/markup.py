"""HTML as rows: tables with spans placed on a grid, and a sanitiser by allow-list."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from .files import decode

#: Elements and attributes that sanitised HTML keeps, and elements that go with what they hold.
KEPT = {"a", "b", "i", "u", "s", "em", "strong", "p", "br", "div", "span", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "code", "img", "hr", "sub", "sup"}
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
DROPPED = {"script", "style", "head", "iframe", "object", "embed", "form", "noscript", "template"}
VOID = {"br", "img", "hr", "input", "meta", "link", "col"}
MAX_SPAN, MAX_CELLS = 1000, 1_000_000

TABLES = "table_no int, row int, `column` int, header boolean, text string"


class _Tables(HTMLParser):
    """Tables in the order in which they begin, nested ones too; a cell's text leaves out tables inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.open: list[dict] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None})
        elif self.open:
            now, a = self.open[-1], dict(attrs)
            if tag == "tr":
                self._close()
                now["rows"].append([])
            elif tag in ("td", "th"):
                self._close()
                span = lambda k: min(MAX_SPAN, max(1, int(v))) if (v := a.get(k) or "1").isdigit() else 1
                now["cell"] = [[], span("rowspan"), span("colspan"), tag == "th"]
            elif tag == "br" and now["cell"]:
                now["cell"][0].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] and not self.hidden:
            self.open[-1]["cell"][0].append(data)

    def _close(self) -> None:
        now = self.open[-1]
        if now["cell"]:
            if not now["rows"]:
                now["rows"].append([])
            text = "\n".join(re.sub(r"\s+", " ", x).strip() for x in "".join(now["cell"][0]).split("\n")).strip()
            now["rows"][-1].append((text, *now["cell"][1:]))
            now["cell"] = None


def tables(data: bytes) -> Iterator[tuple]:
    """(table, row, column, header, text) of every cell, where its spans put it; tables without text are left out."""
    p = _Tables()
    p.feed(decode(data))
    n = 0
    for rows in p.tables:
        taken: set[tuple[int, int]] = set()
        cells = []
        for r, row in enumerate(rows):
            c = 0
            for text, down, across, head in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j) for i in range(min(down, len(rows) - r)) for j in range(across)}
                if len(taken) > MAX_CELLS:
                    raise ValueError("too many cells")
                cells.append((n, r, c, head, text))
                c += across
        if any(x[4] for x in cells):
            yield from cells
            n += 1


class _Sanitiser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.gone: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.gone.append(tag)
        elif not self.gone and tag in KEPT:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if k in ATTRIBUTES.get(tag, ()) and safe(tag, k, v or ""))
            self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag: str) -> None:
        if self.gone:
            if tag == self.gone[-1]:
                self.gone.pop()
        elif tag in KEPT and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.out.append(html.escape(data, False))


def safe(tag: str, name: str, value: str) -> bool:
    """Links lead to web pages and mail only, pictures come from there or are raster data in place."""
    v = value.strip().lower()
    if name == "href":
        return bool(re.match(r"(https?:|mailto:|tel:|#)", v))
    if name == "src":
        return bool(re.match(r"(https?:|cid:|data:image/(?!svg)[a-z0-9.+-]+;base64,)", v))
    return True


def sanitised(data: bytes) -> Iterator[tuple]:
    p = _Sanitiser()
    p.feed(decode(data))
    p.close()
    yield ("".join(p.out),)


HTML = "html string"
