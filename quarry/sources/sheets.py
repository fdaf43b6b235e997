"""Workbooks (XLSX, ODS) as long tables of cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

CELLS = "sheet string, row int, `column` int, text string, value double, hidden boolean"
MAX_CELLS, MAX_PART = 10_000_000, 256 << 20


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _local(t) == "t")


def column_of(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(data: bytes) -> Iterator[tuple]:
    """(sheet, row, column, text, value, hidden) of every cell with something in it; rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_texts(s) for s in (_part(z, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else []) if _local(s) == "si"]
        rels = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        count = 0
        for s in (e for e in _part(z, "xl/workbook.xml").iter() if _local(e) == "sheet"):
            target = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            root = _part(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            off = {c for e in root.iter() if _local(e) == "col" and e.get("hidden") in ("1", "true") for c in range(int(e.get("min")) - 1, min(int(e.get("max")), 16384))}
            at_row = -1
            for row in (e for e in root.iter() if _local(e) == "row"):
                at_row = int(row.get("r")) - 1 if row.get("r") else at_row + 1
                at = -1
                for c in row:
                    at = column_of(c.get("r")) if c.get("r") else at + 1
                    v = next((x.text or "" for x in c if _local(x) == "v"), None)
                    kind = c.get("t", "n")
                    text = shared[int(v)] if kind == "s" and v else _texts(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v
                    if text:
                        count += 1
                        if count > MAX_CELLS:
                            raise ValueError("too many cells")
                        number = float(v) if kind == "n" and v else None
                        yield s.get("name"), at_row, at, text, number, s.get("state", "visible") != "visible" or row.get("hidden") in ("1", "true") or at in off


def ods(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _part(z, "content.xml")
    get = lambda e, k: next((v for n, v in e.attrib.items() if n.rpartition("}")[2] == k), None)
    count = 0
    for table in (e for e in root.iter() if _local(e) == "table"):
        r = 0
        for row in (e for e in table.iter() if _local(e) == "table-row"):
            rows, c, cells = int(get(row, "number-rows-repeated") or 1), 0, []
            for cell in row:
                n = int(get(cell, "number-columns-repeated") or 1)
                text = "\n".join("".join(p.itertext()) for p in cell if _local(p) == "p")
                if text:
                    value = get(cell, "value")
                    cells += [(c + k, text, float(value) if value else None) for k in range(min(n, 16384 - c))]
                c += n
            for k in range(rows if cells else 0):
                count += len(cells)
                if count > MAX_CELLS:
                    raise ValueError("too many cells")
                yield from ((get(table, "name"), r + k, c, text, v, get(row, "visibility") in ("collapse", "filter")) for c, text, v in cells)
            r += rows


def to_xlsx(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook of plain rows; numbers and booleans keep their type."""

    def cell(v: object, r: int, c: int) -> str:
        ref = f"{column_letters(c)}{r + 1}"
        if v is None or v == "":
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r + 1}">{"".join(cell(v, r, c) for c, v in enumerate(row))}</row>' for r, row in enumerate(sheets[n])) + "</sheetData></worksheet>")
    return out.getvalue()
