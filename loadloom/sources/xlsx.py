"""Workbooks with the standard library: cell texts in, tables out."""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterable
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Number formats that stand for dates.
_DATE_FORMATS = {14, 15, 16, 17, 22}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read(data: bytes, sheet: int | str = 0) -> list[list[str | None]]:
    """Rows of a sheet (by place or name) as texts; dates as yyyy-MM-dd."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            formats = styles.find(f"{_MAIN}cellXfs")
            dated = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet")]
        target = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                text = v.text if v is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif text is not None and kind in (None, "n") and int(c.get("s", 0)) in dated:
                    text = (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(text))).date().isoformat()
                cells[_column(c.get("r")) if c.get("r") else i] = text
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at - len(rows))]
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def table(data: bytes, sheet: int | str = 0) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of a sheet, the rows as wide as the header."""
    rows = read(data, sheet)
    if not rows:
        return [], []
    header = [h or f"_{i}" for i, h in enumerate(rows[0])]
    return header, [(r + [None] * len(header))[: len(header)] for r in rows[1:]]


def _ref(row: int, col: int) -> str:
    name = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row + 1}"


def _cell(row: int, col: int, value) -> str:
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{_ref(row, col)}"><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{_ref(row, col)}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def sheet_names(names: Iterable[str]) -> list[str]:
    """Names that a workbook takes: 31 characters, none of its marks, no two alike."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        new, k = base, 1
        while new.lower() in {o.lower() for o in out}:
            k += 1
            new = f"{base[: 30 - len(str(k))]}_{k}"
        out.append(new)
    return out


def write(sheets: dict[str, tuple[list[str], Iterable[Iterable]]]) -> bytes:
    """A workbook of (header, rows) by name; one with a note where there is none or nothing in it."""
    sheets = {k: v for k, v in sheets.items() if v[0]} or {"Empty": (["Note"], [["No data"]])}
    names = sheet_names(sheets)
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PKG}">{links}</Relationships>')
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{tabs}</sheets></workbook>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r + 1}">{"".join(_cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows]))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
