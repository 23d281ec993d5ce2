"""Workbooks in the xlsx format, read and written as bytes, on the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Fixed value: rows that a sheet of the format can hold, the header's included.
MOST_ROWS = 1_048_576


def column_letters(n: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cell texts of a sheet (the first by default), row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in book.iter(f"{_MAIN}sheet")}
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield cells
                row.clear()


def write_book(
    sheets: Sequence[tuple[str, Sequence[str], Sequence[Sequence]]], extra: dict[str, str] | None = None, hidden: dict[str, int] | None = None, charts: dict[str, str] | None = None
) -> bytes:
    """A workbook of (name, header, rows) sheets; numbers and booleans stay such, a text starting with = is text.

    The header row stays in view. By a sheet's name, extra has XML to stand after its rows (filters, validations) as the format allows,
    hidden the number of a column that is not shown, and charts a chart from line_chart.
    """
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, types = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument"
    extra, hidden, charts = extra or {}, hidden or {}, charts or {}
    drawn = [name for name, _, _ in sheets if name in charts]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda path, xml: z.writestr(path, f'<?xml version="1.0" encoding="UTF-8"?>{xml}')
        n = len(sheets)
        kinds = [(f"/xl/worksheets/sheet{i}.xml", "spreadsheetml.worksheet") for i in range(1, n + 1)] + [("/xl/styles.xml", "spreadsheetml.styles")]
        for i in range(1, len(drawn) + 1):
            kinds += [(f"/xl/drawings/drawing{i}.xml", "drawing"), (f"/xl/charts/chart{i}.xml", "drawingml.chart")]
        listed = "".join(f'<Override PartName="{path}" ContentType="{types}.{kind}+xml"/>' for path, kind in kinds)
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.spreadsheetml.sheet.main+xml"/>{listed}</Types>')
        links = lambda pairs: f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(pairs, 1)) + "</Relationships>"
        put("_rels/.rels", links([("officeDocument", "xl/workbook.xml")]))
        named = "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _, _) in enumerate(sheets, 1))
        put("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", links([("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, n + 1)] + [("styles", "styles.xml")]))
        put("xl/styles.xml", f'<styleSheet {ns}>{_STYLES}</styleSheet>')
        for i, (name, header, rows) in enumerate(sheets, 1):
            drawing = ""
            if name in charts:
                k = drawn.index(name) + 1
                drawing = '<drawing r:id="rId1"/>'
                put(f"xl/worksheets/_rels/sheet{i}.xml.rels", links([("drawing", f"../drawings/drawing{k}.xml")]))
                put(f"xl/drawings/_rels/drawing{k}.xml.rels", links([("chart", f"../charts/chart{k}.xml")]))
                put(f"xl/drawings/drawing{k}.xml", _DRAWING)
                put(f"xl/charts/chart{k}.xml", charts[name])
            at = hidden.get(name)
            columns = f'<cols><col min="{at + 1}" max="{at + 1}" width="5" hidden="1" customWidth="1"/></cols>' if at is not None else ""
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns} xmlns:r="{rel}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{columns}<sheetData>'.encode())
                for r, row in enumerate([header, *rows], 1):
                    f.write(f'<row r="{r}">{"".join(_cell(v, column_letters(c), r) for c, v in enumerate(row))}</row>'.encode())
                f.write(f"</sheetData>{extra.get(name, '')}{drawing}</worksheet>".encode())
    return out.getvalue()


#: Plain cells, and two looks for conditional formats: 0 marks a row, 1 dims it.
_STYLES = (
    '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs>'
    '<dxfs count="2"><dxf><fill><patternFill patternType="solid"><bgColor rgb="FFE2F0D9"/></patternFill></fill></dxf><dxf><font><color rgb="FFB0B0B0"/></font></dxf></dxfs>'
)
_DRAWN = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_DRAWING = (
    f'<xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" {_DRAWN}><xdr:twoCellAnchor><xdr:from><xdr:col>3</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>1</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>'
    "<xdr:to><xdr:col>12</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>20</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:to><xdr:graphicFrame macro=\"\"><xdr:nvGraphicFramePr><xdr:cNvPr id=\"2\" name=\"Chart\"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr>"
    '<xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" r:id="rId1"/></a:graphicData></a:graphic></xdr:graphicFrame><xdr:clientData/></xdr:twoCellAnchor></xdr:wsDr>'
)


def line_chart(title: str, labels: str, lines: Sequence[tuple[str, str]]) -> str:
    """A chart with a line for each (cell of its name, cells of its values) over the cells of the labels."""
    one = "".join(
        f'<c:ser><c:idx val="{i}"/><c:order val="{i}"/><c:tx><c:strRef><c:f>{escape(name)}</c:f></c:strRef></c:tx><c:cat><c:numRef><c:f>{escape(labels)}</c:f></c:numRef></c:cat><c:val><c:numRef><c:f>{escape(values)}</c:f></c:numRef></c:val></c:ser>'
        for i, (name, values) in enumerate(lines)
    )
    axis = lambda kind, i, other, side: f'<c:{kind}><c:axId val="{i}"/><c:scaling/><c:delete val="0"/><c:axPos val="{side}"/><c:crossAx val="{other}"/></c:{kind}>'
    return (
        f'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" {_DRAWN}><c:chart><c:title><c:tx><c:rich><a:bodyPr/><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:rich></c:tx></c:title>'
        f'<c:plotArea><c:lineChart><c:grouping val="standard"/>{one}<c:axId val="1"/><c:axId val="2"/></c:lineChart>{axis("catAx", 1, 2, "b")}{axis("valAx", 2, 1, "l")}</c:plotArea><c:legend><c:legendPos val="b"/></c:legend></c:chart></c:chartSpace>'
    )


#: Characters that XML cannot hold.
_NOT_XML = {c: None for c in (*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF)}


class Formula(str):
    """A cell whose text is a formula, without the leading =."""


def _cell(value, letters: str, row: int) -> str:
    if value is None:
        return ""
    ref = f"{letters}{row}"
    if isinstance(value, Formula):
        return f'<c r="{ref}"><f>{escape(value)}</f></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value).translate(_NOT_XML))}</t></is></c>'
