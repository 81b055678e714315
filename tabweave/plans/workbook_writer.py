"""A minimal .xlsx writer, to derive workbooks from tables for the checks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(row: int, col: int, value, shared: dict[str, int] | None) -> str:
    if value is None or value != value:
        return ""
    at = f"{_letters(col)}{row}"
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{value:d}</v></c>'
    if isinstance(value, datetime):
        return f'<c r="{at}" s="1"><v>{(value - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, str):
        if shared is not None:
            return f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c r="{at}"><v>{value!r}</v></c>'


def workbook_bytes(header: Sequence[str | None], rows: Sequence[Sequence], sheet: str = "Sheet1",
                   share_strings: bool = False) -> bytes:
    lines = [list(header), *rows]
    shared: dict[str, int] | None = {} if share_strings else None
    body = "".join(f'<row r="{i}">' + "".join(_cell(i, j, v, shared) for j, v in enumerate(line, 1)) + "</row>"
                   for i, line in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet)}" '
                                         'sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      f'<Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        # style 1 shows a date and time
        book.writestr("xl/styles.xml", f'<styleSheet {_NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(
                f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()
