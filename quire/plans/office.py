"""Small files of the formats that the parsers read, written from columns: what the loading queries work on."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{0}</dc:creator><dc:title>{0}</dc:title></cp:coreProperties>'


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def docx(title: str, lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _archive({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": _CORE.format(escape(title))})


def pptx(title: str, lines: list[str]) -> bytes:
    """A slide for each line."""
    slide = lambda x: f"<p:sld xmlns:p='p' {_A}><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>"
    return _archive({**{f"ppt/slides/slide{i + 1}.xml": slide(x) for i, x in enumerate(lines)}, "docProps/core.xml": _CORE.format(escape(title))})


def xlsx(title: str, lines: list[str]) -> bytes:
    """Two sheets, whose files stand in another order than their names: the title alone, and a row of one cell for each line."""
    sheet = lambda rows: f"<worksheet {_S}><sheetData>" + "".join(f'<row><c t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for x in rows) + "</sheetData></worksheet>"
    book = f'<workbook {_S}><sheets><sheet name="head" r:id="rId2"/><sheet name="body" r:id="rId1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>'
    return _archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet(lines), "xl/worksheets/sheet2.xml": sheet([title])})


def csv(title: str, lines: list[str]) -> bytes:
    return "\n".join(",".join('"' + x.replace('"', '""') + '"' for x in (title, y)) for y in lines).encode("gbk")


def html(title: str, lines: list[str]) -> bytes:
    return f"<html><head><title>{escape(title)}</title></head><body>{''.join(f'<p>{escape(x)}</p>' for x in lines)}</body></html>".encode()


def text(title: str, lines: list[str]) -> bytes:
    return "\n".join([title, *lines]).encode()


def pdf(title: str, lines: list[str]) -> bytes:
    return b"%PDF-1.4"


WRITERS: dict[str, Callable[[str, list[str]], bytes]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "csv": csv, "html": html, "txt": text, "pdf": pdf}


def written(kind: Column, title: Column, lines: Column) -> Column:
    """Bytes of a file of each kind."""

    @F.pandas_udf("binary")
    def write(kinds: pd.Series, titles: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([WRITERS[k](t, list(x)) for k, t, x in zip(kinds, titles, parts)])

    return write(kind, title, lines)
