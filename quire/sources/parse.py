"""Parsers of file contents: text with an encoding cascade, CSV, HTML, Office archives. A failure is a row, never an exception."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import extension

# The loader of each extension.
LOADERS = {
    "pdf": "pdf", "docx": "word", "doc": "word", "wps": "word", "xlsx": "excel", "xls": "excel", "pptx": "ppt", "ppt": "ppt", "ppsx": "ppt",
    "txt": "text", "md": "text", "csv": "csv", "json": "text", "xml": "text", "rtf": "rtf", "html": "html", "htm": "html", "caj": "caj",
}
ENCODINGS = ["utf-8", "gbk", "gb2312", "latin-1"]


def loader_of(path: Column) -> Column:
    """Name of the loader of a path; 'none' where there is none."""
    kinds = F.create_map(*(F.lit(x) for kv in LOADERS.items() for x in kv))
    return F.coalesce(kinds[extension(path)], F.lit("none"))


def decode(raw: bytes, encodings: list[str] = ENCODINGS) -> tuple[str, str]:
    """(text, encoding) by the first encoding that fits."""
    for e in encodings:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.titles: dict[str, str] = {}
        self.skip = 0
        self.inside: str | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in ("script", "style")
        if tag in ("title", "h1") and tag not in self.titles:
            self.inside = tag
            self.titles[tag] = ""
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "title"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag == self.inside:
            self.inside = None
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "title"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)
            if self.inside:
                self.titles[self.inside] += data


def parse_html(page: str) -> tuple[str, str | None]:
    """(text, title): lines stripped and cut at double spaces, empty ones dropped; the title is <title>, else the first <h1>."""
    p = _Text()
    p.feed(page)
    p.close()
    parts = (x.strip() for line in "".join(p.out).splitlines() for x in line.strip().split("  "))
    title = p.titles.get("title") or p.titles.get("h1")
    return "\n".join(x for x in parts if x), title.strip() if title else None


def html_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else parse_html(x)[0])

    return text(page)


def fix_encoding(c: Column) -> Column:
    """Text read as cp1252 that is UTF-8 is read again where that loses nothing; entities are resolved; composed form."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        for e in ("cp1252", "latin-1"):
            try:
                t = t.encode(e).decode("utf-8") if not t.isascii() else t
                break
            except UnicodeError:
                continue
        return unicodedata.normalize("NFC", html.unescape(t))

    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return fixed(c)


@dataclass
class Loaded:
    """What a parser found: the text, what it knows about the file, and its pages or slides as (number, text)."""

    content: str
    metadata: dict[str, str] = field(default_factory=dict)
    pages: list[tuple[int, str]] = field(default_factory=list)


def parse_text(raw: bytes) -> Loaded:
    text, encoding = decode(raw)
    return Loaded(text, {"encoding": encoding})


def parse_page(raw: bytes) -> Loaded:
    """An HTML file: text, encoding, and the title where there is one."""
    page, encoding = decode(raw)
    text, title = parse_html(page)
    return Loaded(text, {"encoding": encoding, **({"title": title} if title else {})})


def parse_csv(raw: bytes) -> Loaded:
    """Rows as cells joined by bars. Encodings as for CSV: without latin-1, and a retry starts afresh."""
    text, encoding = decode(raw, ENCODINGS[:3])
    rows = [" | ".join(r) for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        raise ValueError("no rows")
    return Loaded("\n".join(rows), {"encoding": encoding, "row_count": str(len(rows))})


def _xml_texts(raw: bytes, paragraph: str, run: str) -> list[str]:
    out = []
    for p in ElementTree.fromstring(raw).iter():
        if p.tag.endswith("}" + paragraph):
            out.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + run)))
    return out


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    """Author and title of an Office archive, those that are there."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    found = {t.tag.rsplit("}", 1)[-1]: t.text for t in ElementTree.fromstring(z.read("docProps/core.xml")).iter() if t.text}
    return {name: found[tag] for name, tag in (("author", "creator"), ("title", "title")) if tag in found}


def parse_docx(raw: bytes) -> Loaded:
    """Paragraphs that aren't blank, an empty line between; author and title."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        text = "\n\n".join(x for x in _xml_texts(z.read("word/document.xml"), "p", "t") if x.strip())
        return Loaded(text, _core(z))


def _number(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


def parse_pptx(raw: bytes) -> Loaded:
    """Slides in the order of their numbers: those with text are pages; slide_count counts these."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        slides = [(_number(n), "\n".join(x for x in _xml_texts(z.read(n), "p", "t") if x.strip())) for n in names]
        slides = [(n, x) for n, x in slides if x]
        return Loaded("\n\n".join(x for _, x in slides), {"slide_count": str(len(slides)), **_core(z)}, slides)


def _sheet_files(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, file) of the sheets of a workbook, by their relationship ids."""
    target = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter():
            if "Id" in r.attrib:
                path = r.attrib.get("Target", "")
                target[r.attrib["Id"]] = path.lstrip("/") if path.startswith("/") else "xl/" + path
    sheets = [t for t in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if t.tag.endswith("}sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
    out = []
    for i, t in enumerate(sheets):
        rid = next((v for k, v in t.attrib.items() if k.endswith("}id")), None)
        file = target.get(rid) or (files[i] if i < len(files) else None)
        if file in z.namelist():
            out.append((t.attrib["name"], file))
    return out


def parse_xlsx(raw: bytes) -> Loaded:
    """Sheets under a line with their name; cells that aren't empty joined by bars, empty rows dropped."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = _xml_texts(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        sheets = _sheet_files(z)
        for title, name in sheets:
            out.append(f"=== Sheet: {title} ===")
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    value = "".join(t.text or "" for t in c.iter() if t.tag.endswith("}v") or t.tag.endswith("}t"))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                if any(cells):
                    out.append(" | ".join(x for x in cells if x))
        return Loaded("\n".join(out), {"sheet_count": str(len(sheets)), "sheet_names": json.dumps([t for t, _ in sheets], ensure_ascii=False), **_core(z)})


def _unsupported(kind: str) -> Callable[[bytes], Loaded]:
    def parse(_: bytes) -> Loaded:
        raise ValueError(f"{kind} needs a recogniser, which isn't installed")

    return parse


PARSERS: dict[str, Callable[[bytes], Loaded | str]] = {
    "text": parse_text, "rtf": parse_text, "csv": parse_csv, "html": parse_page,
    "word": parse_docx, "excel": parse_xlsx, "ppt": parse_pptx, "pdf": _unsupported("pdf"), "caj": _unsupported("caj"),
}


def register(ext: str, loader: str, parser: Callable[[bytes], Loaded | str]) -> None:
    """Make a further file type known, or a parser for one that needs more than is installed (pdf, caj, doc, xls, ppt); call it before the plan is built."""
    LOADERS[ext.lower().lstrip(".")] = loader
    PARSERS[loader] = parser


LOADED = "path string, loader string, content string, error string, metadata map<string,string>, pages array<struct<page_num:int,content:string>>"


def load(files: DataFrame) -> DataFrame:
    """(path, loader, content, error, metadata, pages) of files(path, content): the text of each, or empty text and the error's words."""
    parsers, loaders = dict(PARSERS), dict(LOADERS)
    page = pa.struct([("page_num", pa.int32()), ("content", pa.string())])
    kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.list_(page)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                loader = loaders.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "", "none")
                try:
                    if loader not in parsers:
                        raise ValueError("unknown file type")
                    got = parsers[loader](raw or b"")
                    got = got if isinstance(got, Loaded) else Loaded(got)
                    out.append((path, loader, got.content, None, list(got.metadata.items()), [{"page_num": n, "content": t} for n, t in got.pages]))
                except Exception as e:  # the row says what failed
                    out.append((path, loader, "", f"{type(e).__name__}: {e}", [], []))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["path", "loader", "content", "error", "metadata", "pages"])

    return files.select("path", "content").mapInArrow(run, LOADED)


def page_rows(loaded: DataFrame) -> DataFrame:
    """(path, page_num, content): the pages or slides of loaded files, one row each."""
    return loaded.select("path", F.explode("pages").alias("p")).select("path", "p.page_num", "p.content")


def pages_of_elements(elements: DataFrame, block: int = 10_000) -> DataFrame:
    """(file_path, page_no, page_num, content) of elements(file_path, element_no, page_num, text): runs of elements of one page, joined by newlines.

    Blank texts give nothing; an element without a page number belongs to the page of the one before it, the first ones
    to page 1. A page number that comes again later is a page of its own, numbered by page_no. Each file is walked in
    blocks of element numbers, and what a block begins with is told by the blocks before it, so no file is one task's.
    """
    rows = elements.where(F.length(F.trim("text")) > 0).withColumn("block", F.floor(F.col("element_no") / block))
    inside = Window.partitionBy("file_path", "block").orderBy("element_no")
    known = rows.withColumn("page", F.last("page_num", ignorenulls=True).over(inside))
    ends = known.groupBy("file_path", "block").agg(F.max_by("page", "element_no").alias("end"))
    across = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("file_path", "block", F.coalesce(F.last("end", ignorenulls=True).over(across), F.lit(1)).alias("begin"))
    filled = known.join(begins, ["file_path", "block"]).withColumn("page", F.coalesce("page", "begin"))
    new = (F.col("page") != F.coalesce(F.lag("page").over(inside), F.col("begin"))).cast("int")
    runs = filled.withColumn("run", F.sum(new).over(inside))
    counts = runs.groupBy("file_path", "block").agg(F.max("run").alias("n"))
    before = counts.select("file_path", "block", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    numbered = runs.join(before, ["file_path", "block"]).withColumn("page_no", (F.col("run") + F.col("before")).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_no", "text"))), lambda x: x["text"]), "\n")
    return numbered.groupBy("file_path", "page_no").agg(F.first("page").alias("page_num"), text.alias("content")).select("file_path", "page_no", "page_num", "content")


def recognise(images: DataFrame, load_recogniser: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(path, page_num, content, error) of images(path, page_num, image): pages read by a recogniser, loaded once a task. A page it fails on is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = load_recogniser()
        for batch in batches:
            out = []
            for image in batch.column(2).to_pylist():
                try:
                    out.append((read(image or b""), None))
                except Exception as e:  # the row says what failed
                    out.append(("", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], pa.string()) for i in (0, 1))], names=["path", "page_num", "content", "error"])

    return images.select("path", F.col("page_num").cast("int").alias("page_num"), "image").mapInArrow(run, "path string, page_num int, content string, error string")
