"""The cells of an Office Open XML workbook, read with the standard library: a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

#: Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}  # numbers of the built-in formats that show dates
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _text(item: ElementTree.Element) -> str:
    """The text of a shared string, its runs joined, without phonetic hints."""
    return "".join(t.text or "" for part in item if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))


def _column(reference: str) -> int:
    number = 0
    for letter in reference:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or a time: a date letter outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code), re.IGNORECASE))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): _is_date(f.get("formatCode") or "") for f in root.iter(f"{MAIN}numFmt")}
    formats = root.find(f"{MAIN}cellXfs")
    ids = [f.get("numFmtId") or "0" for f in formats] if formats is not None else []
    return [own.get(i, int(i) in DATE_FORMATS) for i in ids]


def _value(cell: ElementTree.Element, shared: list[str], dates: list[bool], first_day: datetime) -> str:
    """A cell as text; dates as year, month, day and time."""
    kind, value = cell.get("t") or "n", cell.findtext(f"{MAIN}v") or ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if not value:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    style = int(cell.get("s") or 0)
    if kind == "n" and style < len(dates) and dates[style]:
        return str(first_day + timedelta(seconds=round(float(value) * 86400)))
    if kind == "d":
        return str(datetime.fromisoformat(value))
    return value


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """The rows of the sheet named *sheet*, or of the first, as text; nothing if it is missing or *content* is no workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        index = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        names = [(s.get("name"), links[s.get(RELATION)]) for s in index.iter(f"{MAIN}sheet")]
        found = next((target for name, target in names if sheet in (None, name)), None)
        if found is None:
            return
        part = ElementTree.fromstring(book.read(found.lstrip("/") if found.startswith("/") else f"xl/{found}"))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        dates, about = _date_styles(book), index.find(f"{MAIN}workbookPr")
    except (zipfile.BadZipFile, zlib.error, KeyError, ValueError, ElementTree.ParseError):
        return
    first_day = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    for line in part.iter(f"{MAIN}row"):
        cells: list[str] = []
        for cell in line.iter(f"{MAIN}c"):
            reference = re.match("[A-Z]+", cell.get("r") or "")
            at = _column(reference[0]) if reference else len(cells)
            cells += [""] * (at + 1 - len(cells))
            try:
                cells[at] = _value(cell, shared, dates, first_day)
            except (ValueError, IndexError, OverflowError):  # a cell that cannot be read is empty
                cells[at] = ""
        yield cells
