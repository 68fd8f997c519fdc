"""Sheets of xlsx and xlsm workbooks as streams of rows.

A workbook is a zip archive of XML parts. A sheet's part is inflated and parsed by events, so that only the rows of one
piece of it, the ranges of merged cells and the workbook's shared strings (their text, once) are in memory, whatever the
number of rows and columns.
"""

from __future__ import annotations

import re
import zipfile
from array import array
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat

from sheafwork.sources.cells import Cell, Range, Row, is_date_format, number_cell, with_merged

#: Bytes of a part that are inflated at once.
PIECE = 1 << 16

_REFERENCE = re.compile(r"([A-Z]+)([0-9]+)")
_MERGED = re.compile(rb"<(?:\w+:)?mergeCell\s[^>]*?ref=[\"']([^\"']+)[\"']")
_END_OF_DATA = re.compile(rb"</(?:\w+:)?sheetData\s*>|<(?:\w+:)?sheetData\s*/>")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in root.iter() if isinstance(x.tag, str) and _local(x.tag) == name)


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    """An attribute by its name without namespace."""
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def column_of(letters: str) -> int:
    """A column's number, from 0, by its letters."""
    out = 0
    for letter in letters:
        out = out * 26 + ord(letter) - 64
    return out - 1


def _range(ref: str) -> Range:
    (top_left, bottom_right) = (_REFERENCE.fullmatch(x) for x in (ref + ":" + ref).replace("$", "").split(":")[:2])
    return int(top_left[2]) - 1, int(bottom_right[2]) - 1, column_of(top_left[1]), column_of(bottom_right[1])


class Strings:
    """The shared strings, as one block of bytes and where each begins."""

    def __init__(self) -> None:
        self._text, self._starts = bytearray(), array("Q", [0])

    def append(self, text: str) -> None:
        self._text += text.encode("utf-8", "surrogatepass")
        self._starts.append(len(self._text))

    def __getitem__(self, k: int) -> str:
        if not 0 <= k < len(self._starts) - 1:
            raise ValueError(f"there is no shared string {k}")
        return self._text[self._starts[k] : self._starts[k + 1]].decode("utf-8", "surrogatepass")


def _pieces(book: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    with book.open(part) as stream:
        while piece := stream.read(PIECE):
            yield piece


def _events(pieces: Iterator[bytes], start, end, text) -> Iterator[None]:
    """Parse by events, called back by local names; yields after each piece."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: start(name.rpartition(" ")[2], attributes)
    parser.EndElementHandler = lambda name: end(name.rpartition(" ")[2])
    parser.CharacterDataHandler = text
    for piece in pieces:
        parser.Parse(piece, False)
        yield
    parser.Parse(b"", True)
    yield


def _strings(book: zipfile.ZipFile) -> Strings:
    """Texts of all runs of each string, without readings."""
    out, runs, state = Strings(), [], {"text": False, "reading": 0}

    def start(name: str, attributes: dict[str, str]) -> None:
        if name == "si":
            runs.clear()
        elif name == "rPh":
            state["reading"] += 1
        state["text"] = name == "t" and not state["reading"]

    def end(name: str) -> None:
        state["text"] = False
        if name == "rPh":
            state["reading"] -= 1
        elif name == "si":
            out.append("".join(runs))

    if "xl/sharedStrings.xml" in book.namelist():
        for _ in _events(_pieces(book, "xl/sharedStrings.xml"), start, end, lambda text: runs.append(text) if state["text"] else None):
            pass
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _all(root, "numFmt")}
    formats = next(_all(root, "cellXfs"), None)
    codes = [int(style.get("numFmtId", 0)) for style in (formats if formats is not None else ())]
    return {k for k, code in enumerate(codes) if is_date_format(code, own.get(code, ""))}


def _since_1904(book: zipfile.ZipFile) -> bool:
    properties = next(_all(ElementTree.fromstring(book.read("xl/workbook.xml")), "workbookPr"), None)
    return properties is not None and properties.get("date1904") in ("1", "true")


def sheets(file: BinaryIO) -> list[tuple[str, str]]:
    """(name, part) of each sheet of cells, in the workbook's order."""
    with zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        links = {x.get("Id"): (x.get("Target"), x.get("Type", "")) for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in _all(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet"):
            target, kind = links[_attribute(sheet, "id")]
            target = target.lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part in names and not kind.endswith(("/chartsheet", "/dialogsheet")):
                out.append((sheet.get("name"), part))
        return out


def merged_ranges(book: zipfile.ZipFile, part: str) -> list[Range]:
    """The merged ranges, which a part names behind its rows: the rows are inflated and passed over."""
    rest, found = b"", False
    for piece in _pieces(book, part):
        rest += piece
        if not found:
            end = _END_OF_DATA.search(rest)
            rest, found = (rest[end.end() :], True) if end else (rest[-64:], False)
    return [_range(ref.decode()) for ref in _MERGED.findall(rest)] if found else []


def _cell(kind: str, style: int, value: str, strings: Strings, dates: set[int], since_1904: bool) -> Cell:
    if kind == "inlineStr":
        return "s", value
    if not value:
        return None
    if kind == "s":
        return "s", strings[int(value)]
    if kind == "b":
        return "b", "True" if value == "1" else "False"
    if kind == "d":
        return "d", value[:10]
    return ("s", value) if kind in ("str", "e") else number_cell(float(value), style in dates, value, since_1904)


def _own_rows(book: zipfile.ZipFile, part: str) -> Iterator[Row]:
    strings, dates, since_1904 = _strings(book), _date_styles(book), _since_1904(book)
    done: list[Row] = []
    row = {"number": 0, "column": -1, "cells": []}
    cell = {"kind": "n", "style": 0, "text": [], "reads": False, "reading": 0}

    def start(name: str, attributes: dict[str, str]) -> None:
        if name == "row":
            row["number"] = int(attributes.get("r", row["number"] + 1))
            row["column"], row["cells"] = -1, []
        elif name == "c":
            ref = attributes.get("r")
            row["column"] = column_of(_REFERENCE.fullmatch(ref)[1]) if ref else row["column"] + 1
            cell.update(kind=attributes.get("t", "n"), style=int(attributes.get("s", 0)), text=[], reads=False)
        elif name == "rPh":
            cell["reading"] += 1
        else:
            cell["reads"] = name == ("t" if cell["kind"] == "inlineStr" else "v") and not cell["reading"]

    def end(name: str) -> None:
        cell["reads"] = False
        if name == "rPh":
            cell["reading"] -= 1
        elif name == "c":
            value = _cell(cell["kind"], cell["style"], "".join(cell["text"]), strings, dates, since_1904)
            if value is not None:
                row["cells"] += [None] * (row["column"] + 1 - len(row["cells"]))
                row["cells"][row["column"]] = value
        elif name == "row":
            done.append((row["number"], row["cells"]))

    try:
        for _ in _events(_pieces(book, part), start, end, lambda text: cell["text"].append(text) if cell["reads"] else None):
            yield from done
            done.clear()
    except Exception:  # the rows before the break are whole
        yield from done
        raise


def rows(file: BinaryIO, part: str) -> Iterator[Row]:
    """The rows of a sheet's part, merged ranges filled with their first cell's value (cells.with_merged)."""
    with zipfile.ZipFile(file) as book:
        yield from with_merged(_own_rows(book, part), merged_ranges(book, part))
