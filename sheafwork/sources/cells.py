"""Rows of cells from any kind of file, as Arrow batches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa

from sheafwork.operators.headers import GRID

#: A cell's kind (n, d, b or s) and text; None if it is empty.
Cell = tuple[str, str] | None
#: A row's number, from 1, and its cells.
Row = tuple[int, list[Cell]]
#: First and last row and column of a merged range, from 0.
Range = tuple[int, int, int, int]

SCHEMA = f"{GRID}, error string"
_CELL = pa.struct([("kind", pa.string()), ("text", pa.string())])
ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(_CELL)), ("error", pa.string())])
#: Cells in a batch.
BATCH_CELLS = 20_000

# The built-in number formats that are dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def is_date_format(code: int, own: str) -> bool:
    """Whether a number of this format is a date: a built-in one, or an own pattern with parts of dates and no digits."""
    letters = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own)
    return code in DATE_FORMATS or bool(re.search("[ymdhs年月日]", letters, re.I)) and not re.search("[#0]", letters.replace("ss.0", ""))


def number_cell(number: float, is_date: bool, written: str = "", since_1904: bool = False) -> Cell:
    """A number as a cell: whole ones without a point, dates as ISO text. written is the file's own text of it."""
    if is_date:
        try:
            start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
            return "d", (start + timedelta(days=number)).date().isoformat()
        except (OverflowError, ValueError):  # no day of the calendar: a number after all
            pass
    if number.is_integer() and abs(number) < 1e15:
        return "n", str(int(number))
    return "n", written if re.fullmatch(r"-?[0-9]+", written) else repr(number)


def with_merged(rows: Iterable[Row], ranges: list[Range]) -> Iterator[Row]:
    """Every row up to the last given one, blank ones too, with merged ranges filled with their first cell's value.
    Ranges stay intervals: only those that reach the present row are looked at, and a row's part is filled as it passes.
    rows are in order; a range that goes on below the last one ends there."""
    waiting = sorted(ranges, reverse=True)
    open_ranges: list[tuple[Range, Cell]] = []
    expected = 1
    for number, cells in rows:
        if number < expected:
            raise ValueError(f"row {number} comes again")
        for at in range(expected, number + 1):
            own = cells if at == number else []
            while waiting and waiting[-1][0] <= at - 1:
                area = waiting.pop()
                value = own[area[2]] if area[0] == at - 1 and area[2] < len(own) else None
                if value is not None:
                    open_ranges.append((area, value))
            open_ranges = [x for x in open_ranges if x[0][1] >= at - 1]
            for (_, _, left, right), value in open_ranges:
                own = own + [None] * (right + 1 - len(own)) if len(own) <= right else own
                own[left : right + 1] = [value] * (right + 1 - left)
            yield at, own
        expected = number + 1


def batches(file: str, sheet: str, rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_CELLS cells; if they break off, those before come out first."""
    numbers: list[int] = []
    offsets, kinds, texts, empty = [0], [], [], []

    def batch() -> pa.RecordBatch:
        n = len(numbers)
        structs = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], fields=list(_CELL), mask=pa.array(empty, pa.bool_()))
        cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=pa.list_(_CELL))
        return pa.record_batch([pa.array([file] * n), pa.array([sheet] * n, pa.string()), pa.array(numbers, pa.int32()), cells, pa.nulls(n, pa.string())], schema=ARROW)

    try:
        for number, cells in rows:
            numbers.append(number)
            for cell in cells:
                kinds.append(cell and cell[0])
                texts.append(cell and cell[1])
                empty.append(cell is None)
            offsets.append(len(kinds))
            if len(kinds) + len(numbers) >= BATCH_CELLS:
                yield batch()
                numbers, offsets, kinds, texts, empty = [], [0], [], [], []
    except Exception:
        if numbers:
            yield batch()
        raise
    if numbers:
        yield batch()


def failure(file: str, problem: BaseException | str, sheet: str | None = None) -> pa.RecordBatch:
    """The one row that tells why a file, or a sheet of it, can't be read."""
    text = problem if isinstance(problem, str) else str(problem) or type(problem).__name__
    return pa.RecordBatch.from_pylist([{"file": file, "sheet": sheet, "row_no": None, "cells": None, "error": text}], ARROW)
