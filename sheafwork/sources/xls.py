"""Sheets of old xls workbooks: a compound file's streams, and the records of the workbook's stream.

A compound file is a small file system: sectors, an allocation table that chains them, a directory of streams, and a mini
stream for short ones. The workbook's stream is a list of records; texts are shared in a table that may go on in continue
records, which can begin in the middle of a text. Any chain or record that leads nowhere is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from sheafwork.sources.cells import Cell, Range, Row, is_date_format, number_cell, with_merged

# Signature and marks of a compound file, types of records, and the texts of errors.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END_OF_CHAIN, FREE = 0xFFFFFFFE, 0xFFFFFFFF
BOF, EOF, CONTINUE, ENCRYPTED, CODEPAGE, DATE_MODE, SHEET, FORMAT, OLD_FORMAT, STYLE, SHARED_STRINGS = 0x809, 0x0A, 0x3C, 0x2F, 0x42, 0x22, 0x85, 0x41E, 0x1E, 0xE0, 0xFC
NUMBER, LABEL, RICH_LABEL, SHARED_LABEL, SHORT_NUMBER, SHORT_NUMBERS, BOOLEAN, FORMULA, STRING, MERGED = 0x203, 0x204, 0xD6, 0xFD, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0xE5
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
CODEPAGES = {367: "ascii", 1200: "utf-16-le", 10000: "mac-roman", 32768: "mac-roman", 32769: "cp1252"}


class CompoundFile:
    """The streams of a compound file."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or data[:8] != SIGNATURE:
            raise ValueError("this is no compound file")
        self._data = data
        shift, self._mini_shift = struct.unpack_from("<HH", data, 0x1E)
        if shift not in (9, 12) or not 1 <= self._mini_shift < shift:
            raise ValueError(f"sectors of 2^{shift} and 2^{self._mini_shift} bytes")
        self._size = 1 << shift
        directory, self._cutoff, first_mini = struct.unpack_from("<I", data, 0x30)[0], *struct.unpack_from("<II", data, 0x38)
        self._next = self._table(self._table_sectors(*struct.unpack_from("<II", data, 0x44)))
        self._mini_next = self._table(self._chain(first_mini, self._next)) if first_mini < END_OF_CHAIN else ()
        self._streams: dict[str, tuple[int, int]] = {}
        self._mini = b""
        listing = self._read(directory)
        for at in range(0, len(listing) - 127, 128):
            name_size, kind = struct.unpack_from("<HB", listing, at + 64)
            start, size = struct.unpack_from("<IQ", listing, at + 116)
            size = size & 0xFFFFFFFF if shift == 9 else size  # small sectors have 32-bit sizes
            if kind == 2:
                self._streams.setdefault(listing[at : at + max(0, min(name_size, 64) - 2)].decode("utf-16-le", "replace"), (start, size))
            elif kind == 5 and start < END_OF_CHAIN:
                self._mini = self._read(start)[:size]

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self._size
        if at >= len(self._data):
            raise ValueError(f"a chain leads to sector {k}, which is not there")
        return self._data[at : at + self._size]

    def _table_sectors(self, first: int, count: int) -> list[int]:
        """The sectors of the allocation table: 109 named by the header, the others by a chain of sectors."""
        found = list(struct.unpack_from("<109I", self._data, 0x4C))
        seen: set[int] = set()
        while count and first < END_OF_CHAIN:
            if first in seen:
                raise ValueError("a chain of sectors goes in a circle")
            seen.add(first)
            *more, first = struct.unpack(f"<{self._size // 4}I", self._sector(first).ljust(self._size, b"\xff"))
            found += more
        return [k for k in found if k < END_OF_CHAIN - 2]

    def _table(self, sectors: list[int]) -> tuple[int, ...]:
        whole = b"".join(self._sector(k).ljust(self._size, b"\xff") for k in sectors)
        return struct.unpack(f"<{len(whole) // 4}I", whole)

    @staticmethod
    def _chain(first: int, following: tuple[int, ...]) -> list[int]:
        out, at = [], first
        while at != END_OF_CHAIN:
            if at >= len(following):
                raise ValueError(f"a chain leads to sector {at}, which is not there")
            if len(out) > len(following):
                raise ValueError("a chain of sectors goes in a circle")
            out.append(at)
            at = following[at]
        return out

    def _read(self, first: int) -> bytes:
        return b"".join(map(self._sector, self._chain(first, self._next)))

    def stream(self, *names: str) -> bytes | None:
        """The first stream of one of these names, in either case."""
        known = {name.lower(): where for name, where in self._streams.items()}
        for name in names:
            if (where := known.get(name.lower())) is None:
                continue
            start, size = where
            if not size:
                return b""
            if size >= self._cutoff:
                whole = self._read(start)
            else:
                step = 1 << self._mini_shift
                whole = b"".join(self._mini[k * step : (k + 1) * step] for k in self._chain(start, self._mini_next))
            if len(whole) < size:
                raise ValueError(f"{name} has {len(whole)} of {size} bytes")
            return whole[:size]
        return None


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(type, place, content) of each record from a place on."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if at + 4 + size > len(stream):
            raise ValueError(f"a record at {at} ends beyond the stream")
        yield kind, at, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Parts:
    """A record's content and that of its continue records, read as one."""

    def __init__(self, parts: list[bytes]) -> None:
        self._parts, self._part, self._at = parts, 0, 0

    def _room(self) -> int:
        while self._part < len(self._parts) and self._at >= len(self._parts[self._part]):
            self._part, self._at = self._part + 1, 0
        if self._part >= len(self._parts):
            raise ValueError("the shared strings end too early")
        return len(self._parts[self._part]) - self._at

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            step = min(n, self._room())
            out += self._parts[self._part][self._at : self._at + step]
            self._at, n = self._at + step, n - step
        return out

    def text(self) -> str:
        """A text with its flags; behind a break in its characters flags come anew, as their width may change."""
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        part = self._part
        while n:
            room = self._room()
            if self._part != part:
                part, flags, room = self._part, self.take(1)[0], room - 1
                if not room:
                    continue
            width = 1 + (flags & 1)
            step = min(n, room // width)
            if not step:
                raise ValueError("a shared string breaks inside a character")
            out.append(self.take(step * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            n -= step
        self.take(4 * runs + extra)
        return "".join(out)


class Workbook:
    """The sheets, shared strings and formats of a workbook's stream."""

    def __init__(self, data: bytes) -> None:
        stream = CompoundFile(data).stream("Workbook", "Book")
        if stream is None:
            raise ValueError("the file has no workbook")
        self._stream, self.sheets, self._strings = stream, [], []
        self._since_1904, self._encoding, self._dates = False, "cp1252", set()
        own, codes, table = {}, [], None
        records = _records(stream)
        first = next(records, None)
        if first is None or first[0] != BOF:
            raise ValueError("the workbook's stream doesn't begin as one")
        self._wide = struct.unpack_from("<H", first[2])[0] >= 0x600
        for kind, _, body in records:
            if table is not None and kind != CONTINUE:
                self._share(table)
                table = None
            if kind == EOF:
                break
            if kind == ENCRYPTED:
                raise ValueError("the file is encrypted: save it without a password")
            if kind == CODEPAGE:
                page = struct.unpack_from("<H", body)[0]
                self._encoding = CODEPAGES.get(page, f"cp{page}")
            elif kind == DATE_MODE:
                self._since_1904 = struct.unpack_from("<H", body)[0] == 1
            elif kind == SHEET:
                where, _, what = struct.unpack_from("<IBB", body)
                if what == 0:  # cells, no chart or macro
                    self.sheets.append((self._text(body, 6, "B"), where))
            elif kind in (FORMAT, OLD_FORMAT):
                own[struct.unpack_from("<H", body)[0]] = self._text(body, 2, "H" if self._wide else "B")
            elif kind == STYLE:
                codes.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == SHARED_STRINGS:
                table = [body]
            elif kind == CONTINUE and table is not None:
                table.append(body)
        self._dates = {k for k, code in enumerate(codes) if is_date_format(code, own.get(code, ""))}

    def _share(self, parts: list[bytes]) -> None:
        whole = _Parts(parts)
        _, n = struct.unpack("<II", whole.take(8))
        self._strings = [whole.text() for _ in range(n)]

    def _text(self, body: bytes, at: int, size: str) -> str:
        """A text within one record: its length, in newer files flags, and its characters."""
        n, at = struct.unpack_from(f"<{size}", body, at)[0], at + struct.calcsize(size)
        if not self._wide:
            return body[at : at + n].decode(self._encoding, "replace")
        flags, at = body[at], at + 1
        at += 2 * bool(flags & 8) + 4 * bool(flags & 4)
        return body[at : at + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")

    def _number(self, style: int, value: float) -> Cell:
        return number_cell(value, style in self._dates, since_1904=self._since_1904)

    @staticmethod
    def _short(code: int) -> float:
        """A number in 30 bits: a whole one or the upper part of a double, either perhaps in hundredths."""
        value = float(struct.unpack("<i", struct.pack("<I", code))[0] >> 2) if code & 2 else struct.unpack("<d", struct.pack("<Q", (code & 0xFFFFFFFC) << 32))[0]
        return value / 100 if code & 1 else value

    def _cells(self, where: int, merged: list[Range]) -> Iterator[tuple[int, int, Cell]]:
        """(row, column, cell) in the order of the records."""
        awaits: tuple[int, int] | None = None  # the formula whose text comes next
        depth = 0
        for kind, _, body in _records(self._stream, where):
            if kind == BOF:
                depth += 1  # charts within a sheet have records of their own
            elif kind == EOF:
                depth -= 1
                if not depth:
                    return
            elif depth != 1:
                continue
            elif kind == STRING and awaits:
                yield *awaits, ("s", self._text(body, 0, "H"))
            elif kind == MERGED:
                merged += struct.iter_unpack("<4H", body[2 : 2 + 8 * struct.unpack_from("<H", body)[0]])
            elif kind == SHORT_NUMBERS:
                row, column = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, code = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row, column + k, self._number(style, self._short(code))
            elif kind in (NUMBER, LABEL, RICH_LABEL, SHARED_LABEL, SHORT_NUMBER, BOOLEAN, FORMULA):
                row, column, style = struct.unpack_from("<HHH", body)
                if kind == FORMULA and body[12:14] == b"\xff\xff" and body[6] == 0:
                    awaits = row, column
                    continue
                yield row, column, self._cell(kind, style, body)
        raise ValueError("a sheet has no end")

    def _cell(self, kind: int, style: int, body: bytes) -> Cell:
        if kind in (LABEL, RICH_LABEL):
            return "s", self._text(body, 6, "H")
        if kind == SHARED_LABEL:
            k = struct.unpack_from("<I", body, 6)[0]
            if k >= len(self._strings):
                raise ValueError(f"there is no shared string {k}")
            return "s", self._strings[k]
        if kind == SHORT_NUMBER:
            return self._number(style, self._short(struct.unpack_from("<I", body, 6)[0]))
        if kind == BOOLEAN or kind == FORMULA and body[12:14] == b"\xff\xff":
            what, value = (2 if body[7] else 1, body[6]) if kind == BOOLEAN else (body[6], body[8])
            return ("b", "True" if value else "False") if what == 1 else ("s", ERRORS.get(value, "#ERR!")) if what == 2 else None
        return self._number(style, struct.unpack_from("<d", body, 6)[0])

    def rows(self, where: int) -> Iterator[Row]:
        """A sheet's rows. Records may come in any order, and a sheet has at most 65536 rows of 256 cells."""
        found: dict[int, dict[int, Cell]] = {}
        merged: list[Range] = []
        for row, column, cell in self._cells(where, merged):
            if cell is not None and cell[1] != "":
                found.setdefault(row, {})[column] = cell
        own = ((row + 1, [found[row].get(c) for c in range(max(found[row]) + 1)]) for row in sorted(found))
        yield from with_merged(own, merged)


def sheets(file: BinaryIO) -> list[tuple[str, int]]:
    """(name, place in the stream) of each sheet of cells."""
    return Workbook(file.read()).sheets


def rows(file: BinaryIO, where: int) -> Iterator[Row]:
    return Workbook(file.read()).rows(where)
