"""Workbooks of any number of rows: executors write compressed pieces of sheets, the driver only joins their bytes.

A sheet is one compressed member of a zip archive. A deflate stream may be flushed to a byte's edge, so each block of
rows is compressed on its own and blocks are put one after the other; the checksum of the whole follows from the blocks'
checksums and lengths. Rows and cells bear no references, as their place in the file says which they are, so a block
doesn't depend on those before it. Each task writes its blocks and a manifest of them into one file of the shared folder,
through Spark's committed writer; the driver reads the manifests, decides which blocks make which sheet, and has the
file system copy the bytes.
"""

from __future__ import annotations

import json
import struct
import warnings
import zlib
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a sheet with its header, characters of a cell, rows and bytes of a block, rows that widths are taken from.
SHEET_ROWS, CELL_CHARS, BLOCK_ROWS, BLOCK_BYTES, SAMPLE_ROWS = 1_048_576, 32_767, 32_768, 32 << 20, 200
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_LIMIT = 0xFFFFFFFF


def reference(row: int, column: int) -> str:
    letters = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def width_of(value: object) -> int:
    """Columns that a value takes; full-width characters take two."""
    return sum(2 if ord(c) > 0x2E7F else 1 for c in str(value))


def _written(value: object) -> str:
    """A value as a text that a cell can hold, but for its length."""
    if isinstance(value, (date, datetime)):
        value = value.isoformat()
    return "".join(c for c in str(value) if c >= " " or c in "\t\n")


def cell(value: object, style: int = 0) -> str:
    """A cell without its reference."""
    look = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{look}/>"
    if isinstance(value, bool):
        return f'<c{look} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and abs(value) < 10**15:
        return f"<c{look}><v>{value}</v></c>"
    return f'<c{look} t="inlineStr"><is><t xml:space="preserve">{escape(_written(value)[:CELL_CHARS])}</t></is></c>'


def deflated(data: bytes) -> bytes:
    """A piece of a raw deflate stream that ends at a byte's edge and refers to nothing before it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)


#: The last, empty piece of a deflate stream.
END_OF_STREAM = b"\x03\x00"


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts one after the other, from theirs and the second's length: the first one's is carried over
    as many zero bytes, by squaring the matrix that a zero bit stands for."""
    if not length:
        return first
    bit = [0xEDB88320] + [1 << k for k in range(31)]
    square = lambda m: [_times(m, m[k]) for k in range(32)]
    matrix = square(square(square(bit)))  # of a byte
    while length:
        if length & 1:
            first = _times(matrix, first)
        matrix, length = square(matrix), length >> 1
    return first ^ second


def _blocks(block_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's blocks, then its manifest with its own length as the last ten digits."""
    manifest: list[dict[str, int]] = []
    cut = 0
    rows: list[str] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal rows, size
        data = "".join(rows).encode()
        packed = deflated(data)
        manifest.append({"rows": len(rows), "crc": zlib.crc32(data), "size": len(data), "packed": len(packed)})
        rows, size = [], 0
        return pa.record_batch([pa.array([packed], pa.binary())], ["value"])

    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else ():
            cut += sum(isinstance(v, str) and len(v) > CELL_CHARS and len(_written(v)) > CELL_CHARS for v in values)
            rows.append(f"<row>{''.join(map(cell, values))}</row>")
            size += len(rows[-1])
            if len(rows) >= block_rows or size >= BLOCK_BYTES:
                yield block()
    if rows:
        yield block()
    said = json.dumps({"blocks": manifest, "cut": cut}).encode()
    yield pa.record_batch([pa.array([said + b"%010d" % len(said)], pa.binary())], ["value"])


class _Archive:
    """A zip archive written from front to back into a stream of a Hadoop file system."""

    def __init__(self, out: object) -> None:
        self._out, self._at, self._entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self._out.write(bytearray(data))
        self._at += len(data)

    def member(self, name: str, pieces: list[tuple[int, int, int]], parts: list[object]) -> None:
        """pieces: (crc, size, packed size) of each part; parts: bytes, or a function that copies that many to the stream."""
        crc = size = packed = 0
        for own_crc, own_size, own_packed in pieces:
            crc, size, packed = joined_crc(crc, own_crc, own_size), size + own_size, packed + own_packed
        packed += len(END_OF_STREAM)
        where, raw = self._at, name.encode()
        big = max(size, packed) >= _LIMIT
        extra = struct.pack("<HHQQ", 1, 16, size, packed) if big else b""
        sizes = (_LIMIT, _LIMIT) if big else (packed, size)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x0800, 8, 0, 0x21, crc, *sizes, len(raw), len(extra)) + raw + extra)
        for part, (_, _, own_packed) in zip(parts, pieces):
            if isinstance(part, bytes):
                self._put(part)
            else:
                part(self._out)
                self._at += own_packed
        self._put(END_OF_STREAM)
        self._entries.append((raw, crc, packed, size, where))

    def text(self, name: str, text: str) -> None:
        data = text.encode()
        packed = deflated(data)
        self.member(name, [(zlib.crc32(data), len(data), len(packed))], [packed])

    def close(self) -> None:
        start = self._at
        for raw, crc, packed, size, where in self._entries:
            big = max(packed, size, where) >= _LIMIT
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, where) if big else b""
            numbers = (_LIMIT, _LIMIT, len(raw), len(extra), 0, 0, 0, 0, _LIMIT) if big else (packed, size, len(raw), 0, 0, 0, 0, 0, where)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x0800, 8, 0, 0x21, crc, *numbers) + raw + extra)
        n, size = len(self._entries), self._at - start
        if self._at >= _LIMIT or n >= 0xFFFF:
            end = self._at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _LIMIT), min(start, _LIMIT), 0))


def _sheets(files: list[tuple[str, dict]], most: int) -> list[list[tuple[str, int, dict]]]:
    """The blocks (file, place in it, block) of each sheet: as many as its rows hold."""
    out, rows = [[]], 0
    for path, manifest in files:
        at = 0
        for block in manifest["blocks"]:
            if rows + block["rows"] > most and out[-1]:
                out.append([])
                rows = 0
            out[-1].append((path, at, block))
            rows, at = rows + block["rows"], at + block["packed"] + 1  # a line end behind each
    return out


def write(df: DataFrame, path: str, scratch: str, highlighted: set[str] | None = None, name: str = "Sheet1", block_rows: int = BLOCK_ROWS) -> int:
    """df's rows in its order as a workbook at path, in any file system that Spark writes to; rows beyond a sheet go on in
    further ones. The header is frozen and filtered, highlighted columns are yellow. scratch is a new folder that driver
    and executors share, deleted at the end. Texts beyond what a cell holds are cut, with a warning. The number of rows."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    system = lambda p: jvm.fs.Path(p).getFileSystem(conf)
    widths = [width_of(c) for c in df.columns]
    for row in df.limit(SAMPLE_ROWS).collect():
        widths = [max(w, width_of("" if v is None else v)) for w, v in zip(widths, row)]
    packed = df.mapInArrow(lambda batches: _blocks(block_rows, batches), "value binary")
    packed.select(F.col("value").cast("string")).write.text(scratch)  # bytes as they are, a line end behind each row
    source = system(scratch)
    files = []
    for status in sorted(source.listStatus(jvm.fs.Path(scratch)), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().startswith("part-"):
            stream = source.open(status.getPath())
            try:
                stream.seek(status.getLen() - 11)
                length = int(bytes(stream.readNBytes(10)))
                stream.seek(status.getLen() - 11 - length)
                files.append((status.getPath().toString(), json.loads(bytes(stream.readNBytes(length)))))
            finally:
                stream.close()
    if cut := sum(manifest["cut"] for _, manifest in files):
        warnings.warn(f"{cut} texts are longer than the {CELL_CHARS} characters of a cell and were cut: write Parquet or CSV to keep them", stacklevel=2)
    sheets = _sheets(files, SHEET_ROWS - 1)
    names = [name if k == 0 else f"{name[:26]} {k + 1}" for k in range(len(sheets))]

    def copied(file: str, at: int, n: int):  # noqa: ANN202
        def copy(out: object) -> None:
            stream = source.open(jvm.fs.Path(file))
            try:
                stream.seek(at)
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, n)
            finally:
                stream.close()

        return copy

    target = system(path)
    target = target.getRaw() if hasattr(target, "getRaw") and target.getScheme() == "file" else target  # no checksum file beside it
    stream = target.create(jvm.fs.Path(path), True)
    try:
        book = _Archive(stream)
        _parts(book, names)
        head = "".join(cell(c, 1 + (c in (highlighted or set()))) for c in df.columns)
        columns = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(max(w + 2, 8), 60)}" customWidth="1"/>' for k, w in enumerate(widths))
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        top = f"{_XML}<worksheet {_NS}>{pane}<cols>{columns}</cols><sheetData><row>{head}</row>".encode()
        for k, blocks in enumerate(sheets):
            rows = 1 + sum(block["rows"] for _, _, block in blocks)
            foot = f'</sheetData><autoFilter ref="A1:{reference(rows, max(len(df.columns) - 1, 0))}"/></worksheet>'.encode()
            own = [(zlib.crc32(x), len(x), deflated(x)) for x in (top, foot)]
            pieces = [(b["crc"], b["size"], b["packed"]) for _, _, b in blocks]
            ends = [(crc, size, len(data)) for crc, size, data in own]
            book.member(f"xl/worksheets/sheet{k + 1}.xml", [ends[0], *pieces, ends[1]], [own[0][2], *(copied(f, at, b["packed"]) for f, at, b in blocks), own[1][2]])
        book.close()
    finally:
        stream.close()
    source.delete(jvm.fs.Path(scratch), True)
    return sum(b["rows"] for blocks in sheets for _, _, b in blocks)


def rejoined(grids: DataFrame, name: str = "Sheet1") -> DataFrame:
    """(file, row_no, cells): the rows below the headers of workbooks that write has made, as read_grids gives them, with
    numbers that go on through the sheets as if one sheet held all rows. What is known of a sheet is one row."""
    rows = grids.where(F.col("row_no") > 1)
    place = F.when(F.col("sheet") == name, 1).otherwise(F.regexp_extract("sheet", " ([0-9]+)$", 1).try_cast("int"))
    before = Window.partitionBy("file").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "sheet").agg((F.max("row_no") - 1).alias("rows"))
    starts = sizes.select("file", "sheet", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), ["file", "sheet"]).select("file", (F.col("row_no") + F.col("start")).cast("int").alias("row_no"), "cells")


def _parts(book: _Archive, names: list[str]) -> None:
    """The parts of a workbook around its sheets."""
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    of = lambda form: "".join(form.format(k=k + 1, name=escape(n, {'"': "&quot;"})) for k, n in enumerate(names))
    book.text(
        "[Content_Types].xml",
        _XML + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>'
        + of(f'<Override PartName="/xl/worksheets/sheet{{k}}.xml" ContentType="{types}.worksheet+xml"/>') + f'<Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/></Types>',
    )
    book.text("_rels/.rels", f'{_XML}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    sheets = of('<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>')
    book.text("xl/workbook.xml", f'{_XML}<workbook {_NS} xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
    links = of(f'<Relationship Id="rId{{k}}" Type="{rel}/worksheet" Target="worksheets/sheet{{k}}.xml"/>')
    book.text("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{package}">{links}<Relationship Id="rIdStyles" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
    fill = '<fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill>'
    book.text(
        "xl/styles.xml",
        f'{_XML}<styleSheet {_NS}><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>',
    )
