"""Rows of csv files of any size, each file read by as many tasks as it has chunks.

Whether a line end in the middle of a file ends a row depends on all quotes before it. So each chunk is first surveyed
under both states it can begin in, outside and inside a quoted value: where it ends, and how many rows end in it. The
true state of a file's first chunk is known, and the surveys, applied one after the other, give that of every other one
and the number of its first row. Then each chunk parses the rows that begin and end in it; the pieces of rows that reach
over a chunk's edge are brought together by row.

Chunks are Spark's own splits at line feeds, with a split size that doesn't depend on how many cores there are, so that
both passes see the same ones. A file is UTF-8 (with or without mark) if all of it is, else GB 18030, else unreadable.
Rows are those of Python's csv module with its usual dialect; a quoted value that is never closed ends with the file.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.sources.cells import ARROW, SCHEMA, Row, batches

#: Bytes of a chunk, and the most chunks whose surveys are held by the driver (about 100 bytes each). Beyond it chunks
#: grow; more files than that have to be read in parts.
CHUNK_BYTES, MOST_CHUNKS = 64 << 20, 200_000
#: Bytes of lines that are parsed at once.
PARSED_BYTES = 1 << 20

MARK = b"\xef\xbb\xbf"


def scan(line: bytes, inside: bool) -> tuple[bool, int]:
    """(whether the line's end is inside a quoted value, rows that end within the line at a lone carriage return)."""
    if b'"' not in line and (inside or b"\r" not in line):
        return inside, 0
    body = line[:-1] if line.endswith(b"\r") else line
    ends, at, size = 0, 0, len(body)
    while True:
        if inside:
            quote = line.find(b'"', at)
            if quote < 0:
                return True, ends
            at = quote + 1
            if line[at : at + 1] == b'"':
                at += 1
                continue
            inside = False
        elif body[at : at + 1] == b'"':
            at, inside = at + 1, True
            continue
        # Outside, a quote that doesn't begin a value is a character like others: on to the next value.
        comma, turn = body.find(b",", at), body.find(b"\r", at)
        if turn >= 0 and (comma < 0 or turn < comma):
            ends, at = ends + 1, turn + 1
        elif comma >= 0:
            at = comma + 1
        else:
            return False, ends
        if at >= size:
            return False, ends


@dataclass(frozen=True)
class Survey:
    """Of a chunk, for each state it may begin in (outside, inside): whether it ends inside, how many rows end in it, and
    whether any line of it ends outside."""

    ends_inside: tuple[bool, bool]
    rows: tuple[int, int]
    closed: tuple[bool, bool]


def survey(lines: Iterable[bytes], before: Survey | None = None) -> Survey:
    """The survey of a chunk's lines, going on from that of its lines before."""
    before = before or Survey((False, True), (0, 0), (False, False))
    state, rows, closed = list(before.ends_inside), list(before.rows), list(before.closed)
    for line in lines:
        for k in (0, 1):
            state[k], ends = scan(line, state[k])
            rows[k] += ends + (not state[k])
            closed[k] |= not state[k]
    return Survey(tuple(state), tuple(rows), tuple(closed))


@dataclass(frozen=True)
class Start:
    """How a chunk begins: inside a quoted value or not, with which row, and in which chunk that row began."""

    inside: bool
    first_row: int
    owner: int


def starts(chunks: list[tuple[int, Survey]]) -> tuple[dict[int, Start], bool]:
    """The beginnings of a file's chunks, given by place and in order, and whether any row reaches over an edge of them
    (the file's end within a quoted value is one)."""
    out, inside, row, owner = {}, False, 1, 0
    for place, found in chunks:
        out[place] = Start(inside, row, owner if inside else place)
        if not inside or found.closed[inside]:
            owner = place
        row, inside = row + found.rows[inside], found.ends_inside[inside]
    return out, inside or any(x.inside for x in out.values())


def _parsed(data: bytes, encoding: str, first: int) -> Iterator[Row]:
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    for k, row in enumerate(csv.reader(io.StringIO(data.decode(encoding), newline=""))):
        yield first + k, [("s", x) if x != "" else None for x in row]


class Chunk:
    """A chunk in its second pass: lines in, whole rows out, and pieces of rows that reach over its edges."""

    def __init__(self, place: int, start: Start, encoding: str) -> None:
        self._place, self._start, self._encoding = place, start, encoding
        self._inside, self._row, self._head = start.inside, start.first_row, start.inside
        self._open: list[bytes] = []
        self._whole: list[bytes] = []
        self._whole_rows = self._size = self._ends = 0
        #: (chunk where the row began, this one, the row's number, text)
        self.pieces: list[tuple[int, int, int, bytes]] = []

    def lines(self, lines: Iterable[bytes]) -> Iterator[Row]:
        for line in lines:
            self._inside, ends = scan(line, self._inside)
            self._open.append(line)
            self._ends += ends
            if self._inside:
                continue
            if self._head:
                self._piece(self._start.owner)
                self._row, self._head = self._row + self._ends + 1, False
            else:
                self._whole += self._open
                self._whole_rows += self._ends + 1
                self._size += sum(map(len, self._open)) + len(self._open)
            self._open, self._ends = [], 0
            if self._size >= PARSED_BYTES:
                yield from self._rows()

    def close(self) -> Iterator[Row]:
        yield from self._rows()
        if self._open:
            self._piece(self._start.owner if self._head else self._place)

    def _rows(self) -> Iterator[Row]:
        if self._whole:
            yield from _parsed(b"\n".join(self._whole) + b"\n", self._encoding, self._row)
            self._row += self._whole_rows
            self._whole, self._whole_rows, self._size = [], 0, 0

    def _piece(self, owner: int) -> None:
        self.pieces.append((owner, self._place, self._row + self._whole_rows, b"\n".join(self._open) + b"\n"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    """(path, place, lines) of the lines of a batch that follow each other in one chunk."""
    paths, places = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    codes = paths.indices.to_numpy()
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (places[1:] != places[:-1])) + 1
    lines = batch.column(0).to_pylist()
    for first, past in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)]):
        if first < past:
            yield paths.dictionary[codes[first]].as_py(), int(places[first]), lines[first:past]


def _without_mark(lines: list[bytes]) -> list[bytes]:
    return [lines[0].removeprefix(MARK), *lines[1:]]


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


_SURVEYS = "path string, place long, ends_out boolean, ends_in boolean, rows_out long, rows_in long, closed_out boolean, closed_in boolean, utf8 boolean, gb boolean"


def _surveys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: tuple[str, int] | None = None
    found, fits = None, {}

    def row() -> pa.RecordBatch:
        values = [*now, *found.ends_inside, *found.rows, *found.closed, fits["utf-8"], fits["gb18030"]]
        names = [x.split()[0] for x in _SURVEYS.split(", ")]
        return pa.record_batch([pa.array([v]) for v in values], names)

    for batch in parts:
        for path, place, lines in _runs(batch):
            if now != (path, place):
                if now:
                    yield row()
                now, found, fits = (path, place), None, {"utf-8": True, "gb18030": True}
                lines = lines if place else _without_mark(lines)
            data = b"\n".join(lines)
            if not data.isascii():
                fits = {code: ok and _decodes(data, code) for code, ok in fits.items()}
            found = survey(lines, found)
    if now:
        yield row()


def _plan(rows: Iterable) -> dict[str, tuple[str | None, dict[int, Start], bool]]:
    """Of each file, its encoding (None if it has none of the known ones), how its chunks begin, and whether rows reach
    over their edges."""
    by_path: dict[str, list] = {}
    for r in rows:
        by_path.setdefault(r["path"], []).append(r)
    out = {}
    for path, found in by_path.items():
        found.sort(key=lambda r: r["place"])
        chunks = [(r["place"], Survey((r["ends_out"], r["ends_in"]), (r["rows_out"], r["rows_in"]), (r["closed_out"], r["closed_in"]))) for r in found]
        encoding = "utf-8" if all(r["utf8"] for r in found) else "gb18030" if all(r["gb"] for r in found) else None
        out[path] = (encoding, *starts(chunks))
    return out


def file_name(path: str) -> str:
    """The last part of a path as Spark tells it."""
    return unquote(path.rpartition("/")[2])


def read_csv(spark: SparkSession, folder: str | list[str], chunk_bytes: int = CHUNK_BYTES, glob: str = "*") -> DataFrame:
    """(file, sheet, row_no, cells, error) of the csv files of a folder or list of paths; a row with the reason for one
    that can't be read or is empty."""
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).agg(F.count("path").alias("n"), F.sum("length").alias("bytes")).first()
    if sizes["n"] > MOST_CHUNKS:
        raise ValueError(f"{sizes['n']} files are more than {MOST_CHUNKS}: read the folder in parts")
    chunk_bytes = max(chunk_bytes, (sizes["bytes"] or 0) // MOST_CHUNKS + 1)
    own = spark.newSession()
    # Splits depend on these settings alone: neither on cores nor on how many executors there are at the moment.
    for key, value in (("maxPartitionBytes", chunk_bytes), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{key}", str(value))
    text = own.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(folder)
    lines = text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("place"))
    plan = _plan(lines.mapInArrow(_surveys, _SURVEYS).collect())  # a row a chunk
    shared = spark.sparkContext.broadcast(plan)

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk | None, Iterator[Row]]]:
        """Rows as they become whole, with the file they are from; a closed chunk behind its last ones."""
        now, chunk = None, None
        for batch in parts:
            for path, place, lines in _runs(batch):
                if now != (path, place):
                    if chunk:
                        yield now[0], chunk, chunk.close()
                    encoding, begins, _ = shared.value[path]
                    now, chunk = (path, place), Chunk(place, begins[place], encoding) if encoding else None
                    lines = lines if place else _without_mark(lines)
                if chunk:
                    yield path, None, chunk.lines(lines)
        if chunk:
            yield now[0], chunk, chunk.close()

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, _, rows in chunks(parts):
            yield from batches(file_name(path), "", rows)

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, chunk, rows in chunks(parts):
            for _ in rows:
                pass
            if chunk and chunk.pieces:
                columns = [[path] * len(chunk.pieces), *map(list, zip(*chunk.pieces))]
                yield pa.record_batch([pa.array(c) for c in columns], ["path", "owner", "place", "row_no", "text"])

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        path, table = key[0].as_py(), table.sort_by("place")
        rows = _parsed(b"".join(table.column("text").to_pylist()), shared.value[path][0], table.column("row_no")[0].as_py())
        return pa.Table.from_batches(batches(file_name(path), "", rows), ARROW)

    # An empty table first: the result belongs to the caller's session, not to the one that sets the splits.
    broken = [(file_name(path), None, None, None, "unknown text encoding: save the file as xlsx") for path, (encoding, *_) in plan.items() if encoding is None]
    place = lambda path: path.partition(":")[2].lstrip("/")  # noqa: E731  file names as Spark lists and as it tells them
    read = set(map(place, plan))
    broken += [(file_name(path), None, None, None, "the file is empty") for path in text.inputFiles() if place(path) not in read]
    out = spark.createDataFrame(broken, SCHEMA).unionByName(lines.mapInArrow(whole, SCHEMA))
    if any(reaching for _, _, reaching in plan.values()):
        over = lines.mapInArrow(pieces, "path string, owner long, place long, row_no long, text binary")
        out = out.unionByName(over.groupBy("path", "owner").applyInArrow(joined, SCHEMA))
    return out
