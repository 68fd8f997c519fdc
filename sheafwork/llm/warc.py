"""WARC archives with a two-level capture index.

Each page is a record in a gzip member of its own, so that a record can be read by its range. Of pages with equal
payloads (of min_payload bytes or more) the one with the smallest page_id is a response; the others revisit it and hold
no payload, but its digest and length. Captures are sorted by reversed-host key and page_id into compressed blocks of
lines; index files hold a range of keys each, and beside each lies its part of a sparse directory: each block's first
key and range. Looking up goes the same way: keys are sorted, the index file of a key is found by binary search among
the files' first keys, the block by binary search in that file's part of the directory, the lines by binary search in
the block, which is read by its range, and so are the records. A task holds one part and one block at a time; only the
first key of each index file goes through the driver, one a some hundred thousand captures.

Archives, blocks and directory lie in one folder that all executors share, given by URI; files carry the id of the task
attempt that wrote them and only files of attempts that succeeded are in the index, so lost executors and repeated tasks
do no harm. Bytes are read and written through pyarrow's file systems. Tasks are as many as bytes or captures call for.

A null html counts as an empty payload. A row with a null page_id is a response of its own and no page revisits it; rows
that repeat the smallest page_id are all responses. Null URLs are archived under an empty one. Payloads are archived
whole, whatever their length. Other columns aren't archived. An empty table gives no files and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import scratch

#: Bytes after which a task begins the next archive.
ARCHIVE_BYTES = 256 << 20
#: Lines in a block of the capture index, and bytes after which an index file ends.
BLOCK_LINES = 1000
INDEX_BYTES = 8 << 20
#: Bytes of archives, and captures or keys, for one task.
READ_BYTES = 128 << 20
TASK_KEYS = 500_000
#: Groups of equal payloads up to which they go to every executor; beyond it, those of so many pages do.
BROADCAST_ROWS = 500_000
HOT_PAGES = 100_000

CAPTURE = "surt string, page_id long, file string, offset long, length long"
DIRECTORY = "first_surt string, first_page_id long, file string, offset long, length long, n_lines long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary, payload_bytes long"
BLOCK = "file string, offset long, length long, keys array<struct<surt:string,page_id:bigint,exact:boolean>>"

Key = tuple[str, int, int]  # reversed-host key, whether there is a page_id, page_id


@dataclass(frozen=True)
class Archive:
    """Where the files are, and the sparse block directory as a table, too."""

    folder: str
    directory: DataFrame


def surt(url: Column) -> Column:
    """The key of a URL: its host's labels in reverse order, then path and query; other strings are their own key."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, pattern, 2))
    return F.coalesce(F.translate(F.when(host != "", key).otherwise(url), "\t\n\r", "   "), F.lit(""))


def _open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri) else f"file://{uri}")


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> dict:
    """The parts of a record: its headers, HTTP headers and payload. Raises ValueError if lengths or digest are wrong."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if headers["warc-type"] == "response" and _base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("payload of another digest than the record says")
    return {
        "page_id": _page_of(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri", ""),
        "record_type": headers["warc-type"],
        "refers_to": _page_of(headers.get("warc-refers-to")),
        "payload_digest": digest,
        "payload": payload if headers["warc-type"] == "response" else None,
        "payload_bytes": len(payload) if headers["warc-type"] == "response" else int(length[1]) if length else None,
    }


class _Files:
    """Files that one task attempt writes, each begun when the last has grown to a size."""

    def __init__(self, folder: str, kind: str, most: int) -> None:
        from pyspark import TaskContext

        self.is_full = False

        self._fs, self._path = _open_folder(folder)
        self._fs.create_dir(self._path)
        self._kind, self._most, self._attempt, self._count = kind, most, TaskContext.get().taskAttemptId(), 0
        self._out, self.name, self._at = None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Where the data is: file name, offset, length."""
        if self._out is None or self._at >= self._most:
            self.close()
            self.name = f"{self._kind}-{self._attempt:010d}-{self._count:05d}.gz"
            self._out, self._at, self._count = self._fs.open_output_stream(f"{self._path}/{self.name}", compression=None), 0, self._count + 1
        self._out.write(data)
        at, self._at = self._at, self._at + len(data)
        self.is_full = self._at >= self._most
        return self.name, at, len(data)

    def put_beside(self, ending: str, data: bytes) -> None:
        """A file of its own, named after the one that is being written."""
        with self._fs.open_output_stream(f"{self._path}/{self.name}{ending}", compression=None) as out:
            out.write(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None


def _with_revisits(pages: DataFrame, min_payload: int) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    size = F.octet_length("payload")
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    groups = (
        keyed.where((size >= min_payload) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
        .where("first_id < last_id")
        .select("digest", "first_id", "n")
    )
    groups = scratch.stored(groups, "payload-groups")
    if groups.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(groups), "digest", "left")
    else:  # payloads that very many pages share are few, and would meet in one task
        hot = F.broadcast(groups.where(F.col("n") > HOT_PAGES))
        rest = keyed.join(hot, "digest", "left_anti").join(groups.where(F.col("n") <= HOT_PAGES), "digest", "left")
        joined = keyed.join(hot, "digest").unionByName(rest)
    refers = F.when((F.col("first_id") < F.col("page_id")) & (size >= min_payload), F.col("first_id"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _tasks(df: DataFrame, amount: int | None, each: int) -> int:
    """How many tasks for an amount, if one takes so much of it; at least as many as there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(amount or 0) // each))


def write(pages: DataFrame, folder: str | None = None, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archive pages (page_id, url, html) under folder (by default a new one in the shared folder) with their index."""
    spark = pages.sparkSession
    folder = folder or scratch.new_path(spark, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, "archive.warc", ARCHIVE_BYTES)
        try:
            for batch in batches:
                keys, ids, urls, payloads, refers = batch.columns
                found = [
                    files.add(record_bytes(p.as_py(), u.as_py(), x.as_py(), r.as_py(), date))
                    for p, u, x, r in zip(ids, urls, payloads, refers)
                ]
                names, offsets, lengths = ([f[k] for f in found] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [keys, ids, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["surt", "page_id", "file", "offset", "length"],
                )
        finally:
            files.close()

    rows = _with_revisits(pages, min_payload).select(surt(F.col("url")).alias("surt"), "page_id", "url", "payload", "refers_to")
    captures = scratch.stored(rows.mapInArrow(put, CAPTURE), "captures")

    def put_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, "index.cdx", INDEX_BYTES)
        waiting: list[dict] = []
        part: list[tuple] = []  # of the directory: the file's blocks
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in DIRECTORY.split(", ")]

        def line(*values: object) -> str:
            return "\t".join("" if v is None else str(v) for v in values) + "\n"

        def block() -> None:
            lines = "".join(line(r["surt"], r["page_id"], r["file"], r["offset"], r["length"]) for r in waiting)
            part.append((waiting[0]["surt"], waiting[0]["page_id"], *files.add(zlib.compress(lines.encode())), len(waiting)))
            waiting.clear()

        def finished() -> pa.RecordBatch:
            files.put_beside(".directory", zlib.compress("".join(line(e[0], e[1], e[3], e[4]) for e in part).encode()))
            out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in part], t) for k, t in enumerate(kinds)], names)
            part.clear()
            return out

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    waiting.append(row)
                    if len(waiting) == BLOCK_LINES:
                        block()
                        if files.is_full:
                            yield finished()
            if waiting:
                block()
            if part:
                yield finished()
        finally:
            files.close()

    n = _tasks(captures, captures.count(), TASK_KEYS)
    ordered = captures.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return Archive(folder, scratch.stored(ordered.mapInArrow(put_blocks, DIRECTORY), "directory"))


def _key(surt: str, page_id: int | None) -> Key:
    return surt, page_id is not None, page_id or 0


def _lines(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode().split("\n")[:-1]]


class _Reader:
    """Reads the ranges of an archive's files; the file read last stays open."""

    def __init__(self, folder: str) -> None:
        self._files, self._path = _open_folder(folder)
        self._name, self._source = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            self.close()
            self._name, self._source = name, self._files.open_input_file(f"{self._path}/{name}")
        self._source.seek(offset)
        return self._source.read(length)

    def whole(self, name: str) -> bytes:
        with self._files.open_input_file(f"{self._path}/{name}") as source:
            return source.read()

    def close(self) -> None:
        if self._source is not None:
            self._source.close()
            self._source = None


def captures_of(archive: Archive, blocks: DataFrame | None = None) -> DataFrame:
    """The capture lines of blocks (all of the directory by default), each block by one range read. If blocks have keys,
    only the lines of those: of a key without page_id, all lines of its surt."""
    folder, some = archive.folder, blocks is not None and "keys" in blocks.columns

    def spans(lines: list[list[str]], keys: list[dict]) -> Iterator[list[str]]:
        own = [_key(x[0], int(x[1]) if x[1] else None) for x in lines]
        for key in keys:
            surt, page_id = key["surt"], key["page_id"]
            low, high = (_key(surt, page_id),) * 2 if key["exact"] else ((surt, 0, 0), (surt, 2, 0))
            yield from lines[bisect_left(own, low) : bisect_right(own, high)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Reader(folder)
        try:
            for batch in batches:
                for entry in batch.to_pylist():
                    lines = _lines(source.read(entry["file"], entry["offset"], entry["length"]))
                    keys, ids, names, offsets, lengths = zip(*found) if (found := [*spans(lines, entry["keys"])] if some else lines) else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.string()),
                            pa.array([int(x) if x else None for x in ids], pa.int64()),
                            pa.array(names, pa.string()),
                            pa.array([int(x) for x in offsets], pa.int64()),
                            pa.array([int(x) for x in lengths], pa.int64()),
                        ],
                        ["surt", "page_id", "file", "offset", "length"],
                    )
        finally:
            source.close()

    found = archive.directory if blocks is None else blocks
    n = _tasks(found, found.count(), max(1, TASK_KEYS // BLOCK_LINES)) if blocks is None else None
    found = found.select("file", "offset", "length", *(["keys"] if some else []))
    return (found.repartition(n, "file", "offset") if n else found).mapInArrow(read, CAPTURE)


def records_at(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of captures, read by range in the order of the archives."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Reader(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        names = [f.split()[0] for f in RECORD.split(", ")]
        try:
            for batch in batches:
                for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                    found = [parse_record(source.read(row["file"], row["offset"], row["length"])) for row in part.to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds)], names)
        finally:
            source.close()

    captures = scratch.stored(captures.select("file", "offset", "length"), "captures-to-read")
    n = _tasks(captures, captures.agg(F.sum("length")).first()[0], READ_BYTES)
    return captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def read(archive: Archive) -> DataFrame:
    """Every record of an archive."""
    return records_at(archive, captures_of(archive))


def blocks_of(archive: Archive, keys: DataFrame) -> DataFrame:
    """(file, offset, length, keys) of the blocks that may hold keys (surt, page_id, exact; each once), by binary search
    among the index files' first keys and then in a file's part of the directory."""
    first = archive.directory.groupBy("file").agg(F.min(F.struct("first_surt", "first_page_id")).alias("k")).collect()  # a row an index file
    fences = sorted((_key(r.k.first_surt, r.k.first_page_id), r.file) for r in first)
    firsts, names, folder = [f[0] for f in fences], [f[1] for f in fences], archive.folder

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Reader(folder)

        @lru_cache(maxsize=2)
        def part(name: str) -> tuple[list[Key], list[tuple[int, int]]]:
            rows = _lines(source.whole(f"{name}.directory"))
            return [_key(r[0], int(r[1]) if r[1] else None) for r in rows], [(int(r[2]), int(r[3])) for r in rows]

        for batch in batches:
            found: dict[tuple, list[dict]] = {}
            for key in batch.to_pylist():
                surt, page_id = key["surt"], key["page_id"]
                low, high = (_key(surt, page_id),) * 2 if key["exact"] else ((surt, 0, 0), (surt, 2, 0))
                # A key's captures may begin in the file, or block, before the first one that begins with it.
                for name in names[max(0, bisect_left(firsts, low) - 1) : bisect_right(firsts, high)]:
                    own, ranges = part(name)
                    for at in ranges[max(0, bisect_left(own, low) - 1) : bisect_right(own, high)]:
                        found.setdefault((name, *at), []).append(key)
            rows = [{"file": f, "offset": o, "length": n, "keys": k} for (f, o, n), k in found.items()]
            kind = pa.struct([("surt", pa.string()), ("page_id", pa.int64()), ("exact", pa.bool_())])
            schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(kind))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    keys = scratch.stored(keys.select("surt", "page_id", "exact").distinct(), "keys")
    n = _tasks(keys, keys.count(), TASK_KEYS)
    ordered = keys.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    blocks = scratch.stored(ordered.mapInArrow(search, BLOCK), "blocks-to-read")
    return blocks.repartition(_tasks(blocks, blocks.count(), max(1, TASK_KEYS // BLOCK_LINES)), "file", "offset")


def lookup(archive: Archive, urls: DataFrame, url: str = "url", page_id: str | None = None) -> DataFrame:
    """The captures of the URLs in a column; with the name of a second column, only those of a URL and page_id each."""
    key = surt(F.col(url)).alias("surt")
    own = F.lit(None) if page_id is None else F.col(page_id)
    keys = urls.select(key, own.cast("long").alias("page_id"), F.lit(page_id is not None).alias("exact"))
    return captures_of(archive, blocks_of(archive, keys))


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records; a revisit has the length and digest
    of the payload that it refers to, which its own headers tell."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
