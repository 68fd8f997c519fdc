"""Reading sheets from files: xlsx, xlsm, xls and csv in any store that Spark reads.

Every file becomes the rows of raw grids (see operators.headers); a file that can't be read gives a row with the reason
instead, and so does a sheet that breaks off, behind the rows that it has. No content passes through the driver.

Workbooks are read by a data source of its own, a partition a sheet, whose rows stream past in batches: a sheet's size
is bounded by nothing but its format. It opens files by their path. Where only Spark's file systems reach them, the
executors get a workbook's bytes from Spark instead, a file a row. Csv files are split (see csv_split).
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheafwork.sources import xls, xlsx
from sheafwork.sources.cells import SCHEMA, Row, batches, failure
from sheafwork.sources.csv_split import read_csv

# What is read.
WORKBOOKS = {"xlsx": xlsx, "xlsm": xlsx, "xls": xls}
SUFFIXES = (*WORKBOOKS, "csv")
#: Bytes of a workbook that can be handed to an executor as one value.
MOST_BYTES = 2**31 - 2**20
_HIDDEN = ("~$", ".", "_")


def _glob(*suffixes: str) -> str:
    """A pattern for names with one of the suffixes in either case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"


def _is_wanted(name: str, suffixes: tuple[str, ...]) -> bool:
    return name.rpartition(".")[2].lower() in suffixes and not name.startswith(_HIDDEN)


def _sheets(name: str, data: BinaryIO) -> list[tuple[str, object]]:
    found = WORKBOOKS[name.rpartition(".")[2].lower()].sheets(data)
    if not found:
        raise ValueError("the file has no sheets")
    return found


def _rows(name: str, data: BinaryIO, key: object) -> Iterator[Row]:
    return WORKBOOKS[name.rpartition(".")[2].lower()].rows(data, key)


def _sheet(name: str, opened: Callable[[], BinaryIO], sheets: list[tuple[str, object]], k: int) -> Iterator[pa.RecordBatch]:
    """The rows of a file's k-th sheet; the first one also tells if all are empty."""
    sheet, key = sheets[k]
    filled = False

    def watched(rows: Iterator[Row]) -> Iterator[Row]:
        nonlocal filled
        for number, cells in rows:
            filled = filled or any(cells)
            yield number, cells

    try:
        with opened() as data:
            yield from batches(name, sheet, watched(_rows(name, data, key)))
        if not filled and k == 0 and not any(any(cells) for _, other in sheets[1:] for _, cells in _rows(name, opened(), other)):
            yield failure(name, "the file is empty")
    except Exception as problem:  # noqa: BLE001  whatever is broken in a file is told, and the others are read
        yield failure(name, problem, sheet)


class SheetPartition(InputPartition):
    """A sheet of a file, or the reason why the file can't be read."""

    def __init__(self, path: str, name: str, sheets: list[tuple[str, object]] = (), k: int = 0, problem: str | None = None) -> None:
        self.path, self.name, self.sheets, self.k, self.problem = path, name, list(sheets), k, problem


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self._paths = [Path(p.removeprefix("file://").removeprefix("file:")) for p in paths]

    def _files(self) -> list[Path]:
        out = []
        for path in self._paths:
            if path.is_file():
                out.append(path)
                continue
            with os.scandir(path) as entries:
                out += [Path(x.path) for x in entries if x.is_file()]
        return sorted(p for p in out if _is_wanted(p.name, tuple(WORKBOOKS)))

    def partitions(self) -> list[SheetPartition]:
        """A partition a sheet: of each file only its list of sheets is read."""
        out = []
        for path in self._files():
            try:
                with path.open("rb") as data:
                    sheets = _sheets(path.name, data)
                out += [SheetPartition(str(path), path.name, sheets, k) for k in range(len(sheets))]
            except Exception as problem:  # noqa: BLE001
                out.append(SheetPartition(str(path), path.name, problem=str(problem) or type(problem).__name__))
        return out or [SheetPartition("", "")]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        if partition.problem is not None:
            yield failure(partition.name, partition.problem)
        elif partition.sheets:
            yield from _sheet(partition.name, lambda: open(partition.path, "rb"), partition.sheets, partition.k)


class WorkbookSource(DataSource):
    """spark.read.format("workbooks").load(folder or file): the rows of all sheets, as SCHEMA has them. The option paths
    gives several, as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WorkbookReader:
        return WorkbookReader(json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]])


def _of_content(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from files' bytes."""
    for batch in parts:
        for name, data in zip(*batch.columns):
            name, data = name.as_py(), data.as_buffer()
            try:
                sheets = _sheets(name, io.BytesIO(data))
            except Exception as problem:  # noqa: BLE001
                yield failure(name, problem)
                continue
            for k in range(len(sheets)):
                yield from _sheet(name, lambda data=data: io.BytesIO(data), sheets, k)


Folder = str | list[str]


def _files(spark: SparkSession, folder: Folder, *suffixes: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(*suffixes)).load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.withColumn("file", name).where(~F.col("file").rlike(r"^(~\$|\.)"))


def list_files(spark: SparkSession, folder: Folder, content: bool = False) -> DataFrame:
    """(path, file, modificationTime, length) of the files with a known suffix, hidden and lock files left out, and their
    content if it is asked for."""
    return _files(spark, folder, *SUFFIXES).select("path", "file", "modificationTime", "length", *(["content"] if content else []))


def find_template(spark: SparkSession, folder: str) -> str | None:
    """The first workbook or csv of a folder by name, hidden and lock files left out."""
    found = _files(spark, folder, *SUFFIXES).select("path", "file").orderBy("file", "path").first()
    return found.path if found else None


def _opened_by_path(spark: SparkSession, folder: str) -> str | None:
    """folder as a plain path, if it is in a file system that every process opens by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def read_workbooks(spark: SparkSession, folder: Folder) -> DataFrame:
    """The rows of all sheets of a folder's workbooks, or of one, or of those in a list."""
    local = [_opened_by_path(spark, x) for x in ([folder] if isinstance(folder, str) else folder)]
    if None not in local:
        spark.dataSource.register(WorkbookSource)
        return spark.read.format("workbooks").option("paths", json.dumps(local)).load()
    files = _files(spark, folder, *WORKBOOKS)
    big = files.where(F.col("length") > MOST_BYTES).select("file", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row_no"), F.lit("the file is beyond 2 GB").alias("error"))
    small = files.where(F.col("length") <= MOST_BYTES).select("file", "content").mapInArrow(_of_content, SCHEMA)
    return small.unionByName(big, allowMissingColumns=True)


def read_grids(spark: SparkSession, inbox: Folder) -> DataFrame:
    """The grids of a folder's files with a known suffix, or of one file or a list of them, hidden and lock files left out; a row with
    error for each file that can't be read (sheet null) and each sheet that breaks off."""
    listed = {row["csv"]: row["n"] for row in _files(spark, inbox, *SUFFIXES).groupBy(F.lower("file").endswith(".csv").alias("csv")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = spark.createDataFrame([], SCHEMA)
    if False in listed:
        out = out.unionByName(read_workbooks(spark, inbox))
    if True in listed:
        out = out.unionByName(read_csv(spark, inbox, glob=_glob("csv")).where(~F.col("file").rlike(r"^(~\$|\.)")))
    return out
