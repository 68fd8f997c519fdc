import random
import warnings
import zipfile
import zlib
from datetime import date
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import functions as F

from sheafwork.plans import catalog_files
from sheafwork.sinks import tables, workbook
from sheafwork.sources import files, xlsx


def read(path):
    with open(path, "rb") as data:
        return {name: list(xlsx.rows(data, part)) for name, part in xlsx.sheets(data)}


def test_checksums_join():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = rnd.randbytes(rnd.randint(0, 300)), rnd.randbytes(rnd.randint(0, 300))
        assert workbook.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    packed = workbook.deflated(b"ab" * 99) + workbook.deflated(b"") + workbook.deflated(b"ab") + workbook.END_OF_STREAM
    assert zlib.decompressobj(-15).decompress(packed) == b"ab" * 100


def test_values_in_order_over_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 41)
    df = spark.range(0, 100, 1, 7).selectExpr("id", "concat('<&\\u0007字', id, '\\n') AS t", "id / 4 AS d", "IF(id % 3 = 0, NULL, id % 2 = 0) AS b")
    path = str(tmp_path / "x.xlsx")
    assert workbook.write(df, path, str(tmp_path / "scratch"), {"t"}, 'a "b" & c', block_rows=9) == 100
    assert zipfile.ZipFile(path).testzip() is None and [p.name for p in tmp_path.iterdir()] == ["x.xlsx"]
    sheets = read(path)
    assert list(sheets)[:2] == ['a "b" & c', 'a "b" & c 2'] and all(len(r) <= 41 for r in sheets.values())
    got = [row for rows in sheets.values() for n, row in rows[1:]]
    assert [r[0][1] for r in got] == [str(k) for k in range(100)] and all(rows[0][1] == [("s", c) for c in df.columns] for rows in sheets.values())
    assert got[6][1:] == [("s", "<&字6\n"), ("n", "1.5")] and got[7][3] == ("b", "False")


def test_three_million_rows(spark, tmp_path):
    df = spark.range(0, 3_000_000, 1, 8).select("id", (F.col("id") % 7).alias("k"))
    assert tables.write_workbook(df, str(tmp_path / "big.xlsx")) == 3_000_000
    grids = files.read_grids(spark, str(tmp_path)).where("row_no > 1")
    found = grids.groupBy("sheet").agg(F.count("*").alias("n"), F.max("row_no").alias("last"), F.sum(F.col("cells")[0]["text"].cast("long")).alias("total"), F.max("error").alias("e")).collect()
    assert sum(r.n for r in found) == 3_000_000 and sum(r.total for r in found) == 3_000_000 * 2_999_999 // 2
    assert len(found) == 3 and max(r["last"] for r in found) <= 1_048_576 and all(r.e is None for r in found)


def test_rows_are_numbered_through_the_sheets(spark, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 101)
    monkeypatch.setattr(workbook, "write", partial(workbook.write, block_rows=40))
    sf = "/root/testdata/sf0.001"
    keys = [str(r.o_orderkey) for r in spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").select("o_orderkey").collect()]
    got = sorted((r.row_no, r.orderkey) for r in catalog_files.QUERIES["workbook_round_trip"](spark, sf).collect())
    assert len(keys) > 1100 and got == list(enumerate(keys, 2))  # more than ten sheets, so that their names don't sort


def test_long_texts_are_told(spark, tmp_path):
    df = spark.createDataFrame([("x" * 40_000, date(2026, 9, 1), Decimal("1.50")), ("y" * 32_767, None, None)], "t string, day date, n decimal(10,2)")
    with pytest.warns(UserWarning, match="1 texts are longer"):
        tables.write_workbook(df, str(tmp_path / "x.xlsx"))
    rows = next(iter(read(tmp_path / "x.xlsx").values()))
    assert rows[1][1][0] == ("s", "x" * 32_767) and rows[1][1][1:] == [("s", "2026-09-01"), ("n", "1.5")]


def test_empty_tables(spark, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert tables.write_workbook(spark.createDataFrame([], "a string, b int"), str(tmp_path / "x.xlsx")) == 0
    assert read(tmp_path / "x.xlsx") == {"Sheet1": [(1, [("s", "a"), ("s", "b")])]}


def test_members_beyond_four_gigabytes_have_wide_sizes(tmp_path):
    class Out:
        def __init__(self):
            self.data = bytearray()

        def write(self, data):
            self.data += data

    out = Out()
    book = workbook._Archive(out)
    packed = workbook.deflated(b"abc")
    book.member("big", [(zlib.crc32(b"abc"), 3, len(packed)), (0, 1 << 33, 0)], [packed, b""])
    book.text("small", "x")
    book.close()
    (tmp_path / "z.zip").write_bytes(out.data)
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert [i.file_size for i in z.infolist()] == [3 + (1 << 33), 1] and z.read("small") == b"x"
