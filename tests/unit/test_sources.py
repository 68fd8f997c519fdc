import csv
import io
import random
import struct
import tracemalloc
import zipfile

import pytest

from oldsheets import book, cell, compound, record, shared, text
from sheafwork.sources import cells, csv_split, files, xls, xlsx
from sheets import NS, REL, workbook


def old_rows(data, k=0):
    book_ = xls.Workbook(data)
    return book_.sheets[k][0], list(book_.rows(book_.sheets[k][1]))


def plain(rows):
    return [(n, [c and c[1] for c in row]) for n, row in rows]


def sample_stream(**more):
    strings = ["单位", "姓名", "é à", "x" * 300, ""]
    sheet = b"".join(cell(0xFD, 0, c, struct.pack("<I", k)) for c, k in enumerate((0, 1, 2, 3)))
    sheet += cell(0x203, 1, 0, struct.pack("<d", 46266.0), 1) + cell(0x203, 1, 1, struct.pack("<d", 2.5))
    sheet += cell(0x27E, 1, 2, struct.pack("<I", (7 << 2 | 2) & 0xFFFFFFFF)) + cell(0x27E, 1, 3, struct.pack("<I", ((-1250) << 2 | 3) & 0xFFFFFFFF))
    sheet += record(0xBD, struct.pack("<HH", 2, 1) + b"".join(struct.pack("<HI", 0, k << 2 | 2) for k in (5, 6)) + struct.pack("<H", 2))
    sheet += cell(0x205, 3, 0, b"\x01\x00") + cell(0x205, 3, 1, b"\x2a\x01") + cell(0x204, 3, 2, text("own 字"))
    sheet += cell(0x06, 4, 0, struct.pack("<d", 12.0) + b"\0" * 8) + cell(0x06, 4, 1, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, text("said"))
    sheet += cell(0x06, 4, 2, b"\x01\0\x01\0\0\0\xff\xff" + b"\0" * 8) + cell(0x06, 4, 3, b"\x03\0\0\0\0\0\xff\xff" + b"\0" * 8) + record(0x201, b"\0" * 6)
    sheet += record(0xE5, struct.pack("<H4H4H", 2, 3, 4, 2, 3, 7, 8, 0, 0))
    return book({"数据": sheet, "Second": cell(0x203, 2, 1, struct.pack("<d", 1e20))}, (shared(strings),), **more)


WANT = [
    (1, ["单位", "姓名", "é à", "x" * 300]), (2, ["2026-09-01", "2.5", "7", "-12.5"]), (3, [None, "5", "6"]),
    (4, ["True", "#N/A", "own 字", "own 字"]), (5, ["12", "said", "own 字", "own 字"]),
]


@pytest.mark.parametrize("shift, mini", [(9, True), (9, False), (12, True), (12, False)])
def test_old_workbook(shift, mini):
    data = compound(sample_stream(), shift=shift, mini=mini)
    name, rows = old_rows(data)
    assert name == "数据" and plain(rows) == WANT
    assert [c and c[0] for c in rows[1][1]] == ["d", "n", "n", "n"] and rows[3][1][0] == ("b", "True")
    assert plain(old_rows(data, 1)[1]) == [(1, []), (2, []), (3, [None, "1e+20"])]


@pytest.mark.parametrize("cut", range(9, 60))
def test_shared_strings_break_anywhere(cut):
    """A continue record begins with new flags within characters, and without them within anything else."""
    plain_part, wide_part = "abcdefgh", "汉字汉字"
    whole = struct.pack("<II", 3, 3) + text(plain_part) + text(wide_part)
    rich = struct.pack("<HBHI", 4, 0x0C, 1, 5) + b"rich" + b"\1\2\3\4" + b"ext__"
    whole += rich
    marks = []  # places within characters: (first, past, flags, width)
    at = 8
    for value in (plain_part, wide_part):
        wide = ord(value[0]) > 255
        marks.append((at + 3, at + 3 + len(value) * (1 + wide), int(wide), 1 + wide))
        at = marks[-1][1]
    marks.append((at + 9, at + 13, 0x0C & 1, 1))
    if cut >= len(whole):
        return
    inside = next(((first, flags, width) for first, past, flags, width in marks if first <= cut < past), None)
    if inside and (cut - inside[0]) % inside[2]:
        return  # a character is never split
    second = (bytes([inside[1]]) if inside else b"") + whole[cut:]
    stream = book({"a": b"".join(cell(0xFD, 0, k, struct.pack("<I", k)) for k in range(3))}, (whole[:cut], second))
    assert plain(old_rows(compound(stream))[1]) == [(1, [plain_part, wide_part, "rich"])]


def test_width_of_a_shared_string_changes_at_a_break():
    stream = book({"a": cell(0xFD, 0, 0, struct.pack("<I", 0))}, (struct.pack("<IIHB", 1, 1, 4, 0) + b"ab", b"\x01" + "汉字".encode("utf-16-le")))
    assert plain(old_rows(compound(stream))[1]) == [(1, ["ab汉字"])]


def test_long_stream_and_dates_of_1904():
    sheet = b"".join(cell(0x203, r, c, struct.pack("<d", r * 10 + c)) for r in range(900) for c in range(10))
    data = compound(book({"big": sheet, "d": cell(0x203, 0, 0, struct.pack("<d", 1.5), 1)}, more=record(0x22, b"\1\0")))
    assert plain(old_rows(data)[1])[899] == (900, [str(8990 + c) for c in range(10)])
    assert old_rows(data, 1)[1] == [(1, [("d", "1904-01-02")])]


def test_older_workbook_with_a_codepage():
    head = record(0x809, struct.pack("<HH", 0x500, 5) + b"\0" * 4) + record(0x42, struct.pack("<H", 936))
    name = "表".encode("gbk")
    body = record(0x809, struct.pack("<HH", 0x500, 0x10) + b"\0" * 4) + cell(0x204, 0, 0, struct.pack("<H", 4) + "单位".encode("gbk")) + record(0x0A)
    at = len(head) + 4 + 7 + len(name) + 4
    stream = head + record(0x85, struct.pack("<IBBB", at, 0, 0, len(name)) + name) + record(0x0A) + body
    assert old_rows(compound(stream, "Book")) == ("表", [(1, [("s", "单位")])])


def test_broken_old_files_are_told(spark, tmp_path):
    good = compound(sample_stream(), mini=False)
    directory = struct.unpack_from("<I", good, 0x30)[0]
    table = struct.unpack_from("<I", good, 0x4C)[0]
    far, circle = bytearray(good), bytearray(good)
    struct.pack_into("<I", far, 512 * (table + 1), 9999)
    struct.pack_into("<I", circle, 512 * (table + 1), 0)
    cases = {
        "far.xls": (bytes(far), "leads to sector 9999"), "circle.xls": (bytes(circle), "in a circle"), "none.xls": (b"text", "no compound file"),
        "short.xls": (good[: 512 * (directory + 1)], "which is not there"), "other.xls": (compound(b"x" * 5000, "WordDocument"), "no workbook"),
        "locked.xls": (compound(sample_stream(more=record(0x2F, b"\0" * 6))), "encrypted"), "string.xls": (compound(book({"a": cell(0xFD, 0, 0, struct.pack("<I", 3))})), "no shared string 3"),
        "end.xls": (compound(book({"a": b""})[:-4]), "no end"), "empty.xls": (compound(book({"a": b"", "b": b""})), "the file is empty"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "good.xls").write_bytes(good)
    rows = files.read_grids(spark, str(tmp_path)).collect()
    told = {r["file"]: r["error"] for r in rows if r["error"]}
    assert set(told) == set(cases) and all(cases[name][1] in error for name, error in told.items())
    assert [(r["row_no"], [c and c["text"] for c in r["cells"]]) for r in rows if r["sheet"] == "数据"] == WANT


def test_merged_ranges_are_intervals():
    rows = [(1, [("s", "a")]), (4, [None, ("s", "b"), ("s", "hidden")]), (5, [("s", "c")])]
    got = list(cells.with_merged(iter(rows), [(0, 2, 0, 1), (3, 9, 1, 2), (4, 4, 5, 6), (20, 30, 0, 0)]))
    assert plain(got) == [(1, ["a", "a"]), (2, ["a", "a"]), (3, ["a", "a"]), (4, [None, "b", "b"]), (5, ["c", "b", "b"])]
    with pytest.raises(ValueError):
        list(cells.with_merged([(2, []), (2, [])], []))


def big_workbook(path, rows, columns, extra=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets><sheet name="big" sheetId="1" r:id="r0"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r0" Target="worksheets/s0.xml" Type="t/worksheet"/></Relationships>')
        with z.open("xl/worksheets/s0.xml", "w") as out:
            out.write(f"<worksheet {NS}><sheetData>".encode())
            for r in range(1, rows + 1):
                out.write(f'<row r="{r}">{"".join(f"<c><v>{r * c}</v></c>" for c in range(columns))}</row>'.encode())
            out.write(f"</sheetData>{extra}</worksheet>".encode())


def test_large_sheets_arrive_whole(spark, tmp_path):
    big_workbook(tmp_path / "long.xlsx", 200_000, 3)
    big_workbook(tmp_path / "wide.xlsx", 400, 300, '<mergeCells><mergeCell ref="KN1:KO2"/></mergeCells>')
    got = files.read_grids(spark, str(tmp_path))
    rows = got.selectExpr("file", "row_no", "size(cells) n", "element_at(cells, -1).text last", "error").groupBy("file").agg(
        {"row_no": "max", "*": "count", "n": "max", "error": "max", "last": "max"}
    )
    found = {r["file"]: (r["max(row_no)"], r["count(1)"], r["max(n)"], r["max(error)"]) for r in rows.collect()}
    assert found == {"long.xlsx": (200_000, 200_000, 3, None), "wide.xlsx": (400, 400, 301, None)}
    assert [c["text"] for c in got.where("file = 'wide.xlsx' AND row_no = 2").first()["cells"]][299:] == ["299", "299"]


def test_a_sheet_streams_in_bounded_memory(tmp_path):
    big_workbook(tmp_path / "x.xlsx", 60_000, 20)
    with (tmp_path / "x.xlsx").open("rb") as data:
        tracemalloc.start()
        n = sum(1 for _ in xlsx.rows(data, xlsx.sheets(data)[0][1]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 60_000 and peak < 4 << 20


def test_parts_of_a_workbook(tmp_path):
    """Prefixed names, runs and readings, inline strings, errors, own date formats, 1904, a chart sheet, absolute targets."""
    with zipfile.ZipFile(tmp_path / "x.xlsm", "w") as z:
        z.writestr("xl/workbook.xml", f'<x:workbook xmlns:x="m" xmlns:r="{REL}"><x:workbookPr date1904="1"/><x:sheets><x:sheet name="c" r:id="c"/><x:sheet name="s" r:id="s"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="y"><R Id="s" Target="/xl/own/s.xml" Type="a/worksheet"/><R Id="c" Target="c.xml" Type="a/chartsheet"/></R>')
        z.writestr("xl/c.xml", "<chartsheet/>")
        z.writestr("xl/styles.xml", '<s xmlns="m"><numFmts><numFmt numFmtId="200" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="201" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/><xf numFmtId="201"/></cellXfs></s>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><r><t>a</t></r><r><t xml:space="preserve"> b</t></r><rPh><t>zz</t></rPh></si><si><t/></si></sst>')
        z.writestr("xl/own/s.xml", '<x:worksheet xmlns:x="m"><x:sheetData><x:row><x:c t="s"><x:v>0</x:v></x:c><x:c t="inlineStr"><x:is><x:r><x:t>in</x:t></x:r><x:t>line</x:t></x:is></x:c></x:row><x:row r="3"><x:c r="C3" s="1"><x:f>1+1</x:f><x:v>1</x:v></x:c><x:c s="2"><x:v>0.5</x:v></x:c><x:c t="e"><x:v>#N/A</x:v></x:c><x:c t="b"><x:v>0</x:v></x:c><x:c t="d"><x:v>2026-09-01T00:00:00</x:v></x:c><x:c><x:v>12345678901234567890</x:v></x:c></x:row></x:sheetData><x:mergeCells><x:mergeCell ref="A1:$A$2"/></x:mergeCells></x:worksheet>')
    with (tmp_path / "x.xlsm").open("rb") as data:
        assert [n for n, _ in xlsx.sheets(data)] == ["s"]
        rows = list(xlsx.rows(data, "xl/own/s.xml"))
    assert rows[0] == (1, [("s", "a b"), ("s", "inline")]) and rows[1] == (2, [("s", "a b")])
    assert rows[2] == (3, [None, None, ("d", "1904-01-02"), ("n", "0.5"), ("s", "#N/A"), ("b", "False"), ("d", "2026-09-01"), ("n", "12345678901234567890")])


def test_sheet_that_breaks_off_keeps_its_rows(spark, tmp_path):
    big_workbook(tmp_path / "x.xlsx", 5, 2, "<open>")
    rows = files.read_grids(spark, str(tmp_path)).collect()
    assert [(r["row_no"], r["sheet"]) for r in rows if not r["error"]] == [(k, "big") for k in range(1, 6)]
    assert [(r["file"], r["sheet"]) for r in rows if r["error"]] == [("x.xlsx", "big")]


def test_bytes_from_spark_give_the_same(spark, tmp_path, monkeypatch):
    workbook(tmp_path / "a.xlsx", {"one": ([["a", 1], [None, (46266, "d")]], ["A1:A2"]), "two": ([["x"]], [])})
    (tmp_path / "b.XLS").write_bytes(compound(sample_stream()))
    (tmp_path / "c.xlsm").write_bytes(b"no")
    own = sorted(map(str, files.read_grids(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(files, "_opened_by_path", lambda spark, folder: None)
    assert sorted(map(str, files.read_grids(spark, str(tmp_path)).collect())) == own and len(own) > 8
    assert files.read_workbooks(spark, str(tmp_path / "a.xlsx")).count() == 3


# Csv files in chunks.

PIECES = ['"', '""', ",", "\n", "\r\n", "\r", "a", "字", " ", 'b"c', '"x\ny"', '"p""q"', ""]


def in_chunks(data, edges):
    """The rows of data, cut at line feeds behind the edges, by the same steps as a job's."""
    lines = data.removeprefix(csv_split.MARK).split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    chunks, at = [], 0
    for line in lines:
        place = max((e for e in edges if e <= at), default=0)
        if not chunks or chunks[-1][0] != place:
            chunks.append((place, []))
        chunks[-1][1].append(line)
        at += len(line) + 1
    begins, _ = csv_split.starts([(place, csv_split.survey(own)) for place, own in chunks])
    out, pieces = [], []
    for place, own in chunks:
        chunk = csv_split.Chunk(place, begins[place], "utf-8")
        out += [*chunk.lines(own[: len(own) // 2]), *chunk.lines(own[len(own) // 2 :]), *chunk.close()]
        pieces += chunk.pieces
    for owner in {p[0] for p in pieces}:
        own = sorted(p for p in pieces if p[0] == owner)
        out += csv_split._parsed(b"".join(p[3] for p in own), "utf-8", own[0][2])
    return [(n, [c[1] if c else "" for c in row]) for n, row in sorted(out, key=lambda r: r[0])]


def by_reader(text_):
    return [(k, row) for k, row in enumerate(csv.reader(io.StringIO(text_, newline="")), 1)]


def test_chunks_equal_the_reader_on_random_files():
    rnd = random.Random(4)
    for _ in range(6000):
        value = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 30))) + "\n"
        data = value.encode()
        edges = sorted(rnd.sample(range(len(data)), min(len(data), rnd.randint(0, 6))))
        assert in_chunks(data, edges) == by_reader(value), (value, edges)


def test_every_chunk_size(spark, tmp_path):
    rnd = random.Random(9)
    rows = [["id", "text", "n"]] + [[str(k), rnd.choice(["plain", 'say "hi"', "two\nlines", "\r\n, ,", "字" * 9, ""]), "x" * rnd.randint(0, 30)] for k in range(60)]
    for name, code in (("u.csv", "utf-8-sig"), ("g.CSV", "gb18030")):
        with (tmp_path / name).open("w", newline="", encoding=code) as out:
            csv.writer(out).writerows(rows)
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xff\xff,c\n")
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "open.csv").write_bytes(b'a,b\nc,"never closed\nx,y\n')
    want = {"u.csv": rows, "g.CSV": rows, "open.csv": [["a", "b"], ["c", "never closed\nx,y\n"]]}
    for size in (37, 500, 1 << 20):
        got = csv_split.read_csv(spark, str(tmp_path), size, "*.[cC][sS][vV]")
        found = {}
        for r in sorted(got.where("error IS NULL").collect(), key=lambda r: r["row_no"]):
            found.setdefault(r["file"], []).append((r["row_no"], [c["text"] if c else "" for c in r["cells"]]))
        assert found == {name: list(enumerate(own, 1)) for name, own in want.items()}
    told = {r["file"]: r["error"] for r in files.read_grids(spark, str(tmp_path)).where("error IS NOT NULL").collect()}
    assert told == {"bad.csv": "unknown text encoding: save the file as xlsx", "none.csv": "the file is empty"}
