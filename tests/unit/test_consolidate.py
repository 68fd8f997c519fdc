from datetime import date

import pytest

from sheafwork.functions import names as n
from sheafwork.operators import align, headers
from sheafwork.plans.consolidate import Engine, Settings
from sheafwork.sinks import tables
from sheafwork.sources.files import read_grids
from sheets import messy_inbox, workbook

TEMPLATE = ["单位", "姓名", "职称", "课程数", "学生数", "填报日期"]


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inbox")
    messy_inbox(folder)
    return folder


@pytest.fixture(scope="module")
def result(spark, inbox):
    return Engine(spark, Settings(this_year=2026)).consolidate(str(inbox), TEMPLATE)


def test_headers_are_recovered(spark, inbox):
    grids = read_grids(spark, str(inbox))
    assert grids.where("error IS NOT NULL").count() == 0
    sheets, rows = headers.recovered(grids.drop("error"))
    got = {r.file[0]: r for r in sheets.collect()}
    assert got["a"].header_rows == [3, 4] and got["a"].names == TEMPLATE and got["a"].hint == "计算机学院" and got["a"].dropped == 1
    assert got["b"].header_rows == [1] and got["c"].names[0] == "二级单位"
    assert sorted((r.file[0], r.row_no) for r in rows.collect()) == [("a", 5), ("a", 6), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("c", 4), ("c", 5)]
    samples = {(r.file[0], r.name): r.samples for r in headers.column_samples(sheets, rows).collect()}
    assert samples["a", "姓名"] == ["张三", "李四"] and samples["c", "姓名"] == ["孙七", "周八"]


def test_records_are_clean(result):
    rows = {(r.src_file[0], r.src_row): r for r in result.records.collect()}
    assert len(rows) == 8 and result.dropped == 1 and result.failures == {}
    assert result.kinds["学生数"] == "integer" and result.kinds["填报日期"] == "date"
    first = rows["a", 5]
    assert (first["单位"], first["姓名"], first["学生数"], first["填报日期"], first.src_sheet) == ("计算机学院", "张三", 120, date(2026, 9, 1), "师资统计")
    other = rows["b", 2]
    assert (other["单位"], other["姓名"], other["学生数"], other["填报日期"], other.src_sheet) == ("外国语学院", "王五", 3500, date(2026, 9, 1), "")
    assert rows["b", 3]["学生数"] == 2100 and rows["c", 5]["职称"] is None and rows["c", 5]["学生数"] is None


def test_issues(result):
    issues = result.issues.collect()
    errors = [i for i in issues if i.level == "error"]
    assert len(errors) == 1 and errors[0].rule == "duplicate" and errors[0].row == 4 and "孙七" in errors[0].problem
    missing = [(i.column, i.row) for i in issues if i.rule == "missing" and i.column == "姓名"]
    assert missing == [("姓名", 3)]
    assert any(i.rule == "normalized" and i.value == "3,500" for i in issues)
    levels = [i.level for i in issues]
    assert levels == sorted(levels, key=["error", "warning", "info"].index)


def test_table_can_be_asked(result):
    table = result.table()
    answer = table.ask('SELECT "单位", SUM(学生数) AS 总数 FROM 汇总数据 GROUP BY "单位" ORDER BY 总数 DESC LIMIT 1')
    assert answer.error == "" and answer.rows == [("外国语学院", 5600)]


def test_rerun_needs_confirmation(spark, result, inbox):
    engine = Engine(spark, Settings(this_year=2026))
    with pytest.raises(PermissionError):
        engine.rerun(result, str(inbox), {"课时数": "课程数"})
    again = engine.rerun(result, str(inbox), {"课时数": "课程数"}, confirm=True)
    assert {r["课程数"] for r in again.records.where("src_file LIKE 'b%'").collect()} == {12000, 9800}


@pytest.mark.parametrize(
    "columns, fields, want",
    [
        (["填报单位"], ["单位", "姓名"], ["单位"]),
        (["教师姓名"], ["单位", "姓名"], ["姓名"]),
        (["所在学院"], ["单位", "姓名"], ["单位"]),
        (["所在学院"], ["单位", "部门", "人数"], [n.UNKNOWN]),
        (["课时数"], ["课程数"], [n.UNKNOWN]),
        (["学生人数"], ["学生数"], ["学生数"]),
        (["序号", "备注", "No."], ["单位"], [n.IGNORE] * 3),
    ],
)
def test_rules(columns, fields, want):
    assert list(align.match_by_rules(columns, fields).targets.values()) == want


def test_conflicts_and_fields():
    mapping = align.Mapping({"a": "x", "b": "x", "c": "y"}, {"a": 0.5, "b": 0.9, "c": 0.3})
    solved = align.resolve_conflicts(mapping)
    assert solved.targets == {"a": n.UNKNOWN, "b": "x", "c": "y"} and solved.confidence["a"] == 0.4
    assert solved.uncertain() == ["a", "c"]
    assert align.pick_fields([["a", "bb"], ["x", "y"], ["x"]]) == ["x", "y"]
    assert align.pick_fields([["a"]], [" t ", "t", ""]) == ["t"]


@pytest.mark.parametrize(
    "values, kind, want",
    [
        (["1.2万", "3,500"], "integer", [12000, 3500]),
        (["1.2万", "约二十"], "text", ["1.2万", "约二十"]),
        ([20261001, 20261002], "integer", [20261001, 20261002]),
        (["无", "N/A", "—", "1.5"], "number", [None, None, None, 1.5]),
        (["2026/9/1", "2026年9月2日"], "date", [date(2026, 9, 1), date(2026, 9, 2)]),
        (["9223372036854775808000"], "integer", [9223372036854775808000]),
    ],
)
def test_kinds_need_the_whole_column(spark, tmp_path, values, kind, want):
    workbook(tmp_path / "x.xlsx", {"Sheet1": ([["单位", "姓名", "数量"], *[["甲学院", f"人{k}", v] for k, v in enumerate(values)]], [])})
    result = Engine(spark, Settings(this_year=2026)).consolidate(str(tmp_path))
    assert result.kinds["数量"] == kind
    assert [r["数量"] for r in result.records.orderBy("src_row").collect()] == want


def test_csv_encodings_and_broken_files(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes('单位,姓名,数量\n甲学院,"多\n行",5\n'.encode("gb18030"))
    (tmp_path / "u+1.CSV").write_bytes("﻿单位,姓名,数量\n乙学院,李四,6\n".encode())
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    (tmp_path / "note.txt").write_text("ignored")
    result = Engine(spark).consolidate(str(tmp_path))
    assert set(result.failures) == {"bad.xlsx", "old.xls"}
    assert sorted((r.src_file, r["姓名"], r["数量"]) for r in result.records.collect()) == [("g.csv", "多行", 5), ("u+1.CSV", "李四", 6)]


def test_workbook_sink_can_be_read_again(spark, result, tmp_path):
    fields = result.fields
    assert tables.write_workbook(tables.summary_table(result.records, fields), str(tmp_path / "out.xlsx"), {"课程数"}) == 8
    assert tables.write_workbook(tables.issue_table(result.issues), str(tmp_path / "issues.xlsx")) == result.issues.count()
    again = Engine(spark).consolidate(str(tmp_path / "out.xlsx"))
    assert again.records.count() == 8 and again.fields[:6] == fields
    assert tables.width_of("a王") == 3
