import pytest
from pyspark.sql import functions as F

from sheafwork.functions import names as n
from sheafwork.operators import align, validate
from sheafwork.plans.consolidate import Engine, Settings
from sheafwork.sinks import tables
from sheets import workbook

HEADER = ["单位", "f", "file_rows", "all_rows", "src_row", "SRC_FILE", "state", "来源文件", "来源行", "a`b", "x.y", "数量", "数量", "A", "a"]


def test_numbered():
    assert n.numbered(["a", "A", "a", "", "", "a_2", "b"], ["B"]) == ["a", "A_3", "a_4", "", "", "a_2", "b_2"]
    assert n.numbered([]) == [] and n.unused("x", ["X", "x_"]) == "x__" and n.quoted("a`b") == "`a``b`"
    assert align.pick_fields([["数量", "数量", "src_row"], ["x"]]) == ["数量", "数量_2", "src_row_2"]
    assert align.pick_fields([["数量"]], ["src_order", "数量", "数量 "]) == ["src_order_2", "数量"]


def test_any_header_passes_through_the_engine(spark, tmp_path):
    rows = [HEADER, *[[f"甲{k}学院", *[f"v{k}{c}" if c % 2 else k * 100 + c for c in range(1, len(HEADER))]] for k in range(4)]]
    rows[4][3] = None
    workbook(tmp_path / "x.xlsx", {"Sheet1": (rows, [])})
    result = Engine(spark, Settings(this_year=2026)).consolidate(str(tmp_path))
    assert result.fields == n.numbered(HEADER, ("src_file", "src_sheet", "src_row", "src_order")) and len(set(result.fields)) == len(HEADER)
    assert [r[0] for r in result.mappings[0].targets.items() if r[1] == n.UNKNOWN] == []
    found = {r["src_row"]: [str(r[f]) for f in result.fields] for r in result.records.collect()}
    assert found[3][:3] == ["甲1学院", "v11", "102"] and found[3][-4:] == ["v111", "112", "v113", "114"] and found[5][3] == "None"
    assert ("missing", "all_rows", 5) in {(i["rule"], i["column"], i["row"]) for i in result.issues.collect()}
    answer = result.table().ask('SELECT "a`b", "x.y", "来源文件_", "来源行_", "数量_2" FROM 汇总数据 WHERE "src_row_2" = 104 ORDER BY 1')
    assert answer.error == "" and answer.rows == [("v19", 110, "x.xlsx", 3, 112)]
    assert tables.summary_table(result.records, result.fields).columns == [*result.fields, "来源文件_", "来源行_"]
    assert result.outcomes().first()["n_rows"] == 4


@pytest.mark.parametrize("names", [["f", "file_rows", "all_rows"], ["state", "k", "s"], ["key", "used", "shown"], ["first", "times", "i"]])
def test_rules_over_any_field_names(spark, names):
    rows = [("a.csv", "", k, k, "1", None if k == 3 else "2", "x" if k == 4 else "3") for k in range(1, 7)] + [("b.csv", "", k, 10 + k, "5", "6", "7") for k in (1, 2)]
    records = spark.createDataFrame(rows, f"src_file string, src_sheet string, src_row int, src_order int, {', '.join(f'`{x}` string' for x in names)}")
    found = {(i["rule"], i["column"], i["file"], i["row"]) for i in validate.validate(records, names).collect()}
    assert {("missing", names[1], "a.csv", 3), ("type_outlier", names[2], "a.csv", 4)} <= found
    assert validate.missing(records, names).count() == 1 and validate.type_outliers(records, names).count() == 1
    assert validate.sparse_rows(records, names).count() == 0 and validate.duplicates(records.where(F.col("src_row") < 3), names).count() == 2
