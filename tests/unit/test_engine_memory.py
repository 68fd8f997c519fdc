import threading
import time
from datetime import datetime

import pytest

from sheafwork.functions import names as n
from sheafwork.operators import align, validate
from sheafwork.plans import ask
from sheafwork.plans.consolidate import Engine, Settings
from sheafwork.plans.store import Store
from sheafwork.sinks import tables
from sheafwork.sources import files
from sheets import workbook


def test_conflicts_of_rows_equal_those_of_a_mapping(spark):
    rows = [("h", 0, "a", "x", 0.5), ("h", 1, "b", "x", 0.9), ("h", 2, "c", "y", 0.3), ("h", 3, "d", "x", 0.9), ("h", 4, "e", n.IGNORE, 0.4), ("h", 5, "f", n.IGNORE, 0.4), ("g", 0, "a", "x", 0.1)]
    claims = spark.createDataFrame(rows, "header string, pos int, source_col string, target string, confidence double")
    got = {(r.header, r.source_col): (r.target, r.confidence) for r in align.without_conflicts(claims).collect()}
    own = [r for r in rows if r[0] == "h"]
    solved = align.resolve_conflicts(align.Mapping({r[2]: r[3] for r in own}, {r[2]: r[4] for r in own}))
    assert {k[1]: v for k, v in got.items() if k[0] == "h"} == {c: (t, solved.confidence[c]) for c, t in solved.targets.items()}
    assert got["g", "a"] == ("x", 0.1) and [c for c, t in solved.targets.items() if t == n.UNKNOWN] == ["a", "d"]


def test_engine_remembers_and_users_choices_stay(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    workbook(inbox / "x.xlsx", {"Sheet1": ([["学院名称", "教师姓名", "课时数"], ["甲学院", "张三", 5], ["乙学院", "李四", 6]], [])})
    store, asked = Store(spark, str(tmp_path / "store")), []

    def matcher(columns, fields, samples):
        asked.append(samples)
        return align.Mapping(dict(zip(columns, ["单位", "姓名", n.UNKNOWN])), {c: 0.8 for c in columns}, {}, "llm")

    engine = Engine(spark, Settings(this_year=2026), matcher, store, lambda: "2026-01-01 00:00:00")
    fields = ["单位", "姓名", "课程数"]
    first = engine.consolidate(str(inbox), fields)
    assert len(asked) == 1 and asked[0]["columns"]["教师姓名"] == ["张三", "李四"] and first.mappings[0].source == "llm"
    again = engine.consolidate(str(inbox), fields)
    assert len(asked) == 1 and again.mappings[0].source == "cache" and again.mappings[0].targets == first.mappings[0].targets
    engine.rerun(again, str(inbox), {"课时数": "课程数"}, confirm=True)
    sign = n.signature_of(["学院名称", "教师姓名", "课时数"])
    assert store.get_mappings({sign})[sign][:2] == ({"学院名称": "单位", "教师姓名": "姓名", "课时数": "课程数"}, "user")
    store.put_mapping(sign, {"学院名称": "单位"}, "llm", {}, "2027-01-01 00:00:00")
    assert store.get_mapping(sign)[1] == "user"
    other = engine.consolidate(str(inbox), ["单位", "姓名"])  # a field is gone: made anew
    assert len(asked) == 2 and other.mappings[0].source == "llm"
    runs = store.table("runs").orderBy("id").collect()
    assert [r.id for r in runs] == [1, 2, 3, 4] and runs[0].n_records == 2 and runs[0].finished_at and runs[0].n_files == 1
    assert [tuple(r) for r in first.outcomes().select("file", "status", "n_sheets", "n_rows", "source").collect()] == [("x.xlsx", "read", 1, 2, "llm")]


def test_rules_are_not_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.put_mappings([("s", {"a": "b"}, "rule", {})], "2026-01-01 00:00:00")
    assert store.count("mapping_cache") == 0 and store.get_mapping("s") is None and store.next_run() == 1


def test_template_and_outputs(spark, tmp_path):
    workbook(tmp_path / "b.xlsx", {"Sheet1": ([["z", "y", "x"], ["a", "b", "c"]], [])})
    workbook(tmp_path / "a.xlsx", {"Sheet1": ([["单位", "姓名", "学生数"], ["甲学院", "张三", 5]], [])})
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    assert Engine(spark).template(str(tmp_path)) == ["单位", "姓名", "学生数"]
    (tmp_path / "none").mkdir()
    assert files.find_template(spark, str(tmp_path / "none")) is None
    none = spark.createDataFrame([], validate.ISSUE)
    assert [(r.level, r.problem) for r in tables.issue_table(none, tables.run_note(1, 2, 0)).collect()] == [("info", "no problem was found"), ("note", "2 records from 1 files, 0 issues")]
    paths = tables.output_paths(str(tmp_path), datetime(2026, 9, 1, 12, 30))
    assert paths["summary"].endswith("summary-20260901-1230")
    tables.write_parquet(none, paths["issues"])
    assert tables.latest_outputs(spark, str(tmp_path)) == {"summary": None, "issues": paths["issues"]}


def test_tables_answer_for_themselves(spark):
    one, two = (ask.Table(spark.createDataFrame([(k,)], "n long")) for k in (1, 2))
    assert one.ask("SELECT n FROM 汇总数据").rows == [(1,)] and two.ask("SELECT n FROM `汇总数据`").rows == [(2,)]
    assert "汇总数据_" not in one.ask("SELECT m FROM 汇总数据").error


@pytest.mark.parametrize("sql", ["SELECT read_files('/etc')", "SELECT from_avro(n, '') FROM 汇总数据", "SELECT from_protobuf(n, 'M', '/etc/passwd') FROM 汇总数据", "SELECT java_method('a', 'b')", "SELECT schema_of_csv('a')"])
def test_other_functions_are_refused(spark, sql):
    assert "may not be used" in ask.Table(spark.createDataFrame([(1,)], "n long")).ask(sql).error


def test_the_other_dialects_calls():
    assert ask.prepared("SELECT total(max(a, b)), max(a), strftime('%Y-%m', d) FROM t", set()) == (
        "SELECT coalesce(sum(CASE WHEN (a) IS NULL OR ( b) IS NULL THEN NULL ELSE greatest(a,  b) END), 0D), max(a), date_format( d, \"yyyy-MM\") FROM t"
    )
    with pytest.raises(ask.Refused):
        ask.prepared("SELECT strftime('%W', d)", set())


def test_a_late_plan_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(ask, "GRACE", 0.3)
    done, began = threading.Event(), time.monotonic()
    with pytest.raises(TimeoutError):
        ask.within(spark, 0.2, lambda: done.wait(20))
    assert time.monotonic() - began < 5
    done.set()
