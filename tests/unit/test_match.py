import random

import pytest

from sheafwork.functions import names as n
from sheafwork.operators import align, match
from sheafwork.plans import consolidate
from sheafwork.plans.consolidate import Engine, Settings

WORDS = ["单位", "部门", "学院", "姓名", "教师", "学生", "人数", "数量", "填报", "日期", "所在", "No.", "备注", "（元）", "A b", "课程", "课时", "id", "·", "数", ""]


def name(rnd):
    return "".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 4)))


def test_all_headers_in_one_plan_equal_one_by_one(spark):
    rnd = random.Random(6)
    fields = list(dict.fromkeys(["单位", "姓名", "学生数", "课程数", "填报日期", "部门", "教师姓名", *(name(rnd) for _ in range(25))]))
    headers = list(dict.fromkeys(tuple(dict.fromkeys(name(rnd) for _ in range(rnd.randint(1, 12)))) for _ in range(10_000)))
    got = align.match_all_by_rules(spark, headers, fields)
    wrong = [h for h in headers if got[h] != align.match_by_rules(list(h), fields)]
    assert not wrong, (wrong[:2], [(got[h].targets, align.match_by_rules(list(h), fields).targets) for h in wrong[:2]])
    assert {t for m in got.values() for t in m.targets.values()} >= {n.IGNORE, n.UNKNOWN, "单位", "姓名"}


def test_plan_has_no_all_pairs_comparison(spark):
    columns = spark.createDataFrame([("h", 0, "学生人数")], "header string, pos int, source_col string")
    found = match.match_headers(columns, ["学生数", "单位"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 1  # the one row of a field without letters
    assert [tuple(r) for r in found.collect()] == [("h", 0, "学生人数", "学生数", 0.4)]


@pytest.mark.parametrize("columns, fields", [([], ["a"]), ([("h", 0, "a")], []), ([(None, 0, "a"), ("h", 1, None)], ["a"])])
def test_nothing_to_match(spark, columns, fields):
    table = spark.createDataFrame(columns, "header string, pos int, source_col string")
    assert [r["target"] for r in match.match_headers(table, fields).collect()] == [n.UNKNOWN for c in columns if None not in c]


def test_alike_names_equal_brute_force(spark):
    rnd = random.Random(2)
    sets = lambda k: sorted({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(k)})
    left, right = sets(150), sets(150)
    rows = lambda names, key: spark.createDataFrame([(x, sorted(set(x))) for x in names], f"{key} string, chars array<string>")
    got = {(r["key"], r["other"]): r["likeness"] for r in match.alike_names(rows(left, "key"), rows(right, "other")).collect()}
    assert got == {(a, b): s for a in left for b in right if (s := n.likeness_of(a, b)) >= n.LEAST_LIKENESS} and got


def test_engine_uses_the_plan_for_many_headers(spark, monkeypatch):
    grid = [(f"f{k}.csv", "", r, [("s", x) for x in row]) for k in range(3) for r, row in enumerate([["所在学院", f"教师姓名{k}", "人数"], ["甲学院", "张三", "5"]], 1)]
    table = spark.createDataFrame(grid, "file string, sheet string, row_no int, cells array<struct<kind:string,text:string>>")
    one = Engine(spark, Settings(this_year=2026)).from_grids(table, ["单位", "姓名", "人数"])
    monkeypatch.setattr(consolidate, "PLANNED_HEADERS", 2)
    monkeypatch.setattr(align, "candidates", None, raising=False)
    all_ = Engine(spark, Settings(this_year=2026)).from_grids(table, ["单位", "姓名", "人数"])
    assert all_.mappings == one.mappings and all_.mappings[1].targets["教师姓名1"] == "姓名"
