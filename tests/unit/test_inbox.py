import os
import threading

import pytest

from oldsheets import book, cell, compound
from sheafwork.plans import inbox as inboxes
from sheafwork.plans.consolidate import Engine, Settings
from sheafwork.sources import files
from sheets import workbook

HEAD = ["单位", "姓名", "人数"]


def sheet(path, *rows):
    workbook(path, {"Sheet1": ([HEAD, *rows], [])})


def told(result):
    records = sorted(tuple(map(str, r)) for r in result.records.collect())
    return records, sorted(map(str, result.issues.collect())), result.fields, result.kinds, result.failures


@pytest.fixture
def place(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    engine = Engine(spark, Settings(this_year=2026))
    return folder, engine, inboxes.Inbox(engine, str(folder), str(tmp_path / "state"))


def test_runs_read_only_what_is_new_and_equal_a_full_run(spark, place, monkeypatch):
    folder, engine, inbox = place
    read = []
    own = inboxes.read_grids
    monkeypatch.setattr(inboxes, "read_grids", lambda s, paths: read.extend(os.path.basename(p) for p in paths) or own(s, paths))
    sheet(folder / "a b.xlsx", ["甲学院", "张三", "1.2万"], ["甲学院", "李四", "80"])
    (folder / "c.csv").write_text("所在学院,姓名,人数\n乙学院,王五,7\n", encoding="utf-8")
    (folder / "bad.xls").write_bytes(b"no")
    assert inbox.refresh() == (["a b.xlsx", "bad.xls", "c.csv"], []) and len(read) == 3
    assert told(inbox.consolidate(HEAD)) == told(engine.consolidate(str(folder), HEAD)) and len(read) == 3
    sheet(folder / "d.xlsx", ["丙学院", "赵六", "约九"])  # a kind of all files changes
    (folder / "c.csv").write_text("所在学院,姓名,人数\n乙学院,王五,8\n甲学院,张三,1\n", encoding="utf-8")
    os.remove(folder / "bad.xls")
    os.utime(folder / "a b.xlsx", (1, 1))  # touched, not changed
    read.clear()
    assert inbox.refresh() == (["c.csv", "d.xlsx"], ["bad.xls"]) and sorted(read) == ["c.csv", "d.xlsx"]
    assert told(inbox.consolidate(HEAD)) == told(engine.consolidate(str(folder), HEAD))
    assert inbox.refresh() == ([], []) and len(read) == 2


def test_a_lost_run_leaves_nothing(spark, place, monkeypatch):
    folder, _, inbox = place
    sheet(folder / "a.xlsx", ["甲学院", "张三", "5"])
    monkeypatch.setattr(inbox._store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        inbox.refresh()
    monkeypatch.undo()
    assert inbox.grids().count() == 0
    inbox.refresh()
    assert inbox.grids().count() == 2


def test_two_runs_at_once_and_folders_are_joined(spark, place, monkeypatch):
    folder, engine, inbox = place
    other = inboxes.Inbox(engine, str(folder), inbox._state)
    sheet(folder / "a.xlsx", ["甲学院", "张三", "5"])
    threads = [threading.Thread(target=x.refresh) for x in (inbox, other)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert inbox.grids().count() == 2
    monkeypatch.setattr(inboxes, "MOST_FOLDERS", 1)
    sheet(folder / "b.xlsx", ["乙学院", "李四", "6"])
    inbox.refresh()
    assert inbox._ledger().select("batch").distinct().count() == 1 and inbox.grids().count() == 4


def test_files_that_arrive_are_read_by_a_stream(spark, place, tmp_path):
    folder, _, inbox = place
    for k in range(2):
        sheet(folder / f"{k}.xlsx", ["甲学院", "张三", str(k)])
        query = inbox.watch(str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
        assert query.exception() is None and inbox.grids().count() == 2 * (k + 1)


def test_a_list_of_files(spark, place):
    folder, *_ = place
    sheet(folder / "a.xlsx", ["甲学院", "张三", "5"])
    sheet(folder / "b.xlsx", ["乙学院", "李四", "6"])
    (folder / "c.xls").write_bytes(compound(book({"s": cell(0x203, 0, 0, b"\0" * 8)})))
    (folder / "d.csv").write_text("a\n")
    got = files.read_grids(spark, [f"file:{folder}/b.xlsx", str(folder / "c.xls"), str(folder / "d.csv")])
    assert sorted((r["file"], r["row_no"]) for r in got.collect()) == [("b.xlsx", 1), ("b.xlsx", 2), ("c.xls", 1), ("d.csv", 1)]
