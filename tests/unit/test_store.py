import threading

import pytest

from sheafwork.plans import store


def test_precedence_and_round_trip(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.get_mapping("x") is None and s.count("runs") == 0
    s.put_mapping("x", {"a": "b"}, "llm", {"a": 0.5}, "2026-01-01")
    s.put_mapping("x", {"a": "c"}, "llm", {"a": 0.6}, "2026-01-02")
    assert s.get_mapping("x") == ({"a": "c"}, "llm", {"a": 0.6})
    s.put_mapping("x", {"a": "u"}, "user", {"a": 1.0}, "2026-01-03")
    s.put_mapping("x", {"a": "d"}, "llm", {"a": 0.9}, "2026-01-04")
    assert s.get_mapping("x") == ({"a": "u"}, "user", {"a": 1.0})
    row = s.table("mapping_cache").first()
    assert row.created_at == "2026-01-01" and row.hit_count == 2
    s.put_mapping("y", {}, "rule", {}, "2026-01-05")
    s.put_mapping("z", {}, "llm", {}, "2026-01-06")
    assert {r.signature for r in s.table("mapping_cache").collect()} == {"x", "z"}
    s.forget("z")
    assert s.count("mapping_cache") == 1
    s.forget()
    assert s.count("mapping_cache") == 0


def test_logs_and_costs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.log_run((1, "a", None, 1, 2, 3, 0.5))
    s.log_run((1, "a", "b", 1, 2, 3, 0.5))
    s.log_run((2, "a", "b", 1, 2, 3, 0.0))
    s.log_question((1, "t", "  " + "问" * 300, 0.25, 2))
    assert s.count("runs") == 2 and store.last_paid_run(s.table("runs")).first().id == 1
    assert store.total_cost(s.table("query_usage")).first()[0] == 0.25 and len(s.table("query_usage").first().question) == 200
    assert store.total_cost(s.table("runs").where("false")).first()[0] == 0.0
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("other", 1_000_000, 0)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double")
    assert [r.cost_cny for r in store.token_cost(usage, prices, (3.0, 4.0)).orderBy("model").collect()] == [2.0, 3.0]


def in_threads(*work):
    failed = []

    def run(w):
        try:
            w()
        except Exception as problem:  # noqa: BLE001
            failed.append(problem)

    threads = [threading.Thread(target=run, args=(w,)) for w in work]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed, failed


@pytest.mark.parametrize("by_rename", [False, True])
def test_two_writers_are_both_kept(spark, tmp_path, by_rename):
    stores = [store.Store(spark, str(tmp_path / "s")) for _ in range(3)]
    if by_rename:  # as where files can't be linked
        jvm = spark._jvm.org.apache.hadoop.fs
        for log in (x for s in stores for x in s._logs.values()):
            log._local, log._context = None, jvm.FileContext.getFileContext(spark._jsparkSession.sessionState().newHadoopConf())
            log._no_overwrite = spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    n = 2 if by_rename else 12
    if by_rename:  # one after the other: a local disk's rename isn't one step
        for k, s in enumerate(stores):
            [s.put_mapping(f"{k}-{i}", {"a": str(i)}, "llm", {}, "2026-01-01") for i in range(n)]
        assert not stores[0]._logs["mapping_cache"].create(1, "{}")
    else:
        in_threads(*(lambda s=s, k=k: [s.put_mapping(f"{k}-{i}", {"a": str(i)}, "llm", {}, "2026-01-01") for i in range(n)] for k, s in enumerate(stores)))
    assert {r.signature for r in stores[0].table("mapping_cache").collect()} == {f"{k}-{i}" for k in range(3) for i in range(n)}


def test_runs_started_at_once_have_different_numbers(spark, tmp_path):
    got = []
    in_threads(*(lambda: got.append(store.Store(spark, str(tmp_path / "s")).start_run("now")) for _ in range(5)))
    assert sorted(got) == [1, 2, 3, 4, 5] and store.Store(spark, str(tmp_path / "s")).next_run() == 6


def test_a_commit_that_depends_on_what_was_read(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.commit("runs", [{"id": 1}], after=0) == 1
    with pytest.raises(store.Conflict):
        s.commit("runs", [{"id": 1}], after=0)
    assert s.commit("runs", [{"id": 2}], after=1) == 2 and s.count("runs") == 2


def test_snapshots_change_nothing_and_end_old_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SNAPSHOT_AFTER", 4)
    s, plain = store.Store(spark, str(tmp_path / "s")), {}
    for k in range(22):
        name = f"m{k % 5}"
        if k % 7 == 6:
            s.forget(name)
            plain.pop(name, None)
        else:
            s.put_mapping(name, {"k": str(k)}, "user" if k == 3 else "llm", {}, f"2026-01-{k + 1:02}")
            if plain.get(name, (0, ""))[1] != "user" or k == 3:
                plain[name] = (str(k), "user" if k == 3 else "llm")
    found = {r.signature: r for r in store.Store(spark, str(tmp_path / "s")).table("mapping_cache").collect()}
    assert {k: (v.mapping, v.source) for k, v in found.items()} == {k: (f'{{"k": "{m}"}}', source) for k, (m, source) in plain.items()}
    log = s._logs["mapping_cache"]
    assert sum(bool(log.snapshot(k)) for k in log.numbers()) == 2 and len(log.numbers()) < 14
    assert s.compact("mapping_cache") is (not log.snapshot(log.numbers()[-1])) and len(s.get_mappings(set(plain))) == len(plain)
    assert min(r.hit_count for r in s.table("mapping_cache").collect()) == 1


def test_a_snapshot_gives_way(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    s.put_mapping("x", {}, "llm", {}, "1")
    fold = store.FOLDS["mapping_cache"]

    def slow(changes):
        store.Store(spark, str(tmp_path / "s")).put_mapping("y", {}, "llm", {}, "2")
        return fold(changes)

    monkeypatch.setitem(store.FOLDS, "mapping_cache", slow)
    assert s.compact("mapping_cache") is False
    monkeypatch.setitem(store.FOLDS, "mapping_cache", fold)
    assert {r.signature for r in s.table("mapping_cache").collect()} == {"x", "y"}
