import random

import pytest

from sheafwork.operators import first_distinct as f


@pytest.mark.parametrize("most, held", [(3, 500_000), (1, 2), (50, 7), (0, 10)])
def test_equals_brute_force(spark, monkeypatch, most, held):
    monkeypatch.setattr(f, "HELD_VALUES", held)
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 3), rnd.choice([None, rnd.randint(0, 40)]), rnd.choice([None, f"v{rnd.randint(0, 25)}"])) for _ in range(3000)]
    want = {}
    for key, place, order, value in rows:
        if order is not None and value is not None:
            own = want.setdefault((key, place), {})
            own[value] = min(order, own.get(value, order))
    want = {k: sorted(v, key=lambda x: (v[x], x))[:most] for k, v in want.items()} if most else {}
    df = spark.createDataFrame(rows, "value string, place int, k0 int, order string").repartition(7)
    got = {(r["value"], r["place"]): r["values"] for r in f.first_distinct(df, ["value", "place"], "k0", "order", most).collect()}
    assert got == want


def test_a_task_keeps_few_values():
    import pyarrow as pa

    schema = pa.schema([("k", pa.string()), ("order", pa.int64()), ("value", pa.string())])
    batches = (pa.record_batch([["x"] * 1000, list(range(k * 1000, k * 1000 + 1000)), [f"v{i}" for i in range(k * 1000, k * 1000 + 1000)]], schema=schema) for k in range(50, -1, -1))
    assert sorted(r["order"] for b in f._kept(4, 1, schema, batches) for r in b.to_pylist()) == [0, 1, 2, 3]
