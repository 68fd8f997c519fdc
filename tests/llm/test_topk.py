import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from sheafwork.llm import topk


def cut(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def plain(rows, queries, k):
    out = []
    for q, x in queries.items():
        scores = sorted(((-cut(sum(a * b for a, b in zip(x, y))), i) for i, y in rows.items() if i != q and len(y) == len(x)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def found(frame, asked, k):
    return sorted(map(tuple, topk.top_k(frame, asked, k).collect()))


@pytest.fixture(autouse=True)
def _small_parts(monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)


@pytest.mark.parametrize("kind", ["spread", "groups", "equal", "huge"])
def test_against_brute_force(spark, kind):
    r = random.Random(kind)
    centre = [[r.randrange(-60, 60) for _ in range(6)] for _ in range(4)]
    make = {
        "spread": lambda i: [r.randrange(-64, 64) for _ in range(6)],
        "groups": lambda i: [c + r.randrange(-3, 4) for c in centre[i % 4]],
        "equal": lambda i: [1, 2, 3] if i % 3 else [i % 5, 0, 1],
        "huge": lambda i: [r.randrange(-(2**60), 2**60) for _ in range(3)],
    }[kind]
    rows = {i: make(i) for i in range(300)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<long>")
    queries = {i: x for i, x in rows.items() if i % 10 == 0}
    assert found(frame, frame.where("vec_id % 10 = 0"), 5) == plain(rows, queries, 5)


def test_tree_opens_few_leaves_for_grouped_rows():
    r = np.random.default_rng(0)
    vectors = np.repeat(r.integers(-50, 50, (64, 8)), 64, axis=0) + r.integers(-1, 2, (4096, 8))
    tree = topk.build_tree(np.arange(4096), vectors, 64)
    leaves = tree["nodes"][:, tree["nodes"][2] < 0]
    assert (leaves[1] - leaves[0]).max() <= 64 and (leaves[1] - leaves[0]).sum() == 4096
    for k in range(tree["nodes"].shape[1]):
        rows = tree["vectors"][tree["nodes"][0, k] : tree["nodes"][1, k]]
        assert (rows.min(axis=0) == tree["low"][k]).all() and (rows.max(axis=0) == tree["high"][k]).all()


@pytest.mark.parametrize("spread, most", [(1, 0.1), (8, 0.3)])
def test_bounds_spare_most_leaves(spread, most):
    r = np.random.default_rng(1)
    vectors = np.repeat(r.integers(-50, 50, (64, 8)), 64, axis=0) + r.integers(-spread, spread + 1, (4096, 8))
    tree = topk.build_tree(np.arange(4096), vectors, 64)
    leaves = (tree["nodes"][2] < 0).sum()
    queries, opened = vectors[::20], []
    first = {at: s for at, _, s in topk.search(tree, np.arange(0, 4096, 20), queries, [None] * len(queries), 10, opened)}
    assert np.mean(opened) < most * leaves
    again = []  # from the k-th scores of before, none but those that hold the best are opened
    for at, _, s in topk.search(tree, np.arange(0, 4096, 20), queries, [first[k][-1] for k in range(len(queries))], 10, again):
        assert s == first[at]
    assert np.mean(again) <= np.mean(opened)


def test_trees_are_unpacked_once_a_lane(spark, tmp_path, monkeypatch):
    rows = spark.range(400).selectExpr("id AS vec_id", "array(id % 7, id % 11, id % 13) AS vector")
    # The plan of the search sends blocks to shards: no row holds both a tree and a block.
    plan = topk.top_k(rows, rows.where("vec_id % 20 = 0"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "tree" not in plan and plan.count("RepartitionBy") >= 1


def test_most_pairs_of_block_and_shard_never_meet_for_grouped_rows(spark):
    r = np.random.default_rng(2)
    centres = r.integers(-50, 50, (32, 8))
    vectors = np.repeat(centres, 64, axis=0) + r.integers(-1, 2, (2048, 8))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(vectors.tolist())], "vec_id long, vector array<long>")
    asked = frame.where("vec_id % 5 = 0")
    shards, blocks = topk.packed(frame, asked)
    pairs, n_shards = shards.count() * blocks.count(), shards.count()
    sent = topk.reached(shards, blocks, 5)
    assert n_shards >= 24 and sent.count() < pairs / 3
    rows = dict(enumerate(vectors.tolist()))
    assert found(frame, asked, 5) == plain(rows, {i: x for i, x in rows.items() if i % 5 == 0}, 5)


def test_cells_hold_all_rows_once_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 100)
    rows = {i: [i % 3, 7, 7 if i % 3 else i] for i in range(900)}  # two thirds in two points
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<long>")
    shards, _ = topk.packed(frame, frame)
    sizes = [topk._unpacked(bytes(x.data))["ids"] for x in shards.collect()]
    assert sorted(i for x in sizes for i in x.tolist()) == list(range(900))
    assert max(map(len, sizes)) <= 120 and [x.shard for x in shards.orderBy("shard").collect()] == list(range(len(sizes)))
    queries = {i: x for i, x in rows.items() if i % 90 == 0}
    assert found(frame, frame.where("vec_id % 90 = 0"), 5) == plain(rows, queries, 5)


def test_odd_rows(spark):
    rows = [(1, [1, 2], "a"), (1, [1, 3], "a"), (2, [0, 1], "b"), (2, [0, 1], "b"), (3, None, "c"), (None, [9, 9], "d"), (4, [1, None], "e"), (5, [1], "f"), (6, [], "g"), (7, [2], None)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>, score string")
    clean = {1: [1, 3], 2: [0, 1], 5: [1], 6: [], 7: [2]}
    assert found(frame, frame, 3) == plain(clean, clean, 3)
    assert found(frame.where("false"), frame, 3) == [] == found(frame, frame.where("false"), 3)


def test_query_ranks(spark):
    rows = entry.queries()["op1_topk_search"](spark, "/root/testdata/sf0.001").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.query_id].append(r)
    assert all(sorted(r.rank for r in x) == list(range(1, 21)) and q not in {r.vec_id for r in x} and q % 20 == 0 for q, x in by.items())
