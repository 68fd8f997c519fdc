import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from sheafwork.llm import graph, near_dup


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    n = min(words, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def plain_groups(rows, words, percent):
    """{doc_id: (size, least reachable doc_id)} by comparing all pairs that share a shingle."""
    sets = {i: plain_set(t, words) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(entry.queries()["op10_minhash"](spark, d).collect(), plain_groups(rows, 3, 85))


def near_copies(n, seed=4):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words[: r.randrange(120, 151)])))
    return rows


def test_a_large_group_is_compared_by_blocks(spark, monkeypatch):
    rows = near_copies(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 3
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 7)
    for most in (250_000, 0):
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", most)
        check(near_dup.near_duplicates(docs, 3, 85).collect(), want)


def test_texts_moved_grow_with_a_clusters_size(spark, monkeypatch):
    """Each document goes to one task, and again only to those that compare what no representative links."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 10)
    r = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows, kinds = [], [base, base[:130] + [f"v{k}" for k in range(70)]]
    for i in range(400):
        words = list(kinds[i % 50 == 0])
        words[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    moved = []
    for n in (100, 400):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        clusters = spark.createDataFrame([(i, 198, 1) for i, _ in rows[:n]], "doc_id long, n_shingles long, cluster long")
        first = near_dup.first_comparisons(clusters)
        found = near_dup.links(docs, first, 3, 85)
        parted = near_dup.settled(clusters, found)
        assert parted.where("settled").count() == n - n // 50
        tasks = near_dup.comparisons(parted, 85)
        moved.append(first.count() + tasks.count())
    assert moved[1] < 5 * moved[0] and moved[0] < 3 * 100
    monkeypatch.setattr(near_dup, "REPRESENTATIVES", 2)
    check(near_dup.near_duplicates(docs, 3, 85).collect(), plain_groups(rows, 3, 85))


def test_settled_documents_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 5)
    sizes = [(i, 100 + i % 60, 1, i % 3 > 0) for i in range(60)]
    tasks = defaultdict(list)
    for r in near_dup.comparisons(spark.createDataFrame(sizes, "doc_id long, n_shingles long, cluster long, settled boolean"), 85).collect():
        tasks[r.task].append((r.doc_id, r.side))
    met = {frozenset((a, b)) for rows in tasks.values() for a, s in rows for b, t in rows if a != b and (s == t == 0 or {s, t} == {1, 2})}
    for a, n, _, x in sizes:
        for b, m, _, y in sizes:
            if a < b and 100 * min(n, m) >= 85 * max(n, m):
                assert (frozenset((a, b)) in met) == (not (x and y)) or not (x and y)
    assert not any(sizes[a][3] and sizes[b][3] for a, b in map(tuple, met))


def test_a_stranger_at_the_head_of_a_bucket_loses_no_tie(spark):
    """One bucket holds a stranger with the least id, and pairs that agree."""
    sketch = {"x": (0, 0, 0, 0), "y": (-1, -1, -1, -1), "z": (0, 0, -1, -1)}
    rows = [(1, [7], *sketch["x"]), (2, [7], *sketch["y"]), (3, [7], *sketch["z"]), (4, [7], *sketch["y"]), (5, [7, 8], *sketch["z"]), (6, [7], *sketch["x"]), (9, [8], *sketch["z"])]
    classes = spark.createDataFrame(rows, "doc_id long, bands array<long>, k0 long, k1 long, k2 long, k3 long")
    assert {tuple(sorted(map(int, r))) for r in near_dup.ties(classes).collect()} >= {(1, 6), (2, 4), (3, 5), (5, 9)}


def test_blocks_meet_once_each(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 5)
    sizes = [(i, 100 + i % 60, 1) for i in range(60)] + [(100 + i, 50, 2) for i in range(4)]
    tasks = defaultdict(list)
    for r in near_dup.comparisons(spark.createDataFrame(sizes, "doc_id long, n_shingles long, cluster long"), 85).collect():
        tasks[r.task].append((r.doc_id, r.side))
    met = set()
    for rows in tasks.values():
        met |= {frozenset((a, b)) for a, s in rows for b, t in rows if a != b and (s == t == 0 or {s, t} == {1, 2})}
    size = {i: n for i, n, _ in sizes}
    for a, _, x in sizes:
        for b, _, y in sizes:
            if a < b and x == y and 100 * min(size[a], size[b]) >= 85 * max(size[a], size[b]):
                assert frozenset((a, b)) in met


def test_links_equal_the_sets_own():
    rows = near_copies(40, seed=9)
    sets = [near_dup.shingle_set(t, 3) for _, t in rows]
    want = plain_groups(rows, 3, 85)
    up = list(range(40))
    for a, b in near_dup.linked([i for i, _ in rows], [0] * 40, sets, 85):
        low, high = sorted((up[a], up[b]))
        up = [low if x == high else x for x in up]
    assert {i: c for i, (_, c) in want.items()} == dict(enumerate(up))


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[250:]
    alike = np.mean(near_dup.signature(a, 512) == near_dup.signature(b, 512))
    assert abs(alike - 0.5) < 0.08  # 750 of 1500
    assert near_dup.band_plan(85) == (51, 8) and near_dup.band_plan(80) == (69, 7)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(500, i) for i in range(501, 600)] + [(r.randrange(700, 760), r.randrange(700, 760)) for _ in range(50)] + [(9, 9), (None, 3), (99, 98)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == up and len(got) == len(up)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    rows = [(5, "A b", "x"), (3, "a  B\n", "x"), (None, "a b", "x"), (None, "only here", "x"), (8, None, "x"), (9, " \t", "x"), (7, "a b", "x"), (7, "a b", "x"), (20, long, "x"), (21, long + " end", "x"), (22, "ÀB c d", "x"), (23, "àB c d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert got == sorted(
        [(5, 1, 3, False), (3, 1, 3, True), (None, 1, 3, False), (None, 1, None, True), (8, 0, 8, True), (9, 0, 9, True), (7, 1, 3, False), (7, 1, 3, False), (20, 977, 20, True), (21, 978, 20, False), (22, 1, 22, True), (23, 1, 23, True)],
        key=repr,
    )
    assert near_dup.near_duplicates(docs.where("false")).count() == 0
    kept = near_dup.deduplicated(docs.unionByName(docs.where("doc_id = 8")), 3, 85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, None, None, 8, 9, 20, 22, 23], key=repr)
