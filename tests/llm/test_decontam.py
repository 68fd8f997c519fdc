import random
import re

import pytest
from pyspark.sql import functions as F

from sheafwork.llm import decontam as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        if not x or item is None:
            continue
        n = min(window, len(x))
        for phrase in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == phrase:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.fixture
def tables(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Über", "x'y", "ſ"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (2, say(5)), (10, say(3)), (3, None), (4, "--"), (None, say(4)), (2, "w1 w2"), (5, "never seen terms")]
    items.append((6, items[0][1]))
    docs = [(i, say(r.randrange(0, 120))) for i in range(40)]
    docs += [(100, items[0][1].upper() + " tail"), (100, items[1][1]), (101, None), (102, ""), (None, items[1][1]), (None, None), (103, say(30) + ". " + items[0][1]), (103, "again")]
    docs += [docs[40], (104, " ".join(["w3"] * 500))]
    return (
        docs,
        items,
        spark.createDataFrame([(*x, 0, "t") for x in docs], "doc_id long, text string, pos int, term string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("window, most", [(13, 500_000), (4, 500_000), (2, 0)])
def test_against_brute_force(tables, window, most, monkeypatch):
    docs, items, frame, benchmark = tables
    monkeypatch.setattr(d, "BROADCAST_ROWS", most)
    got = d.judged(frame, benchmark, window).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    want = [(i, *plain(t, items, window)) for i, t in docs]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = d.without_contaminated(frame, benchmark, window)
    assert kept.columns == frame.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr((i, t)) for (i, t), w in zip(docs, want) if not w[4])


def test_empty_tables(tables):
    _, _, frame, benchmark = tables
    assert d.judged(frame.where("false"), benchmark).count() == 0
    assert {r.n_hit for r in d.judged(frame, benchmark.where("false")).collect()} == {0}


def test_proximity_against_brute_force(spark, tables):
    docs, _, frame, _ = tables
    rows = d.keyed(frame).dropDuplicates(["id", "version"])
    queries = [(1, ["w1", "w2", "w5"]), (2, ["w3"]), (3, ["w7", "nowhere"]), (4, ["über", "w0", "w0"])]
    found = d.proximity_matches(d.build_index(rows), spark.createDataFrame(queries, "query long, terms array<string>"), 6)
    texts = rows.select("id", "version", "text").collect()
    want = set()
    for q, terms in queries:
        for r in texts:
            w = words(r.text)
            best = {}
            for end in range(len(w)):
                last = {t: max((k for k in range(max(0, end - 5), end + 1) if w[k] == t), default=None) for t in terms}
                if w[end] in terms and None not in last.values():
                    best.setdefault(min(last.values()), end + 1)
            want |= {(q, r.id, r.version, s, e) for s, e in best.items()}
    assert {tuple(x) for x in found.select("query", "id", "version", "start", "end").collect()} == want and want


def test_no_python_in_the_plan(tables):
    _, _, frame, benchmark = tables
    plan = d.judged(frame, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_covered(spark):
    spans = spark.sql("select array(named_struct('start', 0, 'end', 5), named_struct('start', 3, 'end', 4), named_struct('start', 4, 'end', 7), named_struct('start', 9, 'end', 10)) h")
    assert spans.select(d.covered(F.col("h"))).first()[0] == 8
