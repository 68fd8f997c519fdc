import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheafwork.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, n bigint, mask int, id string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    )


def brute(docs, labels):
    """Every order walked over every row."""
    rows = [(d[0], d[1] or "", d[2] or "") for d in docs]
    good = {x[0] for x in labels if x[1] == 1 and x[0] is not None}
    toxic = {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    failing = []
    for i, text, part in rows:
        copy = i is not None and any(j is not None and j < i and t == text for j, t, _ in rows)
        failing.append((part, (*fails(text), copy), i in good, i in toxic))
    out = []
    for part in {p for p, *_ in failing}:
        of = [x for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        part_rows = []
        for order in permutations("ABCDE"):
            left = of
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[letter] += len(gone)
                alone = sum(x[1][k] and sum(x[1]) == 1 for x in of)
                part_rows.append([part, "".join(order), step, len(left), len(gone), sum(x[1][k] for x in of) - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in part_rows]
    return sorted(out)


def run(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return sorted(tuple(r) for r in entry.queries()["op12_filter_audit"](spark, str(tmp_path)).collect())


def documents():
    rnd = random.Random(5)
    long = " ".join(f"w{k}" for k in range(120))
    texts = ["", None, "SHOUT", "a | b", long, long + " #", long.upper(), "la " * 150, long, "x\x0bY\x85z " * 70, "\U0001d400 " * 101]
    docs = [(rnd.choice([None, k, k]), rnd.choice(texts), rnd.choice(["en", "de", None, ""]), 1, 2, "z") for k in range(160)]
    return docs + docs[:20] + [(3, long, "fr", 1, 1, "z"), (3, long, "en", 1, 1, "z")]


def test_equals_brute_force(spark, tmp_path):
    docs = documents()
    labels = [(k, k % 2, int(k % 5 == 0), "p") for k in range(0, 160, 3)] + [(6, 1, 1, "p"), (6, None, 0, "p"), (None, 1, 1, "p"), (9999, 1, 1, "p")]
    assert run(spark, tmp_path, docs, labels) == brute(docs, labels)


def test_empty_tables_and_very_long_text(spark, tmp_path):
    assert run(spark, tmp_path / "none", [], []) == []
    docs = [(1, "Ab# " * 400_000, "en", 1, 1, ""), (2, "Ab# " * 400_000, None, 1, 1, "")]
    assert run(spark, tmp_path / "long", docs, []) == brute(docs, [])


def test_survivors_of_every_subset(spark):
    counts = spark.createDataFrame([("p", m, 10**m, m) for m in range(8) if m != 5], "part string, mask int, n long, n_x long")
    row = filter_audit.survivors(counts, 3).first()
    for subset in range(8):
        assert row.n[subset] == sum(10**m for m in range(8) if m != 5 and not m & subset)
        assert row.n_x[subset] == sum(m for m in range(8) if m != 5 and not m & subset)


def test_own_filters_without_labels_or_copies(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "ab", "p"), (3, None, "q")], "doc_id int, text string, lang string")
    tests = {"s": F.length("text") < 2, "b": F.col("text").contains("b")}
    rows = {(r.part, r.step, r.filter_order): (r.kept, r.removed) for r in filter_audit.audit(docs, tests, orders=["sb"]).collect()}
    assert rows == {("p", 1, "sb"): (1, 1), ("p", 2, "sb"): (0, 1), ("q", 1, "sb"): (1, 0), ("q", 2, "sb"): (1, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, {"s": F.lit(True)}, "s")
