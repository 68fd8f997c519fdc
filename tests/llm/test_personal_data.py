import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheafwork.llm import personal_data as p


def digits_of(x):
    return [int(c) for c in x if c in "0123456789"]


def plain_base(text):
    """The contract's patterns as they stand."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits_of(m[0])[::-1]
        if 12 <= len(d) <= 19 and sum(d[0::2] + [x // 5 + 2 * x % 10 for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], p.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def model(spark):
    return p.trained(spark)


def said(text, model):
    return [(k, text[s:e]) for k, s, e, base in p.all_spans(text, model) if not base]


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f.g @x.y a@@b.c a@b a.b@c.d.", "1.2.3.4.5.6.7.8 001.0000255.0.0 256.1.1.1 1..2.3.4 9" * 2, "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111",
        "+1 (017) 555-7713 +49 (0)30 123456 +1+1+123456789 ++12 345 678 9) +1", "٣٤٥٦٧٨٩٠١٢٣٤ ｘ@ｙ.ｚ x@y.zé 1 2",
    ],
)
def test_base_equals_the_patterns(text):
    assert sorted(p.base_spans(text), key=lambda s: (s[1], p.KINDS.index(s[0]))) == plain_base(text)


def test_base_equals_the_patterns_on_random_text():
    rnd = random.Random(2)
    for _ in range(6000):
        text = "".join(rnd.choice("111223405699.+-@  ()abZé%") for _ in range(rnd.randint(1, 60)))
        assert sorted(p.base_spans(text), key=lambda s: (s[1], p.KINDS.index(s[0]))) == plain_base(text), text


@pytest.mark.parametrize(
    "text, found",
    [
        ("please call (663) 555-6869 now", [("phone", "(663) 555-6869")]),
        ("que en 7536784127813050 4845168114407329 le la", [("card", "7536784127813050"), ("card", "4845168114407329")]),
        ("write to bob [at] mail dot org today", [("email", "bob [at] mail dot org")]),
        ("von müller@beispiel7.de kam", [("email", "müller@beispiel7.de")]),
        ("IBAN: DE89 3704 0044 0532 0130 00 bitte", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("her SSN 223-45-6789 is", [("national_id", "223-45-6789")]),
        ("host 2001:db8::1 is up", [("ip", "2001:db8::1")]),
        ("le +1 (826) 555-4081 190.137.223.204 et", [("phone", "+1 (826) 555-4081")]),
    ],
)
def test_spans_beyond_the_base(model, text, found):
    assert said(text, model) == found


@pytest.mark.parametrize(
    "text",
    [
        "on 2024-01-05 10:11:12 it was 1234 5678 9012 3456 of 12 34 56 78", "look at me. Then meet at noon.today", "ISBN 978-3-16148-410-0 costs $1,234,567.89", "version 4.10.2 of 1990-2015",
        "DE00 3704 0044 0532 0130 00", "std::vector<int> a::b", "order 123-456-7890", "und 9007915762804491 la", "",
    ],
)
def test_clean_text_stays_clean(model, text):
    assert said(text, model) == []


def test_held_out_lines(spark, model):
    """On lines of another seed."""
    hits = wrong = missed = 0
    for k in range(1500):
        text, truth = p.labelled_line(random.Random(f"other:{k}"))
        base = set(p.base_spans(text))
        found = {s[:3] for s in p.all_spans(text, model) if not s[3]}
        truth = {t for t in truth if not any(b[1] <= t[1] and t[2] <= b[2] for b in base)}
        hits, wrong, missed = hits + len(found & truth), wrong + len(found - truth), missed + len(truth - found)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.85


def test_arrays_score_as_the_trained_trees(spark):
    rows = p.training_rows(spark, 600).withColumn("x", array_to_vector("features"))
    fit = GBTClassifier(featuresCol="x", labelCol="label", maxIter=5, maxDepth=p.DEPTH, seed=1).fit(rows)
    want = fit.transform(rows).select("features", "probability").collect()
    scores = p.as_arrays(fit, p.DEPTH).scores(np.array([r["features"] for r in want]))
    assert np.allclose(scores, [r["probability"][1] for r in want])


def test_threshold():
    scores, labels = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.4]), np.array([1.0, 1, 0, 1, 1, 1])
    assert p.threshold(scores, labels, 1.0) == 0.9
    assert p.threshold(scores[:5], labels[:5], 0.75) == 0.6
    assert p.threshold(scores, labels, 0.5) == p.LEAST_SCORE
    assert p.threshold(scores, 0 * labels, 0.5) == float("inf") == p.threshold(scores[:0], labels[:0], 0.5)


def test_query_equals_plain_scan(spark, tmp_path, model):
    texts = ["a.b@c.de call (663) 555-6869", None, "", "7536784127813050 4845168114407329", "\U0001d400 1.2.3.4 +1 (826) 555-4081 190.137.2.2", "x" * 9, "4111111111111111"]
    rows = [(k, t, "e", 1, 0) for k, t in enumerate(texts)] + [(None, texts[0], None, 1, 0), (0, texts[0], "e", 1, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, entry.queries()["op11_personal_data"](spark, str(tmp_path)).collect()), key=str)
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    want = []
    for doc_id, text, *_ in rows:
        base = plain_base(text)
        counts = [sum(s[0] == k for s in base) for k in p.BASE_KINDS]
        want.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(s[:3] for s in p.all_spans(text, model))))
    assert found == sorted(want, key=str)
    assert any(set(w[6].split(",")) - {joined([s]) for s in plain_base(r[1])} - {""} for w, r in zip(want, rows))


def test_empty_table_and_clashing_columns(spark, model):
    docs = spark.createDataFrame([(1, "x (663) 555-6869", "was")], "doc_id int, text string, personal_spans string")
    row = p.scan(docs, model).first()
    assert [tuple(s) for s in row["personal_spans"]] == [("phone", 2, 16, False)]
    assert p.redact(docs, model).first()["text"] == "x [PHONE]"
    assert p.scan(docs.where("false"), model).count() == 0 == p.redact(docs.where("false"), model).count()
    assert p.redact(docs.select(F.lit(None).cast("string").alias("text")), model).first()["text"] is None


@pytest.mark.parametrize("text", ["1" * 400_000, "1." * 200_000, "a" * 400_000 + "@", "a@" * 200_000, "+1" * 200_000, "12 34 " * 5_000, " at " * 100_000, "f:" * 200_000, "x@y.z " * 30_000 + "1" * 5])
def test_very_long_texts_are_linear(model, text):
    began = time.time()
    p.all_spans(text, model)
    assert time.time() - began < 8
