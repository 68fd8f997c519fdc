import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from sheafwork.llm import language_id as l


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    s = f" {' '.join(words)} " if words else ""
    return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " ")


def key(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_top(count, size):
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], key(x[0])))[:size]]


@pytest.mark.parametrize("text", ["", "12 34", "Ünïcode words, and 日本語 ß İ ſ", "a", "the theory " * 9000 + "zz"])
def test_counts_equal_the_plain_ones(text):
    grams, counts = l.gram_counts(l.letter_codes(text))
    assert dict(zip(grams.tolist(), counts.tolist())) == {key(g): n for g, n in plain_grams(text).items()}


def test_pieces_join(monkeypatch):
    monkeypatch.setattr(l, "_PIECE", 7)
    text = "one two three four one two three"
    grams, counts = l.gram_counts(l.letter_codes(text))
    assert dict(zip(grams.tolist(), counts.tolist())) == {key(g): n for g, n in plain_grams(text).items()}


def test_query_against_brute_force_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    counts = defaultdict(Counter)
    for r in docs:
        if r.lang is not None and not held[r.doc_id]:
            counts[r.lang].update(plain_grams(r.text))
    profiles = {k: {g: i for i, g in enumerate(plain_top(c, l.PROFILE_SIZE))} for k, c in counts.items()}
    got = {r.doc_id: r for r in entry.queries()["op7_language_id"](spark, d).collect()}
    assert len(got) == len(docs)
    right = []
    for r in docs:
        own = plain_top(plain_grams(r.text), l.DOCUMENT_SIZE)
        far = {k: sum(min(abs(p[g] - i), l.PROFILE_SIZE) if g in p else l.PROFILE_SIZE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got[r.doc_id].held_out == held[r.doc_id]
        assert got[r.doc_id].lang_pred == (best if own else "und")
        assert abs(got[r.doc_id].score - (1 - far[best] / (l.PROFILE_SIZE * len(own)) if own else 0)) < 1e-9
        if held[r.doc_id]:
            right.append(got[r.doc_id].lang_pred == r.lang)
    assert np.mean(right) > 0.97


def test_texts_are_counted_apart_and_odd_rows(spark):
    rows = [("ab", "x"), ("ba", "x"), (None, "x"), ("12", "x"), ("cd", None), ("", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r.label, r.gram) for r in l.learn(docs).collect()}
    assert got == {("x", key(g)) for g in ["a", "b", " a", "ab", "b ", " ab", "ab ", " b", "ba", "a ", " ba", "ba "]}
    profiles = l.collect_profiles(l.learn(docs))
    odd = spark.createDataFrame([(1, None, "q"), (1, None, "q"), (2, "!?", None), (None, "ab", "z")], "doc_id long, text string, score string")
    out = [(r.doc_id, r.lang_pred, r.score > 0.5) for r in l.identify(odd, profiles).collect()]
    assert out == [(1, "und", False), (1, "und", False), (2, "und", False), (None, "x", True)]
    nothing = l.collect_profiles(l.learn(docs.where("false")))
    assert {r.lang_pred for r in l.identify(odd, nothing).collect()} == {"und"}
    assert l.identify(odd.where("false"), profiles).count() == 0


def test_more_languages_than_go_to_executors(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, None, "q"), (7, "!?", None), (8, "Всё", None)], docs.schema)).withColumnRenamed("lang", "row")
    profiles = l.learn(docs, label="row")
    few, many = l.collect_profiles(profiles), None
    monkeypatch.setattr(l, "MAX_LANGUAGES", 1)
    many = l.collect_profiles(profiles)
    assert isinstance(many, l.ProfileTable)
    rows = lambda p: sorted((repr((r.doc_id, r.text, r.row, r.lang_pred, round(r.score, 9))) for r in l.identify(docs, p).collect()))
    assert rows(many) == rows(few) and len(rows(few)) == 63


def test_each_task_keeps_its_first_n_grams_only(spark):
    docs = spark.createDataFrame([("ab", "x")], "text string, lang string")
    assert "WindowGroupLimit" in l.learn(docs)._jdf.queryExecution().toString()
