from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from sheafwork.llm import near_dup, secret_scan
from test_decontam import plain as plain_contamination
from test_near_dup import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r.text for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    groups = plain_groups(list(kept.items()), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    kept = {i: t for i, t in kept.items() if not plain_contamination(t, items, 13)[3]}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: model.encode(secret_scan._redact(t, "[SECRET]"), add_bos=True, add_eos=True) for i, t in kept.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) < len(rows)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want
    assert all(r.n_tokens == len(want[r.doc_id]) for r in got)


def test_odd_rows_and_extra_columns(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, text, "en", "s", 9, 1.0), (1, text, "en", "s", 9, 1.0), (2, None, None, None, None, None), (3, "", "en", "s", 0, 1.0), (4, "12 34", None, "s", 5, 2.0)]
    rows += [(None, "Another one of those texts, without any number at all", "en", "s", 53, None), (5, "token=abcdefghijklmnop stays here", "en", "s", 33, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
    out = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=repr)
    assert out == sorted([(1, text, 9), (None, "Another one of those texts, without any number at all", 53), (5, "[SECRET] stays here", 19)], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


CLASHING = ["fold", "label", "lang_pred", "lang_score", "redacted", "_before", "_id", "_version", "_predicted", "predicted", "id", "version", "term", "row"]


def test_clashing_columns_pass_unharmed(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, text, "en", 63), (2, text + " and token=abcdefghijklmnop too", "en", 9), (3, None, None, None), (4, "Another text about rivers", "en", 25)]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in CLASHING)) for r in rows], f"doc_id long, text string, lang string, n_chars long, {names}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "n_chars", *CLASHING], name
    out = {r.doc_id: r for r in docs.collect()}
    assert set(out) == {1, 2, 4} and "[SECRET] too" in out[2].text and out[2].n_chars == len(out[2].text)
    assert all(out[i][c] == f"{c} {i}" for i in out for c in CLASHING)
    assert {r.doc_id for r in corpus_pipeline.encode(spark, docs, SF).collect()} == {1, 2, 4}


def test_first_stage_rejects_other_scripts_and_learns_from_the_other_fold(spark, monkeypatch):
    rows = [(i, f"The river and the sea number {i} are the same", "en") for i in range(40)]
    rows += [(100 + i, "Der Fluss und die See sind das eine und nicht das andere", "de") for i in range(40)]
    rows += [(200, "Всё это написано другими буквами", "en"), (201, "Всё это, но без метки", None), (202, "The sea, without a label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.keep_identified(spark, docs, SF).collect()}
    assert kept == {r[0] for r in rows} - {200, 201}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en",))
    assert {r.doc_id for r in corpus_pipeline.keep_identified(spark, docs, SF).collect()} == {*range(40), 202}
