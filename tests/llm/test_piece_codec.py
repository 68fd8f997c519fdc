import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheafwork.llm import piece_codec

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def own():
    return piece_codec.PieceCodec(FILE)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "\n\n", "a\nb c\r\n", "▁x ▁▁y", "<s></s><unk><0x41>", "日本語 🙂é\x00�", "the" * 3000, "x" * 70 + " " + "y" * 70])
def test_special_texts(own, model, text):
    packed = own.encode(text)
    assert ids(packed) == model.encode(text, add_bos=True, add_eos=True)
    assert own.decode(packed) == model.decode(ids(packed))


def test_random_texts_and_ids(own, model):
    r = random.Random(11)
    normal = [p for p in own.pieces if len(p) > 1 and p[0] != "<"]
    for _ in range(3000):
        if r.random() < 0.5:
            text = "".join(r.choice("abcdeghinorst éßñ\n▁日🙂'") for _ in range(r.randint(0, 50)))
        else:
            text = "".join(r.choice(normal) for _ in range(r.randint(1, 6))).replace("▁", " ")
        assert ids(own.encode(text)) == model.encode(text, add_bos=True, add_eos=True)
        some = [r.choice([0, 1, 2, 3 + r.randrange(256), 28705, r.randrange(32000)]) for _ in range(r.randint(0, 9))]
        assert own.decode(np.array(some, "<u4").tobytes()) == model.decode(some)


def test_without_begin_and_end(own, model):
    assert ids(own.encode("hello there", False, False)) == model.encode("hello there")
    assert ids(own.encode(None, False, False)) == []
    assert own.decode(None) == ""


def test_query_against_the_library(spark, model):
    d = "/root/testdata/sf0.001"
    rows = entry.queries()["op9_sentencepiece"](spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = model.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(want).encode()).hexdigest()


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, ids string")
    got = docs.select("doc_id", piece_codec.n_ids(piece_codec.encode_ids(F.col("text"), FILE)).alias("n")).collect()
    assert [(r.doc_id, r.n) for r in got] == [(1, 4), (1, 4), (None, 2), (2, 2)]
    assert docs.where("false").select(piece_codec.encode_ids(F.col("text"), FILE)).count() == 0
