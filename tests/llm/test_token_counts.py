import public_tokenizers
from collections import Counter

import __spark_entry__ as entry
from sheafwork.llm import token_counts as t

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = entry.queries()["op3_token_counts"](spark, d).collect()
    encode = t.encoding(FILE, public_tokenizers.PATTERN).encode_ordinary
    lengths = [len(encode(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    count = Counter(lengths)
    assert {r.n_tokens: r.n_docs for r in rows} == count
    for r in rows:
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.tokens_total == sum(lengths)
        assert r.tokens_cut == sum(min(x, r.n_tokens) for x in lengths)
        assert abs(r.share_to - sum(x <= r.n_tokens for x in lengths) / len(lengths)) < 1e-12


def test_limits_and_quantiles_across_ranges(spark):
    lengths = [0, 0, 5, 4095, 4096, 4097, 9000, 9000, 20000]
    histogram = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    sums = t.with_tail_sums(histogram)
    for r in t.at_limits(sums, [0, 5, 4096, 9000, 50000]).collect():
        assert r.docs_over == sum(x > r.context_limit for x in lengths)
        assert r.tokens_cut == sum(min(x, r.context_limit) for x in lengths)
    got = {r.share: r.n_tokens for r in t.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert got == {0.1: 0, 0.5: 4096, 1.0: 20000}


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "x"), ("", "x"), ("a", "x"), ("a", "x")], "text string, n_tokens string")
    got = {r.n_tokens: r.n_docs for r in t.length_histogram(docs, FILE, public_tokenizers.PATTERN).collect()}
    assert got == {0: 2, 1: 2}
    none = t.with_tail_sums(t.length_histogram(docs.where("false"), FILE, public_tokenizers.PATTERN))
    assert none.count() == 0
    assert [r.tokens_cut for r in t.at_limits(none, [7]).collect()] == [0]
