"""Token counts from an exact histogram of encoded lengths.

Documents are encoded whole and counted by length. Sums over the histogram's tail then answer, for every context limit,
how many documents and tokens there are, how many tokens stay when each document is cut at the limit, and which length
a share of the documents does not exceed. The histogram has a row for each length that occurs; its sums are taken in
two levels (within ranges of lengths, then over the ranges), so that no task sees more than a range. The ranges' own sums
meet in one task: they are at most as many as the longest document has tokens, divided by RANGE.

A null text counts as empty and has length 0. Texts are encoded whole. No result depends on an order, so there are no
ties. Repeated rows count each. An empty table has an empty histogram. Other
columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm import scratch
from sheafwork.llm.batches import parts

#: Lengths in a range of the two-level sums.
RANGE = 128


@lru_cache(maxsize=4)
def encoding(ranks_file: str, pattern: str):
    """A byte-level BPE from a file of ranks; texts hold no special tokens."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_length(text: Column, ranks_file: str, pattern: str) -> Column:
    """long: the number of tokens of a text."""

    @F.arrow_udf("long")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoding(ranks_file, pattern).encode_ordinary
        for batch in parts(texts):
            yield pa.array([len(encode(x.as_py() or "")) for x in batch], pa.int64())

    return run(text)


def length_histogram(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): the documents of each encoded length. It is stored, as sums read it more than once and texts
    are to be encoded once."""
    lengths = docs.select(token_length(F.col(text), ranks_file, pattern).alias("n_tokens"))
    return scratch.stored(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def with_tail_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: docs_from and tokens_from (documents of L tokens or more, and their tokens),
    tokens_total, tokens_cut (all tokens if every document is cut at L) and share_to (the share of documents of L
    tokens or fewer)."""
    rows = histogram.withColumn("_range", F.floor(F.col("n_tokens") / RANGE))
    ranges = rows.groupBy("_range").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(everything).alias("_all_docs"),
        F.sum("_tokens").over(everything).alias("tokens_total"),
    )
    tail = Window.partitionBy("_range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(ranges, "_range").select(
        "n_tokens",
        "n_docs",
        (F.col("_docs_after") + F.sum("n_docs").over(tail)).alias("docs_from"),
        (F.col("_tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(tail)).alias("tokens_from"),
        "tokens_total",
        "_all_docs",
    )
    cut = F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    share = (F.col("_all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_all_docs")
    return rows.select("n_tokens", "n_docs", "docs_from", "tokens_from", "tokens_total", cut.alias("tokens_cut"), share.alias("share_to"))


def at_limits(tail_sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_over and tokens_cut, from the first length above it."""
    wanted = tail_sums.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    above = tail_sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context_limit"))
    first = above.groupBy("context_limit").agg(F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("_at"))
    total = tail_sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens_total"))
    joined = F.broadcast(wanted).join(first, "context_limit", "left").crossJoin(F.broadcast(total))
    docs, tokens = F.coalesce("_at.docs_from", F.lit(0)), F.coalesce("_at.tokens_from", F.lit(0))
    return joined.select(
        "context_limit", docs.alias("docs_over"), (F.col("tokens_total") - tokens + F.col("context_limit") * docs).alias("tokens_cut"), "tokens_total"
    )


def quantiles(tail_sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents does not exceed."""
    wanted = tail_sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    reached = tail_sums.join(F.broadcast(wanted), F.col("share_to") >= F.col("share"))
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
