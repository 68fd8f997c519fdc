"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import scratch

#: Rows up to which a table with one row a key goes to every executor.
BROADCAST_ROWS = 250_000


def joined(many: DataFrame, few: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a stored table of one row a key. It goes to every executor if it is small; else both sides are shuffled
    by nothing but this join, so that adaptive execution splits the rows of a key that many have."""
    return many.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key, how)


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the least value of each one's key. The minimum is formed in every task before it is shuffled, and
    stored, so that the join can split a hub's rows."""
    return joined(rows, scratch.stored(rows.groupBy(key).agg(F.min(value).alias(name)), "least"), key)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another: component is its least reachable node.

    Large-star and small-star steps alternate until nothing changes: each node's neighbours are hung under its least
    one. A step is a minimum by node and a join with it (with_least), so no node's neighbours are gathered. The tables
    between steps are written to the shared folder. Null ends and loops are left out; an empty table has no nodes."""
    least, most = F.least(a, b), F.greatest(a, b)
    both_ends = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now = scratch.stored(edges.where(both_ends).select(most.alias("u"), least.alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(scratch.stored(large, "large-star"), "u", "v", "m")
        hung = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.stored(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
