"""Exact top-k search by inner product with KD-trees per shard.

Vectors of whole numbers are dealt to shards of bounded size by where they are: the upper levels of a KD-tree, medians of
a sample of SAMPLE_ROWS rows, part the space into cells, and each cell is one shard or, by the hash of the id, several.
In each shard a KD-tree halves the rows at the median of the widest side; every node has the tight bounding box of its
rows. Queries come in blocks of neighbouring cells. A query goes through a tree best-first by the largest inner product
that a node's box allows, and stops at the first node whose bound is under its k-th best score so far; nodes at the
bound are still opened, for ties. Each block first goes to the shard whose box allows it most. The k-th scores found
there are propagated: to any other shard only those queries of a block are sent that can reach their k-th score in its
box, so that on grouped vectors most pairs of block and shard never meet.

Every block of queries meets the box of every shard of its dimension: this is the stated query set against all rows, in blocks.
Results are exact. Scores that leave the range of a long are cut to it before they are ranked.

Trees move once; blocks of queries stream past the tree that a task holds. Vectors of any length are compared whole; a
shard's bytes grow with it. Rows whose id or vector is null, or whose vector holds a null, take no part. Of rows that repeat an id, the one with the
greatest vector counts (for candidates and queries alike). A query's candidates are the rows of its dimension with other
ids; if there are fewer than k, all are returned. Ties go to the smaller id. Empty tables give no rows. Other columns
aren't read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from sheafwork.llm import scratch
from sheafwork.llm.batches import parts

#: Rows in a shard, queries in a block, rows in a leaf.
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LEAF_ROWS = 256
#: Rows that the upper levels of the tree are learned from, and the most such levels; all rows are dealt by them.
SAMPLE_ROWS, MOST_LEVELS, LEAST_SAMPLE = 16384, 10, 16
#: Boxes of shards that blocks meet at once. Boxes of up to so many bytes, and up to so many cells, go to every executor.
BOXES = 512
BOX_BYTES, FEW_CELLS = 16 << 20, 100_000
#: Whole numbers that a double, and a float, holds exactly.
_EXACT, _EXACT_32 = 1 << 53, 1 << 24
_LONG = (-(1 << 63), (1 << 63) - 1)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest signed type."""
    if not values.size:
        return values.astype(np.int8)
    low, high = int(values.min()), int(values.max())
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind)


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """ids and vectors in leaf order, and the nodes: first and past row, left child (the right one follows it; -1 for a
    leaf), box."""
    order = np.argsort(ids, kind="stable")
    first, past, left, low, high = [], [], [], [], []

    def node(a: int, b: int) -> int:
        rows = vectors[order[a:b]]
        first.append(a), past.append(b), left.append(-1), low.append(rows.min(axis=0)), high.append(rows.max(axis=0))
        return len(first) - 1

    waiting = [node(0, len(ids))] if len(ids) else []
    while waiting:
        k = waiting.pop()
        a, b = first[k], past[k]
        if b - a <= leaf_rows or vectors.shape[1] == 0:
            continue
        side = int(np.argmax(high[k].astype(np.float64) - low[k]))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(vectors[order[a:b], side], middle)]
        left[k] = node(a, a + middle)
        node(a + middle, b)
        waiting += [left[k], left[k] + 1]
    boxes = [np.array(x).reshape(len(first), vectors.shape[1]) for x in (low, high)]
    nodes = np.array([first, past, left], np.int64)
    return {"ids": ids[order], "vectors": _narrow(vectors[order]), "nodes": nodes, "low": boxes[0], "high": boxes[1]}


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, as float64 where that is exact, else as whole numbers of any size."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    most = max(abs(int(queries.min())), abs(int(queries.max()))) * max(abs(int(rows.min())), abs(int(rows.max()))) * queries.shape[1]
    kind = np.float64 if most < _EXACT else object
    return queries.astype(kind) @ rows.astype(kind).T


def search(
    tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, least: list, k: int, opened: list[int] | None = None
) -> Iterator[tuple[int, list, list]]:
    """For each query its best ids and scores in a tree, of those with a score of least (None: any) or more. opened
    gets the number of leaves that each query opens."""
    if not len(tree["ids"]):
        return
    ids, nodes = tree["ids"], tree["nodes"]
    vectors = tree["vectors"]
    upper = _products(np.maximum(queries, 0), tree["high"]) + _products(np.minimum(queries, 0), tree["low"])
    biggest = (int(np.abs(vectors.astype(np.float64)).max()) if vectors.size else 0) * (int(np.abs(queries.astype(np.float64)).max()) if queries.size else 0)
    biggest *= max(1, vectors.shape[1])
    exact = upper.dtype != object and biggest < _EXACT
    kind = np.float32 if biggest < _EXACT_32 else np.float64 if exact else object
    if kind not in tree:
        tree[kind] = vectors.astype(kind)  # once a tree, for all blocks of queries
    rows, wanted, places = tree[kind], queries.astype(kind), nodes.T.tolist()

    def merged(found_ids: list, found: list) -> tuple[np.ndarray, np.ndarray]:
        all_ids, scores = np.concatenate(found_ids), np.concatenate(found)
        order = np.lexsort((all_ids, -scores))[:k] if exact else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], all_ids[i]))[:k], int)
        return all_ids[order], scores[order]

    for at, own in enumerate(query_ids):
        bound, query = upper[at].tolist(), wanted[at]
        floor, n_leaves, waiting = least[at], 0, 0
        found_ids, found = [np.empty(0, np.int64)], [np.empty(0, rows.dtype)]
        heap = [(-bound[0], 0)]
        while heap:
            over, node = heapq.heappop(heap)
            if floor is not None and -over < floor:
                break
            a, b, child = places[node]
            if child >= 0:
                heapq.heappush(heap, (-bound[child], child))
                heapq.heappush(heap, (-bound[child + 1], child + 1))
                continue
            n_leaves += 1
            scores = rows[a:b] @ query
            if not exact:
                scores = np.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in scores], object)
            good = np.flatnonzero(scores >= floor) if floor is not None else np.arange(b - a)
            good = good[ids[a:b][good] != own] if len(good) else good
            if not len(good):
                continue
            found_ids.append(ids[a:b][good]), found.append(scores[good])
            waiting += len(good)
            if waiting >= k:  # ranked k at a time; until then, the floor is only lower than it could be
                best_ids, best = merged(found_ids, found)
                found_ids, found, waiting = [best_ids], [best], 0
                if len(best) == k:
                    floor = best[-1] if floor is None else max(floor, best[-1])
        if opened is not None:
            opened.append(n_leaves)
        best_ids, best = merged(found_ids, found)
        yield at, best_ids.tolist(), [int(x) for x in best]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector, size): one row an id, without nulls."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("vector"))
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    return rows.where(whole).groupBy("id").agg(F.max("vector").alias("vector")).withColumn("size", F.size("vector"))


def _matrix(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    chunks = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    flat = np.concatenate([np.asarray(c.flatten()) for c in chunks]) if size else np.empty(0, np.int64)
    return flat.astype(np.int64).reshape(sum(map(len, chunks)), size)


def fit_cells(vectors: np.ndarray, levels: int) -> tuple[list[int], list[int]]:
    """A complete tree of so many levels, in level order: each node's widest side and the lower median there, up to
    which rows go left."""
    sides, values, places = [], [], [np.arange(len(vectors))]
    for _ in range(levels):
        below = []
        for at in places:
            rows = vectors[at]
            side = int(np.argmax(rows.max(axis=0).astype(np.float64) - rows.min(axis=0))) if len(at) else 0
            value = int(np.sort(rows[:, side])[(len(at) - 1) // 2]) if len(at) else 0
            right = rows[:, side] > value
            sides.append(side), values.append(value)
            below += [at[~right], at[right]]
        places = below
    return sides, values


def cells_of(vectors: np.ndarray, sides: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The leaf of each row in a complete tree, from left to right."""
    node, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for level in range(len(sides).bit_length()):
        at = node + (1 << level) - 1
        node = 2 * node + (vectors[rows, sides[at]] > values[at])
    return node


def _fitted(rows: DataFrame, shard_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tree of each dimension that has rows for more than one shard. At most a sixteenth as many nodes as the sample
    has rows come to the driver."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))

    def run(table: pa.Table) -> pa.Table:
        size, n = table.column("size")[0].as_py(), table.num_rows
        levels = min(MOST_LEVELS, int(math.log2(max(1.0, n / share / shard_rows))), int(math.log2(max(1.0, n / LEAST_SAMPLE)))) if size else 0
        found = [fit_cells(_matrix(table.column("vector"), size), levels)] if levels else []
        return pa.table(
            {"size": pa.array([size] * len(found), pa.int32()), "sides": pa.array([x for x, _ in found], pa.list_(pa.int32())), "values": pa.array([x for _, x in found], pa.list_(pa.int64()))}
        )

    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.groupBy("size").applyInArrow(run, "size int, sides array<int>, values array<long>").collect()
    return {r["size"]: (np.array(r["sides"]), np.array(r["values"], np.int64)) for r in found}


def _placed(rows: DataFrame, trees: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with their cell, 0 in dimensions without a tree."""
    if not trees:
        return rows.withColumn("cell", F.lit(0).cast("long"))

    @F.arrow_udf(T.LongType())
    def cell(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts(vectors, 4096):
            sizes, out = np.asarray(batch.value_lengths()), np.zeros(len(batch), np.int64)
            for size in set(sizes.tolist()) & set(trees):
                at = np.flatnonzero(sizes == size)
                out[at] = cells_of(_matrix(batch.take(pa.array(at)), size), *trees[size])
            yield pa.array(out, pa.int64())

    return rows.withColumn("cell", cell("vector"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], small: bool) -> DataFrame:
    """An equality join; right goes to every executor if it is small, else what it meets in left may be split."""
    return left.join(F.broadcast(right) if small else right.hint("rebalance"), on)


def _dealt(rows: DataFrame, trees: dict[int, tuple[np.ndarray, np.ndarray]], name: str, most: int, whole: bool) -> DataFrame:
    """rows numbered, from 0 in each dimension, into parts of about so many: whole, a part is of one cell, else of
    neighbouring cells."""
    placed = _placed(rows, trees)
    before = Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 2^MOST_LEVELS rows at most
    counts = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("parts", F.ceil(F.col("n") / (1.25 * most)))
    counts = counts.withColumn("base", F.coalesce(F.sum("parts" if whole else "n").over(before), F.lit(0)))
    deal = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1 << 30)).cast("long")
    number = F.col("base") + deal % F.col("parts") if whole else F.floor((F.col("base") + deal / float(1 << 30) * F.col("n")) / most)
    counts = scratch.stored(counts, "cells")
    return _joined(placed, counts, ["size", "cell"], counts.count() <= FEW_CELLS).select("size", "id", "vector", number.cast("long").alias(name))


def _packs(dealt: DataFrame, name: str, pack) -> DataFrame:  # noqa: ANN001
    """(size, name, data, box): each part packed, with the box of its tree if it has one."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        data = pack(table.column("id").to_numpy(), _matrix(table.column("vector"), size))
        box = _packed(low=_narrow(data["low"][:1]), high=_narrow(data["high"][:1])) if "low" in data else None
        return pa.table(
            {"size": pa.array([size], pa.int32()), name: pa.array([table.column(name)[0].as_py()], pa.int64()), "data": pa.array([_packed(**data)], pa.binary()), "box": pa.array([box], pa.binary())}
        )

    return scratch.stored(dealt.groupBy("size", name).applyInArrow(run, f"size int, {name} long, data binary, box binary"), name)


def _allowed(queries: np.ndarray, boxes: list[bytes]) -> np.ndarray:
    """The most that each box allows each query."""
    found = [_unpacked(b) for b in boxes]
    low, high = (np.concatenate([f[x] for f in found]) for x in ("low", "high"))
    return _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)


def _homes(met: DataFrame) -> DataFrame:
    """(size, block, shard): of each block, the shard whose box allows its queries most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                sums = _allowed(_unpacked(row["data"])["vectors"].astype(np.int64), [b["box"] for b in row["boxes"]]).sum(axis=0)
                best = int(np.argmax(sums))
                yield pa.RecordBatch.from_pylist(
                    [{"size": row["size"], "block": row["block"], "shard": row["boxes"][best]["shard"], "allowed": float(sums[best])}],
                    pa.schema([("size", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("allowed", pa.float64())]),
                )

    found = met.mapInArrow(run, "size int, block long, shard long, allowed double")
    return found.groupBy("size", "block").agg(F.max(F.struct("allowed", "shard"))["shard"].alias("shard"))


def _sent(met: DataFrame) -> DataFrame:
    """(size, shard, block, data, least): of each block and shard, the queries that can reach their k-th score so far in
    the shard's box, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("least", pa.list_(pa.int64()))])
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                queries, least = _unpacked(row["data"]), row["least"]
                allowed = _allowed(queries["vectors"].astype(np.int64), [b["box"] for b in row["boxes"]])
                # Scores are cut to a long: a floor there tells of no score below it.
                floors = np.array([-math.inf if x is None or x == _LONG[0] else x for x in least], object)
                for k, box in enumerate(row["boxes"]):
                    at = np.flatnonzero([bool(a >= f) for a, f in zip(allowed[:, k].tolist(), floors)])
                    if len(at):
                        data = _packed(ids=queries["ids"][at], vectors=queries["vectors"][at])
                        out = {"size": row["size"], "shard": box["shard"], "block": row["block"], "data": data, "least": [least[x] for x in at]}
                        yield pa.RecordBatch.from_pylist([out], schema)

    return met.mapInArrow(run, "size int, shard long, block long, data binary, least array<long>")


def _met(shards: DataFrame, blocks: DataFrame, k: int, floors: bool) -> DataFrame:
    """Search shards (size, shard, data) for the blocks sent to them (size, shard, block, data, least), from the floors
    so far if there are any. Each tree moves once a lane and is unpacked once, the blocks of its lane stream past it;
    there are lanes only as far as shards are fewer than tasks. With floors not yet known, the result is each block's
    (size, block, least); else (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for part in (batch.slice(at, 1) for at in range(batch.num_rows)):
                row = part.to_pylist()[0]
                if row["block"] < 0:  # sorted before the blocks of its shard
                    tree = _unpacked(row["data"])
                    continue
                queries = _unpacked(row["data"])
                least = row["least"] if floors else [None] * len(queries["ids"])
                out, bounds = ([], [], []), [None] * len(queries["ids"])
                for at, ids, scores in search(tree, queries["ids"], queries["vectors"].astype(np.int64), least, k):
                    if floors:
                        out[0].extend([int(queries["ids"][at])] * len(ids)), out[1].extend(ids), out[2].extend(scores)
                    elif len(scores) == k:
                        bounds[at] = scores[-1]
                if floors:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["size"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([bounds], pa.list_(pa.int64()))],
                        ["size", "block", "least"],
                    )

    schema = "query_id long, vec_id long, score long" if floors else "size int, block long, least array<long>"
    spark = shards.sparkSession
    n_shards, tasks = max(1, shards.count()), 2 * spark.sparkContext.defaultParallelism
    lanes = -(-tasks // n_shards)
    none = F.lit(None).cast("array<long>").alias("least")
    trees = shards.select("size", "shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("block"), "data", none)
    sent = blocks.select("size", "shard", F.pmod("block", F.lit(lanes)).cast("int").alias("lane"), "block", "data", "least" if floors else none)
    # Shards and lanes are numbered: hashes of so few would leave some tasks without.
    place = F.pmod(F.col("shard") * lanes + F.col("lane") + F.col("size"), F.lit(max(tasks, n_shards * lanes))).cast("int")
    rows = trees.unionByName(sent).withColumn("place", place)
    dealt = rows.repartitionById(max(tasks, n_shards * lanes), F.col("place"))
    return dealt.sortWithinPartitions("size", "shard", "lane", "block").drop("place").mapInArrow(run, schema)


def packed(candidates: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """The shards (size, shard, data, box) of candidates and the blocks (size, block, data) of queries."""
    rows = scratch.stored(usable(candidates, vec_id, vector), "vectors")
    asked = scratch.stored(usable(queries, vec_id, vector), "queries")
    trees = _fitted(rows, SHARD_ROWS)
    shards = _packs(_dealt(rows, trees, "shard", SHARD_ROWS, True), "shard", build_tree)
    blocks = _packs(_dealt(asked, trees, "block", BLOCK_QUERIES, False), "block", lambda ids, v: {"ids": ids, "vectors": _narrow(v)})
    return shards, blocks.drop("box")


def reached(shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(size, shard, block, data, least): what of each block has to be searched for in which shards."""
    group = F.floor(F.col("shard") / BOXES).alias("group")
    boxes = scratch.stored(shards.groupBy("size", group).agg(F.collect_list(F.struct("shard", "box")).alias("boxes")), "boxes")
    small = (shards.agg(F.sum(F.length("box"))).first()[0] or 0) <= BOX_BYTES
    met = _joined(blocks, boxes, ["size"], small).select("size", "block", "data", "boxes")
    home = blocks.join(_homes(met), ["size", "block"])
    least = scratch.stored(_met(shards, home, k, False), "floors")
    return _sent(met.join(least, ["size", "block"]))


def top_k(candidates: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner products with each query, rank from 1.
    Both tables have an id and an array of whole numbers."""
    shards, blocks = packed(candidates, queries, vec_id, vector)
    sent = reached(shards, blocks, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = _met(shards, sent, k, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
