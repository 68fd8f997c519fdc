"""Near-duplicate documents by circulant MinHash, banding and exact verification.

1. A document's set is its distinct word shingles (words are runs without white space, A-Z lower-cased; a text of fewer
   words is one shingle; one without words is an empty set, linked with nothing). Shingles are 64-bit hashes.
2. Documents of one set are one class, for which its least doc_id stands; only these go on.
3. Two permutations give the whole signature: shingles are dealt to places by the first; coordinate k is the least value
   of the second, shifted circularly by k, at those places. Bands of coordinates are hashed; bands and rows follow from
   the threshold, so that a pair at the threshold shares no band with a chance of at most MISS.
4. In each bucket every class is tied to the bucket's least one, unless a sketch of one bit a coordinate puts the two
   below SKETCH_LEAST, far under the threshold (so that chance meetings don't chain groups). A bucket with such a class
   goes on without its least one, to the next, so that any two of its classes are tied to one of the bucket, or tested
   against each other. After ROUNDS, what is left is tied without the test.
5. Ties form clusters, and within a cluster all pairs are compared on their full sets: in one task if it is small. Of a
   large one, a few representatives are compared with all others first; the largest group that this links is settled,
   and only what is left is compared with everything, by pairs of blocks of bounded size, leaving out blocks whose sizes
   are too different for a link. A task tells only a spanning forest of the links that it finds.
6. The links' components are the groups. Pairs of different sets are never expanded into rows, and no bucket or cluster
   is cut.

A null doc_id names no class: its row takes the group of its set, or none (component_id null, kept true). Rows that
share a doc_id count as versions of one document. Repeated rows each get their result. Texts are read whole, whatever
their length; a signature is formed in pieces. Of equal sets the least doc_id stands for all, so there are no ties. An
empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm import graph, scratch
from sheafwork.llm.batches import parts

#: Chance that a pair at the threshold meets in no band, and the most coordinates of a signature.
MISS = 1e-7
MOST_HASHES = 512
#: Places that the permutations act on.
PLACES = 1 << 20
SKETCH_BITS = 256
SKETCH_LEAST = 0.35
#: Documents and shingles in a block of a cluster that one task compares with another block.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 250_000
#: Rounds in which a bucket's classes are tested by their sketches.
ROUNDS = 4
#: Documents of a large cluster that all others are compared with first.
REPRESENTATIVES = 4
#: Rows up to which the clustered documents' ids go to every executor.
BROADCAST_ROWS = 250_000
_COLUMNS = 4096
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def band_plan(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold: the most rows for which enough bands fit into the signature."""
    best = (math.ceil(math.log(MISS) / math.log(1 - percent / 100)) if percent < 100 else 1, 1)
    for rows in range(1, 65):
        meet = (percent / 100) ** rows
        bands = 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log(1 - meet))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(33))) * _M3
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    count = len(found) - size + 1
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = mixed * _M1 + hashes[k : count + k]
    return np.unique(_mixed(mixed))


@lru_cache(maxsize=2)
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of the second: row p holds the values at p, p + 1, ... around the circle."""
    random = np.random.Generator(np.random.PCG64(20240229))
    first, second = random.permutation(PLACES).astype(np.int32), random.permutation(PLACES).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[: hashes - 1])), hashes)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The circulant MinHash signature of a set that isn't empty."""
    first, windows = _permutations(hashes)
    places = first[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    out = np.full(hashes, PLACES, np.int32)
    for at in range(0, len(places), 2048):
        np.minimum(out, windows[places[at : at + 2048]].min(axis=0), out=out)
    return out


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = sign[: bands * rows].reshape(bands, rows).astype(np.uint64)
    mixed = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        mixed = _mixed(mixed * _M1 + values[:, k])
    return mixed.view(np.int64)


def sets_and_bands(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, k0..k3): of each row, its set's size, key, band hashes and one-bit sketch."""
    bands, rows = band_plan(percent)
    hashes = max(bands * rows, SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts([whole]):
                sizes, keys, bucket, sketch = [], [], [], []
                for text in batch.column(1):
                    found = shingle_set(text.as_py(), words)
                    sizes.append(len(found))
                    if not len(found):
                        keys.append(None), bucket.append(None), sketch.append((None,) * 4)
                        continue
                    sign = signature(found, hashes)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bucket.append(band_hashes(sign, bands, rows))
                    sketch.append(np.packbits((sign[:SKETCH_BITS] & 1).astype(np.uint8)).view("<i8").tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bucket, pa.list_(pa.int64())),
                        *(pa.array([s[k] for s in sketch], pa.int64()) for k in range(4)),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "k0", "k1", "k2", "k3"],
                )

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, k0 long, k1 long, k2 long, k3 long"
    return docs.mapInArrow(run, schema)


def ties(classes: DataFrame) -> DataFrame:
    """(a, b): classes that share a bucket, tied to the bucket's least whose sketch agrees enough."""
    rows = classes.select(F.col("doc_id").alias("a"), F.explode("bands").alias("bucket"))
    sketch = [f"k{k}" for k in range(4)]
    one = classes.select(F.col("doc_id").alias("a"), *(F.col(k).alias(f"a{k}") for k in sketch))
    two = classes.select(F.col("doc_id").alias("b"), *(F.col(k).alias(f"b{k}") for k in sketch))
    unlike = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in sketch), F.lit(0))
    alike = 1 - 2 * unlike / SKETCH_BITS >= SKETCH_LEAST  # two bits agree by chance half the time
    out = []
    for k in range(ROUNDS + 1):
        buckets = rows.groupBy("bucket").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b < last").select("bucket", "b")
        met = scratch.stored(graph.joined(rows, scratch.stored(buckets, "buckets"), "bucket").where("a != b").select("a", "b", "bucket"), "met")
        pairs = met.select("a", "b").distinct()
        if k == ROUNDS:
            out.append(pairs)
            break
        # A bucket's least class has a pair with each other one.
        heads = scratch.stored(two.join(met.select("b").distinct(), "b"), "heads")
        tested = scratch.stored(graph.joined(pairs.join(one, "a"), heads, "b").select("a", "b", alike.alias("alike")), "tested")
        out.append(tested.where("alike").select("a", "b"))
        apart = tested.where("NOT alike").select("a", "b")
        if apart.isEmpty():
            break
        again = scratch.stored(met.join(apart, ["a", "b"], "left_semi").select("bucket").distinct(), "buckets-again")
        rows = scratch.stored(graph.joined(met.select("a", "bucket"), again, "bucket"), "again")
    return reduce(DataFrame.unionByName, out)


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")


def _sized(clusters: DataFrame) -> DataFrame:
    """clusters with the number of blocks that each one's cluster has."""
    totals = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    return graph.joined(clusters, scratch.stored(totals.select("cluster", _blocks().alias("blocks")), "cluster-sizes"), "cluster")


def first_comparisons(clusters: DataFrame) -> DataFrame:
    """(doc_id, task, side): the tasks that compare representatives (side 1) with all documents (side 2) of the clusters
    of more than one block. A document is in one task, a representative in each of its cluster's."""
    large = _sized(clusters).where("blocks > 1")
    order = Window.partitionBy("cluster").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= REPRESENTATIVES)

    def task(part: str) -> Column:
        return F.xxhash64("cluster", F.lit(-1), F.col(part).cast("int")).alias("task")

    parts_ = few.select("doc_id", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    whole = large.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")))
    return parts_.select("doc_id", task("part"), F.lit(1).alias("side")).unionByName(whole.select("doc_id", task("part"), F.lit(2).alias("side")))


def settled(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """clusters with settled: whether a document is in the largest group (ties: the least) of its cluster that the links
    join; links in it need not be looked for."""
    groups = scratch.stored(graph.components(found).select(F.col("node").alias("doc_id"), "component"), "first-groups")
    own = clusters.join(groups, "doc_id")
    sizes = own.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("of"))
    largest = scratch.stored(largest.select("cluster", (-F.col("of.c")).alias("largest")), "largest-groups")
    marked = graph.joined(clusters.join(groups, "doc_id", "left"), largest, "cluster", "left")
    return marked.select("doc_id", "n_shingles", "cluster", F.coalesce(F.col("component") == F.col("largest"), F.lit(False)).alias("settled"))


def comparisons(clusters: DataFrame, percent: int) -> DataFrame:
    """(doc_id, task, side): which tasks compare a class, and whether within a block (0) or as one of two (1 and 2).
    clusters: (doc_id, n_shingles, cluster), and settled if there are documents not to be compared with each other."""
    step = math.log(100 / percent) * 1.001 if percent < 100 else 1.0
    sized = _sized(clusters if "settled" in clusters.columns else clusters.withColumn("settled", F.lit(False)))
    small = sized.where("blocks = 1").select("doc_id", F.xxhash64("cluster").alias("task"), F.lit(0).alias("side"))
    large = sized.where("blocks > 1").select("doc_id", "n_shingles", "cluster", "settled", F.floor(F.log("n_shingles") / step).alias("level"))
    levels = large.groupBy("cluster", "level", "settled").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("settled") == kind, _blocks())), F.lit(0))
    levels = levels.groupBy("cluster", "level").agg(of(False).alias("open"), of(True).alias("done"))
    levels = scratch.stored(levels, "levels")

    def near(by: int, name: str) -> DataFrame:
        there = levels.select("cluster", (F.col("level") - by).alias("level"), F.col("open").alias(f"{name}_open"), F.col("done").alias(f"{name}_done"))
        return scratch.stored(there, "levels-near")

    dealt = large
    for by, name in ((0, "same"), (1, "above"), (-1, "below")):
        dealt = graph.joined(dealt, near(by, name), ["cluster", "level"], "left")
    done = F.col("settled")
    own = F.pmod(F.xxhash64("doc_id"), F.when(done, F.col("same_done")).otherwise(F.col("same_open")))
    dealt = dealt.withColumn("block", own.cast("int"))

    def numbers(count: str) -> Column:
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    def task(a: tuple, b: tuple, side):  # noqa: ANN001, ANN202  a, b: level, whether settled, block
        return F.struct(F.xxhash64("cluster", *a, *b).alias("task"), side.alias("side"))

    level, block, yes, no = F.col("level"), F.col("block"), F.lit(True), F.lit(False)
    here = (level, done, block)
    among = F.transform(
        numbers("same_open"),
        lambda x: task((level, no, F.least(x, block)), (level, no, F.greatest(x, block)), F.when(x == block, 0).when(x > block, 1).otherwise(2)),
    )
    with_done = [
        F.transform(numbers("same_done"), lambda x: task(here, (level, yes, x), F.lit(1))),
        F.transform(numbers("above_done"), lambda x: task(here, (level + 1, yes, x), F.lit(1))),
        F.transform(numbers("below_done"), lambda x: task((level - 1, yes, x), here, F.lit(2))),
    ]
    with_open = [
        F.transform(numbers("above_open"), lambda x: task(here, (level + 1, no, x), F.lit(1))),
        F.transform(numbers("below_open"), lambda x: task((level - 1, no, x), here, F.lit(2))),
    ]
    of_done = F.transform(numbers("same_open"), lambda x: task((level, no, x), here, F.lit(2)))
    at = F.when(done, F.concat(of_done, *with_open)).otherwise(F.concat(among, *with_done, *with_open))
    spread = dealt.select("doc_id", F.explode(at).alias("at")).select("doc_id", "at.task", "at.side")
    return small.unionByName(spread)


def _forest(pairs: Iterator[tuple[int, int]], ids: list[int]) -> list[tuple[int, int]]:
    """Of the linked pairs, those that join what isn't joined yet."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            if ids[i] != ids[j]:
                kept.append((ids[i], ids[j]))
    return kept


def linked(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of side 0, and between those of sides 1 and 2."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        apart = {*sides} == {1} or {*sides} == {2}
        return _forest(iter([(0, 1)]), ids) if not apart and 100 * shared >= percent * (sizes.sum() - shared) else []
    left = np.array([k for k, s in enumerate(sides) if s < 2], np.int64)
    right = np.array([k for k, s in enumerate(sides) if s != 1], np.int64)
    if not len(left) or not len(right):
        return []
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = count >= 2
    column = np.cumsum(common) - 1
    inside = common[place]
    owner, column = owner[inside], column[place[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        grid = np.zeros((len(sets), _COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        shared += grid[left] @ grid[right].T
    shared = np.rint(shared).astype(np.int64)
    whole = sizes[left][:, None] + sizes[right][None, :] - shared
    hits = np.argwhere(100 * shared >= percent * whole)
    return _forest(((int(left[i]), int(right[j])) for i, j in hits if left[i] != right[j]), ids)


def links(docs: DataFrame, tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between classes, confirmed on their full sets, enough of them to join each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sides, sets = None, [], [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for t, i, s, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if t != task:
                    if len(ids) > 1:
                        found += linked(ids, sides, sets, percent)
                    task, ids, sides, sets = t, [], [], []
                shingles = shingle_set(text.as_py(), words)
                if len(shingles):
                    ids.append(i), sides.append(s), sets.append(shingles)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in range(2)], ["a", "b"])
            found = []
        if len(ids) > 1:
            found = linked(ids, sides, sets, percent)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in range(2)], ["a", "b"])

    if tasks.count() <= BROADCAST_ROWS:
        tasks = F.broadcast(tasks)
    dealt = docs.join(tasks, "doc_id").select("task", "doc_id", "side", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links are 100 * intersection >= percent * union."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.stored(sets_and_bands(docs, words, percent), "sets")
    named = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    whole = F.struct("doc_id", "n_shingles", "bands", "k0", "k1", "k2", "k3")
    classes = scratch.stored(named.groupBy("set_key").agg(F.min(whole).alias("of")).select("set_key", "of.*"), "classes")
    clusters = graph.components(ties(classes)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    clusters = clusters.join(classes.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    clusters = scratch.stored(clusters, "clusters")
    found = clusters.sparkSession.createDataFrame([], "a long, b long")
    first = scratch.stored(first_comparisons(clusters), "first-tasks")
    if not first.isEmpty():
        found = scratch.stored(links(docs, first, words, percent), "first-links")
        clusters = scratch.stored(settled(clusters, found), "settled")
    tasks = scratch.stored(comparisons(clusters, percent), "tasks")
    found = found.unionByName(scratch.stored(links(docs, tasks, words, percent), "links"))
    groups = graph.components(found).select(F.col("node").alias("doc_id"), F.col("component"))
    group = F.coalesce("component", "doc_id").alias("component_id")
    of_set = classes.select("set_key", "doc_id").join(groups, "doc_id", "left").select("set_key", group)
    out = rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: of its least doc_id; of rows that repeat that doc_id, one stays. Rows
    without a doc_id all stay."""
    result = scratch.stored(near_duplicates(docs, words, percent), "near-duplicates")
    dropped = result.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    repeated = scratch.stored(result.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    dropped = scratch.stored(dropped, "dropped")
    if dropped.count() <= 4 * BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    stay = docs.join(dropped, "doc_id", "left_anti")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(repeated, "doc_id", "left_anti").unionByName(once)
