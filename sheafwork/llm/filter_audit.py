"""Interaction audit of document filters by a subset-zeta transform.

Each row's failing filters are the bits of a mask. Rows are counted once by part and mask; a zeta transform over the
lattice of subsets (one step a filter) turns the counts into the rows that pass every filter of a subset, for every
subset. Whatever an order of filters does at a step is then a difference between two neighbouring subsets: what the step
removes, what it leaves, what labelled rows it loses, and a filter's removals over all orders.

One filter may be table-wide: it fails rows whose text is identical to that of a row of smaller id. Its bit is formed
from one row a distinct text (SHA-256 of the text), so copies meet only as counts, however many there are.

A null text counts as empty, a null part as the empty string, a null test as passed. A row of null id is no copy and has
none, and has no labels. Repeated rows (equal ids) are no copies of each other and each count. Of several labels of an id
one that says yes is enough. Texts are taken whole, whatever their length. An empty table gives no rows. Other columns,
of any name, are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import scratch

#: Filters up to which all orders are formed (720); beyond it, orders must be given.
MOST_ORDERED = 6


def _bits(tests: Mapping[str, Column]) -> Column:
    mask = F.lit(0)
    for k, failed in enumerate(tests.values()):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(0))
    return mask


def _one_label_row(labels: DataFrame | None, marks: Mapping[str, Column], id: str) -> DataFrame | None:
    if labels is None or not marks:
        return None
    said = labels.select(F.col(f"`{id}`").alias("id"), *(F.coalesce(c, F.lit(False)).alias(f"m_{x}") for x, c in marks.items()))
    return said.where("id IS NOT NULL").groupBy("id").agg(*(F.max(f"m_{x}").alias(f"m_{x}") for x in marks))


def mask_counts(
    docs: DataFrame,
    tests: Mapping[str, Column],
    duplicate: str | None = None,
    part: str = "lang",
    labels: DataFrame | None = None,
    marks: Mapping[str, Column] | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(part, mask, n, n_<mark>...): rows by part and failing filters. tests are columns of docs, bit k the k-th; the
    filter named duplicate, if any, has the bit behind them. marks are columns of labels, which has the id too."""
    marks = dict(marks or {})
    body, names = F.coalesce(F.col(f"`{text}`"), F.lit("")), [f"m_{x}" for x in marks]
    rows = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        _bits(tests).alias("mask"),
        (F.unhex(F.sha2(body, 256)) if duplicate else F.lit(None).cast("binary")).alias("digest"),
    )
    said = _one_label_row(labels, marks, id)
    known = rows.where("id IS NOT NULL")
    known = known.join(said, "id", "left") if said is not None else known.select("*", *(F.lit(False).alias(m) for m in names))
    known = known.select("id", "part", "mask", "digest", *(F.coalesce(m, F.lit(False)).alias(m) for m in names))
    nameless = rows.where("id IS NULL").select("id", "part", "mask", "digest", *(F.lit(False).alias(m) for m in names))
    # Both are counted before they meet: the join has dealt the first by id, so this shuffles nothing.
    keys = ["id", "part", "mask", "digest", *names]
    counted = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).unionByName(nameless.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    if duplicate:
        counted, bit = scratch.stored(counted, "filter-masks"), 1 << len(tests)
        failing = counted.withColumn("mask", F.when(F.col("id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(bit))))
        # A text's first rows pass after all. Those of one id differ at most by part, so a list of parts is bounded.
        parts = counted.where("id IS NOT NULL").groupBy("digest", "id", "mask", *names).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
        first = parts.groupBy("digest").agg(F.min(F.struct("id", "mask", *names, "parts")).alias("first"))
        first = first.select("first.mask", *(F.col(f"first.{m}").alias(m) for m in names), F.explode("first.parts").alias("p"))
        first = first.select(F.col("p.part").alias("part"), "mask", *names, F.col("p.n").alias("n"))
        taken = first.withColumn("n", -F.col("n")).withColumn("mask", F.col("mask").bitwiseOR(F.lit(bit)))
        keep = ["part", "mask", *names, "n"]
        counted = failing.select(keep).unionByName(first.select(keep)).unionByName(taken.select(keep))
    sums = [F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(f"n_{x}") for x, m in zip(marks, names)]
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """(part, and for each count column an array of 2^filters longs): element S is the sum over the masks that share no
    bit with S, which is what passes every filter of S. The zeta transform sums over the subsets of a mask, a bit at a
    time; what passes S are the subsets of S's complement."""
    names = [c for c in counts.columns if c not in ("part", "mask")]
    full = (1 << filters) - 1
    packed = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("by_mask"))
    index = F.sequence(F.lit(0), F.lit(full))
    counted = lambda c: F.transform(index, lambda i: F.coalesce(F.element_at("by_mask", i).getField(c), F.lit(0).cast("long")))
    zeta = packed.select("part", *(counted(c).alias(c) for c in names))
    for k in range(filters):

        def step(c: str, bit: int = 1 << k) -> Column:
            below = lambda i: F.element_at(c, (i - bit + 1).cast("int"))
            return F.transform(c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + below(i)).otherwise(x))

        zeta = zeta.select("part", *(step(c).alias(c) for c in names))
    return zeta.select("part", *(F.reverse(c).alias(c) for c in names))  # the complement of S is full - S


def order_steps(passing: DataFrame, filters: str, orders: Sequence[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost..., shapley): a row for each part,
    order of the one-letter filters and step of it. passing is survivors' table, whose columns are n and n_<mark>."""
    if orders is None:
        if len(filters) > MOST_ORDERED:
            raise ValueError(f"name the orders of more than {MOST_ORDERED} filters")
        orders = ["".join(p) for p in permutations(filters)]
    size, full = len(filters), (1 << len(filters)) - 1
    marks = [c for c in passing.columns if c.startswith("n_")]

    def at(c: str, subset: Column | int) -> Column:
        subset = F.lit(subset) if isinstance(subset, int) else subset
        return F.element_at(F.col(c), (subset + 1).cast("int"))

    def over_all_orders(k: int) -> Column:
        """Removals by filter k, summed over all orders: a subset comes before it in |S|! (size - 1 - |S|)! of them."""
        total = F.lit(0).cast("long")
        for subset in range(full + 1):
            if not subset >> k & 1:
                weight = factorial(subset.bit_count()) * factorial(size - 1 - subset.bit_count())
                total = total + weight * (at("n", subset) - at("n", subset | 1 << k))
        return total

    by_filter = passing.select(
        "part",
        "n",
        *marks,
        F.array(*(at("n", 0) - at("n", 1 << k) for k in range(size))).alias("fails"),
        F.array(*(at("n", full & ~(1 << k)) - at("n", full) for k in range(size))).alias("alone"),
        F.array(*(over_all_orders(k) for k in range(size))).alias("shapley"),
    )
    steps = by_filter.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter != ''")
    place = lambda letter: (F.instr(F.lit(filters), letter) - 1).cast("int")
    earlier = F.split(F.substring("filter_order", F.lit(1), F.col("at")), "")
    before = F.aggregate(
        F.filter(earlier, lambda x: x != ""), F.lit(0), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), place(x)))
    )
    steps = steps.withColumn("before", before).withColumn("k", place(F.col("letter")))
    steps = steps.withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("k"))))
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    of = lambda c: F.element_at(F.col(c), F.col("k") + 1)
    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        at("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (of("fails") - lost("n")).alias("redundant"),
        of("alone").alias("unique_fails"),
        *(lost(m).alias(f"{m[2:]}_lost") for m in marks),
        of("shapley").alias("shapley"),
    )


def audit(
    docs: DataFrame,
    tests: Mapping[str, Column],
    duplicate: str | None = None,
    labels: DataFrame | None = None,
    marks: Mapping[str, Column] | None = None,
    orders: Sequence[str] | None = None,
    part: str = "lang",
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """What each filter does at each step of each order, by part (order_steps). Filters have names of one letter."""
    filters = "".join(tests) + (duplicate or "")
    if len(set(filters)) != len(tests) + bool(duplicate):
        raise ValueError("filters need different names of one letter")
    counts = mask_counts(docs, tests, duplicate, part, labels, marks, id, text)
    return order_steps(survivors(counts, len(filters)), filters, orders)
