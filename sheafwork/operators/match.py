"""Which column is which field by rules: ranked candidates, then one pass that gives each header's fields away.

A candidate is a field that one of four steps proposes for a name: equal names, one name within the other, names of the
same kind, names with many characters in common. Candidates depend on names alone, so each distinct name has them once,
however many headers it is in. In a table of headers they come from joins by equality: within a name are its substrings
of the lengths that the other side has, and names alike share one of each other's rarest characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import names as n

# The steps in their order, and how sure a rule is.
EQUAL, WITHIN, SAME_KIND, ALIKE = range(4)
RULE_CONFIDENCE = 0.4
#: Steps that count only if they propose one free field, and steps whose field no later column gets.
ONLY_ALONE, TAKING = {WITHIN, SAME_KIND}, {EQUAL, WITHIN, SAME_KIND}


class Candidate(NamedTuple):
    """In the order of preference."""

    step: int
    less: float  # minus the likeness
    place: int
    field: str


def known_fields(fields: list[str]) -> list[tuple[int, str, str]]:
    """(place, field, normal name); of fields with one normal name the last, at the place of the first."""
    places: dict[str, int] = {}
    last: dict[str, str] = {}
    for k, field in enumerate(fields):
        key = n.normal_name_of(field)
        places.setdefault(key, k)
        last[key] = field
    return [(place, last[key], key) for key, place in places.items()]


def candidates_of(name: str, fields: list[tuple[int, str, str]]) -> list[Candidate]:
    """A name's candidates among few fields, compared with each."""
    key = n.normal_name_of(name)
    found = []
    for place, field, other in fields:
        if key == other:
            found.append(Candidate(EQUAL, 0.0, place, field))
        if key and (key in other or other in key):
            found.append(Candidate(WITHIN, 0.0, place, field))
        if n.is_group_of(key) and n.is_group_of(other):
            found.append(Candidate(SAME_KIND, 0.0, place, field))
        if (likeness := n.likeness_of(key, other)) >= n.LEAST_LIKENESS:
            found.append(Candidate(ALIKE, -likeness, place, field))
    return sorted(found)


def is_ignorable(name: str) -> bool:
    return re.match(n.IGNORABLE, n.normal_name_of(name), re.I) is not None


def assigned(columns: list[tuple[str, bool, list[Candidate]]]) -> list[str]:
    """The field of each (name, whether it is ignored, its candidates), in the header's order."""
    taken: set[str] = set()
    out = []
    for _, ignored, candidates in columns:
        free: dict[int, list[Candidate]] = {}
        for c in candidates:
            if c.field not in taken:
                free.setdefault(c.step, []).append(c)
        step = next((s for s in sorted(free) if s not in ONLY_ALONE or len(free[s]) == 1), None)
        chosen = n.IGNORE if ignored else n.UNKNOWN if step is None else free[step][0].field
        if chosen not in (n.IGNORE, n.UNKNOWN) and step in TAKING:
            taken.add(chosen)
        out.append(chosen)
    return out


# The same for a table of headers.

_NAME = "name string, key string, chars array<string>, n int, grouped boolean, ignored boolean"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        keys = [n.normal_name_of(x) for x in names]
        chars = [sorted(set(k)) if len(k) > 1 else [] for k in keys]  # shorter names are like none
        columns = [pa.array(names), pa.array(keys), pa.array(chars, pa.list_(pa.string())), pa.array([len(c) for c in chars], pa.int32())]
        columns += [pa.array([n.is_group_of(k) for k in keys]), pa.array([is_ignorable(x) for x in names])]
        yield pa.record_batch(columns, [x.split()[0] for x in _NAME.split(", ")])


def _substrings(key: Column, lengths: list[int]) -> Column:
    """The distinct substrings of these lengths."""
    of = lambda size: F.when(F.char_length(key) >= size, F.transform(F.sequence(F.lit(1), F.char_length(key) - size + 1), lambda k: F.substring(key, k, F.lit(size))))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(empty, *(F.coalesce(of(size), empty) for size in lengths if size > 0))))


def _lengths(keys: DataFrame, key: str) -> list[int]:
    return sorted(r[0] for r in keys.select(F.char_length(key)).distinct().collect())  # a row a length


def _rare_first(sets: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, chars, prefix): a name's characters by how rare they are; two sets of the least likeness share one of the
    first few, the prefix."""
    each = sets.select(key, F.explode("chars").alias("char")).join(counts, "char")
    chars = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("names", "char"))), lambda x: x["char"]).alias("chars"))
    size = F.size("chars")
    return chars.withColumn("prefix", F.slice("chars", 1, size - F.ceil(n.LEAST_LIKENESS * size - 1e-9).cast("int") + 1))


def alike_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, other, likeness) of the names of both sides (key, chars; other, chars) whose sets of characters are alike."""
    every = left.select("chars").unionByName(right.select("chars"))
    counts = every.select(F.explode("chars").alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("names"))
    one = _rare_first(left, counts, "key").select("key", "chars", F.explode("prefix").alias("char"))
    two = _rare_first(right, counts, "other").select("other", F.col("chars").alias("others"), F.explode("prefix").alias("char"))
    a, b = F.size("chars"), F.size("others")
    near = one.join(two, "char").where((a >= n.LEAST_LIKENESS * b - 1e-9) & (b >= n.LEAST_LIKENESS * a - 1e-9))
    shared = F.size(F.array_intersect("chars", "others"))
    pairs = near.select("key", "other", (shared / (a + b - shared)).alias("likeness")).where(F.col("likeness") >= n.LEAST_LIKENESS)
    return pairs.distinct()


def _assigned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for row in batch.to_pylist():
            columns = sorted(row["columns"], key=lambda c: c["pos"])
            kinds = [Candidate(SAME_KIND, 0.0, k, f) for k, f in sorted((x["place"], x["field"]) for x in row["kinds"])]
            given = [(c["source_col"], c["ignored"], sorted([Candidate(*x.values()) for x in c["found"] or ()] + (kinds if c["grouped"] else []))) for c in columns]
            for c, target in zip(columns, assigned(given)):
                for to, value in zip(out, (row["header"], c["pos"], c["source_col"], target)):
                    to.append(value)
        yield pa.record_batch([pa.array(out[0], batch.schema.field("header").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["header", "pos", "source_col", "target"])


def match_headers(columns: DataFrame, fields: list[str]) -> DataFrame:
    """(header, pos, source_col, target, confidence) of a table of headers (header, pos, source_col): what match_by_rules
    gives each of them. Rows of null header or name are left out; a header's columns meet in one row."""
    spark = columns.sparkSession
    given = columns.select("header", F.col("pos").cast("int").alias("pos"), "source_col").where("header IS NOT NULL AND source_col IS NOT NULL")
    described = given.select(F.col("source_col").alias("name")).distinct().mapInArrow(_described, _NAME).persist()
    rows = [(place, field, key, sorted(set(key)) if len(key) > 1 else [], n.is_group_of(key)) for place, field, key in known_fields(fields)]
    targets = spark.createDataFrame(rows, "place int, field string, other string, chars array<string>, grouped boolean")
    try:
        every_key = described.select("key", "chars").distinct()
        keys = every_key.where("key != ''")
        own, other = _lengths(keys, "key"), sorted({len(key) for _, _, key in known_fields(fields)})
    finally:
        described.unpersist()
    target = F.struct("place", "field")
    equal = every_key.join(targets.select(F.col("other").alias("key"), target.alias("t")), "key").select("key", F.lit(EQUAL).alias("step"), F.lit(0.0).alias("less"), "t")
    # Each pair once: names that are equal are within each other from the first side alone.
    inner = keys.select("key", F.explode(_substrings(F.col("key"), other)).alias("other")).join(targets.select("other", target.alias("t")), "other")
    outer = targets.select(F.explode(_substrings(F.col("other"), own)).alias("key"), "other", target.alias("t")).where("key != other").join(keys.select("key"), "key")
    blank = keys.select("key").join(targets.where("other = ''").select(target.alias("t")).hint("broadcast"))  # at most one field: it is within every name
    within = [x.select("key", F.lit(WITHIN).alias("step"), F.lit(0.0).alias("less"), "t") for x in (inner, outer, blank)]
    alike = alike_names(keys, targets.select("other", "chars")).join(targets.select("other", target.alias("t")), "other")
    alike = alike.select("key", F.lit(ALIKE).alias("step"), (-F.col("likeness")).alias("less"), "t")
    every = equal
    for part in (*within, alike):
        every = every.unionByName(part)
    found = every.groupBy("key").agg(F.collect_list(F.struct("step", "less", F.col("t.place").alias("place"), F.col("t.field").alias("field"))).alias("found"))
    names = described.join(found, "key", "left").select(F.col("name").alias("source_col"), "found", "grouped", "ignored")
    per_header = given.join(names, "source_col").groupBy("header").agg(F.collect_list(F.struct("pos", "source_col", "ignored", "grouped", "found")).alias("columns"))
    kinds = F.array(*(F.struct(F.lit(place).alias("place"), F.lit(field).alias("field")) for place, field, key in known_fields(fields) if n.is_group_of(key)))
    per_header = per_header.withColumn("kinds", kinds.cast("array<struct<place:int,field:string>>"))
    kind = columns.schema["header"].dataType.simpleString()
    out = per_header.mapInArrow(_assigned_rows, f"header {kind}, pos int, source_col string, target string")
    return out.withColumn("confidence", F.lit(RULE_CONFIDENCE))
