"""The first distinct values of many columns, with bounded state.

A value that is among a column's first N distinct ones is also among the first N of the task that holds its first row:
every value before it there is before it everywhere. So each task keeps N values a column and drops the one of largest
row for a new one, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Values that a task holds before it hands them on, whatever the number of columns.
HELD_VALUES = 500_000


def _kept(most: int, n_keys: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key the most values of least rows, as far as one task sees."""
    held: dict[tuple, dict[str, int]] = {}
    last: dict[tuple, int] = {}  # the largest row of a key whose values are complete
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(*key, row, value) for key, values in held.items() for value, row in values.items()]
        columns = list(zip(*flat)) if flat else [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, row, value in zip(zip(*columns[:n_keys]), columns[n_keys], columns[n_keys + 1]):
            if key in last and row > last[key]:
                continue
            values = held.setdefault(key, {})
            if value in values:
                if row < values[value]:
                    values[value] = row
            else:
                values[value] = row
                size += 1
                if len(values) > most:
                    del values[max(values, key=lambda v: (values[v], v))]
                    size -= 1
            if len(values) == most:
                last[key] = max(values.values())
        if size > HELD_VALUES:
            yield rows()
            held, last, size = {}, {}, 0
    yield rows()


def first_distinct(rows: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """(keys, values): the first most distinct values of each key by order (a number), of equal ones the least value
    first. Null values and orders don't count; keys without values have no row."""
    fields = [rows.schema[k] for k in keys] + [StructField("order", LongType()), StructField("value", StringType())]
    schema = StructType([StructField(f"k{k}" if k < len(keys) else f.name, f.dataType) for k, f in enumerate(fields)])
    named = [f"k{k}" for k in range(len(keys))]
    taken = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(order).cast("long").alias("order"), F.col(value).cast("string").alias("value"))
    taken = taken.where("value IS NOT NULL AND `order` IS NOT NULL")
    if most <= 0:
        taken, most = taken.where("false"), 1
    arrow, n = to_arrow_schema(schema), len(keys)
    kept = taken.mapInArrow(lambda batches: _kept(most, n, arrow, batches), schema)
    once = kept.groupBy(*named, "value").agg(F.min("order").alias("order"))
    place = F.row_number().over(Window.partitionBy(*named).orderBy("order", "value"))
    first = once.withColumn("place", place).where(F.col("place") <= most)
    found = first.groupBy(*named).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    return found.select(*(F.col(n).alias(k) for n, k in zip(named, keys)), "values")
