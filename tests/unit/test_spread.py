"""Rows of one large sheet stay spread over the tasks."""

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import align, headers
from sheafwork.plans.consolidate import Engine, Settings

ROWS = 4000


@pytest.fixture
def big(spark):
    """No table is small and partitions aren't put together, as with many rows."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def grid(spark, partitions):
    text = lambda x: F.struct(F.lit("s").alias("kind"), x.cast("string").alias("text"))
    cells = F.when(F.col("id") == 0, F.array(text(F.lit("单位")), text(F.lit("姓名")))).otherwise(F.array(text(F.concat(F.lit("学院"), F.col("id") % 7)), text(F.concat(F.lit("Name "), F.col("id")))))
    return spark.range(0, ROWS, 1, partitions).select(F.when(F.col("id") >= 0, "a.csv").alias("file"), F.lit("Sheet1").alias("sheet"), (F.col("id") + 1).cast("int").alias("row_no"), cells.alias("cells"))


def most_of_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_a_sheet_stay_where_they_are_read(big):
    _, rows = headers.recovered(grid(big, 8))
    assert rows.count() == ROWS - 1 and most_of_a_task(rows) <= ROWS // 8


def test_rows_of_a_sheet_that_one_task_reads_are_spread(big):
    result = Engine(big, Settings(this_year=2026)).from_grids(grid(big, 1))
    assert result.records.count() == ROWS - 1 and most_of_a_task(result.records) < ROWS // 2
    result.close()


def test_samples_are_counted_without_meeting_in_a_row(big):
    sheets, rows = headers.recovered(grid(big, 8))
    whole = {r.name: r.samples for r in headers.column_samples(sheets, rows).collect()}
    some = headers.counted_samples(sheets, rows, 5)
    assert {r.name: (r.n, r.samples) for r in some.collect()} == {name: (len(x), x[:5]) for name, x in whole.items()}
    assert {r.name: r.n for r in some.collect()} == {"单位": 7, "姓名": ROWS - 1}
    fields = big.createDataFrame([("姓名",)], "field string")
    assert [tuple(r) for r in align.field_samples(some, fields).collect()] == [("姓名", ROWS - 1, whole["姓名"][:5])]
