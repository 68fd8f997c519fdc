"""Whole-column kinds, cleaning by kind, and an audit of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import cleaning as c

PROVENANCE = ("src_file", "src_sheet", "src_row", "src_order")


def _number(cell: Column) -> Column:
    return F.when(cell["kind"].isin("n", "s"), c.parse_number(cell["plain"], normalized=True))


def _date(cell: Column, this_year: int | None) -> Column:
    """Numbers are serials only, other values may be written in any form."""
    return F.when(cell["kind"] == "n", c.from_excel_serial(cell["text"].try_cast("double"))).when(
        cell["kind"].isin("d", "s"), c.parse_date(cell["plain"], this_year, normalized=True)
    )


def _empty(cell: Column, markers: tuple[str, ...]) -> Column:
    return cell.isNull() | ((cell["kind"] == "s") & c.is_empty(cell["plain"], markers, normalized=True)) | cell["text"].isNull()


def column_kinds(records: DataFrame, fields: list[str], markers: tuple[str, ...] = c.EMPTY_MARKERS, this_year: int | None = None) -> dict[str, str]:
    """number, date or text for each place of records.values, by all its filled values: one that doesn't fit makes it
    text; nothing filled is text. One aggregate for all fields."""
    seen, tests = [], []
    for k in range(len(fields)):
        cell = F.col("values")[k]
        seen += [(~_empty(cell, markers)).alias(f"filled_{k}"), _number(cell).alias(f"number_{k}"), _date(cell, this_year).isNotNull().alias(f"date_{k}")]
        filled, number = F.col(f"filled_{k}"), F.col(f"number_{k}")
        tests += [
            F.count_if(filled).alias(f"filled_{k}"),
            F.count_if(filled & number.isNotNull()).alias(f"number_{k}"),
            F.count_if(filled & F.col(f"date_{k}")).alias(f"date_{k}"),
            F.count_if(filled & (number != F.floor(number))).alias(f"parts_{k}"),
        ]
    row = records.select(*seen).agg(*tests).first()
    kinds = {}
    for k, name in enumerate(fields):
        filled = row[f"filled_{k}"]
        whole = "number" if row[f"parts_{k}"] else "integer"
        kinds[name] = "text" if not filled else whole if row[f"number_{k}"] == filled else "date" if row[f"date_{k}"] == filled else "text"
    return kinds


def cleaned(
    records: DataFrame, fields: list[str], kinds: dict[str, str], markers: tuple[str, ...] = c.EMPTY_MARKERS, this_year: int | None = None
) -> DataFrame:
    """One column a field (integer: decimal(38,0), so that long ids stay whole; number: double; date; text) with
    src_file, src_sheet, src_row and src_order, the place in reading order."""
    out: list[Column] = []
    for k, name in enumerate(fields):
        cell = F.col("values")[k]
        plain = {
            "integer": lambda x: _number(x).cast("decimal(38,0)"),
            "number": lambda x: _number(x).cast("double"),
            "date": lambda x: _date(x, this_year),
            "text": lambda x: F.when(x["kind"] == "s", c.clean_text(x["plain"], markers, normalized=True)).otherwise(x["text"]),
        }[kinds[name]]
        out.append(F.when(~_empty(cell, markers), plain(cell)).alias(name))
    sheet = F.when(F.col("sheet").isin("Sheet1", "Sheet"), "").otherwise(F.col("sheet"))
    order = F.struct("file_order", "row_no").alias("src_order")
    return records.select(*out, F.col("file").alias("src_file"), sheet.alias("src_sheet"), F.col("row_no").alias("src_row"), order)


def audit(records: DataFrame, fields: list[str], kinds: dict[str, str], markers: tuple[str, ...] = c.EMPTY_MARKERS, this_year: int | None = None) -> DataFrame:
    """(src_file, src_sheet, src_row, field, before, after): numbers and dates whose writing has changed. Dates that were
    dates already aren't told."""
    places = [(k, name) for k, name in enumerate(fields) if kinds[name] != "text"]
    if not places:
        return records.where("false").select(
            F.col("file").alias("src_file"), F.col("sheet").alias("src_sheet"), F.col("row_no").alias("src_row"), *(F.lit("").alias(x) for x in ("field", "before", "after"))
        )
    # What is parsed becomes columns first, so that no value is parsed twice.
    parsed = []
    for k, name in places:
        cell = F.col("values")[k]
        after = F.date_format(_date(cell, this_year), "yyyy-MM-dd") if kinds[name] == "date" else c.pretty_number(_number(cell))
        number = c.pretty_number(_number(cell)) if kinds[name] == "date" else F.lit(None)
        parsed += [
            F.when(~_empty(cell, markers) & (cell["kind"] != "d"), after).alias(f"after_{k}"), F.when(cell["kind"] == "n", number).alias(f"number_{k}"),
            cell["text"].alias(f"text_{k}"), cell["kind"].alias(f"kind_{k}"),
        ]
    rows, found = records.select("file", "sheet", "row_no", *parsed), []
    for k, name in places:
        after = F.col(f"after_{k}")
        as_number = F.col(f"number_{k}") if kinds[name] == "date" else after
        before = F.when(F.col(f"kind_{k}") == "n", as_number).otherwise(F.trim(f"text_{k}"))
        found.append(F.when(before != after, F.struct(F.lit(name).alias("field"), F.col(f"text_{k}").alias("before"), after.alias("after"))))
    rows = rows.select("file", "sheet", "row_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return rows.select(F.col("file").alias("src_file"), F.col("sheet").alias("src_sheet"), F.col("row_no").alias("src_row"), "x.field", "x.before", "x.after")
