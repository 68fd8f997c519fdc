"""From raw grids to relations: trimming, header detection, flattened names, total rows, samples.

A grid is a table (file, sheet, row_no, cells array<struct<kind, text>>): every row of a sheet, blank ones too, kind one
of n (number), d (date, as ISO text), b (boolean) and s (text); an empty cell is null. All sheets of all files are worked
on at once, split by file and sheet; only a sheet's first rows are ever brought together, for its header. What is known
of a sheet is one row of the size of its header; it goes to every executor, so that a sheet's rows stay where they are
read, however many it has, and never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.operators.first_distinct import first_distinct

CELL = "struct<kind:string,text:string>"
GRID = f"file string, sheet string, row_no int, cells array<{CELL}>"

# Words that headers have, words that mark totals, group names that say nothing, and where a unit is named.
HEADER_HINTS = (
    "单位", "部门", "学院", "名称", "序号", "编号", "姓名", "学号", "工号", "数量", "人数", "金额", "合计", "小计", "总计", "日期", "时间", "备注", "电话", "手机", "地址", "专业", "年级", "班级",
    "性别", "比例", "招生", "毕业", "就业", "教师", "学生", "经费", "预算", "面积", "类型", "状态", "说明", "内容", "项目", "指标", "得分", "结果",
)
TOTAL_MARKERS = ("合计", "总计", "小计", "共计", "累计", "总和", "汇总")
GENERIC_GROUPS = (
    "基本信息", "基本情况", "基础信息", "教学情况", "其他", "其它", "备注", "说明", "补充", "详细", "相关", "情况", "信息", "具体",
)
UNIT_PATTERN = r"(?:填报单位|报送单位|单位名称|二级单位|所在学院|院系|部门|单位)\s*[：:]\s*(\S{2,30})"
TITLE_ENDINGS = r"(情况)?(统计)?(汇总)?(填)?(报)?(申)?(表|报表|清单|一览表|统计表)\s*$"
JOINER = "·"
SCAN_ROWS = 10
KEYS = ["file", "sheet"]


def is_blank(cell: Column) -> Column:
    return cell.isNull() | cell["text"].isNull() | ~cell["text"].rlike(r"[^\s　]")


def _text(cell: Column) -> Column:
    return F.regexp_replace(cell["text"], r"^[\s　]+|[\s　]+$", "")


def looks_like_number(cell: Column) -> Column:
    return (cell["kind"] == "n") | ((cell["kind"] == "s") & _text(cell).rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"))


def looks_like_date(cell: Column) -> Column:
    pattern = r"^[0-9]{4}\s*[-/年.]\s*[0-9]{1,2}\s*[-/月.]\s*[0-9]{1,2}\s*日?$"
    return (cell["kind"] == "d") | ((cell["kind"] == "s") & _text(cell).rlike(pattern))


def looks_like_text(cell: Column) -> Column:
    """A title or name: a text that is no date and no number, with or without separators and percent sign."""
    figures = _text(cell).rlike(r"^[-+]?[0-9,，\s]*(\.[0-9]+)?%?$") & _text(cell).rlike("[0-9]")
    return (cell["kind"] == "s") & ~is_blank(cell) & ~looks_like_date(cell) & ~figures


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~is_blank(c))


def _count(cells: Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(cells, test))


def header_score(cells: Column, below: Column) -> Column:
    """How much a row is like a header: wide, of text, without repeats, with header words, above data. -1 if blank."""
    values = _filled(cells)
    n = F.size(values)
    hinted = _count(values, lambda c: (c["kind"] == "s") & c["text"].rlike("|".join(HEADER_HINTS)))
    under = _filled(F.coalesce(below, F.array().cast(f"array<{CELL}>")))
    data = _count(under, lambda c: looks_like_number(c) | looks_like_date(c))
    score = (
        F.least(n, F.lit(15))
        + F.try_divide(_count(values, looks_like_text), n) * 12
        + F.try_divide(F.size(F.array_distinct(F.transform(values, _text))), n) * 4
        + F.least(hinted, F.lit(6)) * 1.5
        - F.try_divide(_count(values, looks_like_number), n) * 8
        - F.try_divide(_count(values, looks_like_date), n) * 6
        + F.coalesce(F.try_divide(data, F.size(under)) * 8, F.lit(0.0))
    )
    return F.when(n == 0, F.lit(-1.0)).otherwise(score)


def trimmed(grid: DataFrame) -> DataFrame:
    """Without blank rows before the first and after the last filled row, and without blank columns; row numbers stay.
    Adds at, the row's place in the trimmed grid."""
    filled = grid.select(*KEYS, "row_no", F.posexplode("cells").alias("place", "cell")).where(~is_blank(F.col("cell")))
    columns = filled.groupBy(*KEYS, "place").agg(F.min("row_no").alias("first"), F.max("row_no").alias("last"))
    extent = columns.groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sort_array(F.collect_list("place")).alias("places"))
    rows = grid.join(F.broadcast(extent), KEYS).where(F.col("row_no").between(F.col("first"), F.col("last")))
    cells = F.transform("places", lambda p: F.get("cells", p))
    return rows.select(*KEYS, "row_no", (F.col("row_no") - F.col("first")).alias("at"), cells.alias("cells"))


def header_blocks(rows: DataFrame, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """(file, sheet, first, last): the places of each sheet's header rows. The row with the best score among the first
    scan_rows ends the block (the first one on ties; the first row if none is better than 0); rows above it belong to it
    as long as they are text with two values or more."""
    head = rows.where(F.col("at") <= scan_rows)
    below = F.lead("cells").over(Window.partitionBy(*KEYS).orderBy("at"))
    scored = head.withColumn("score", header_score(F.col("cells"), below)).where(F.col("at") < scan_rows)
    values = _filled(F.col("cells"))
    plain = F.transform(values, lambda c: F.lower(F.regexp_replace(c["text"], r"[\s　]+", "")))
    level = (
        (F.size(F.array_distinct(plain)) >= 2)
        & (F.try_divide(_count(values, looks_like_text), F.size(values)) >= 0.6)
        & (_count(values, lambda c: looks_like_number(c) | looks_like_date(c)) == 0)
    )
    scored = scored.select(*KEYS, "at", "score", F.coalesce(level, F.lit(False)).alias("level"))
    best = scored.groupBy(*KEYS).agg(F.max(F.struct("score", (-F.col("at")).alias("up"))).alias("b"))
    best = best.select(*KEYS, F.when(F.col("b.score") > 0, -F.col("b.up")).otherwise(0).alias("last"))
    stop = scored.join(best, KEYS).where((F.col("at") < F.col("last")) & ~F.col("level")).groupBy(*KEYS).agg(F.max("at").alias("stop"))
    return best.join(stop, KEYS, "left").select(*KEYS, (F.coalesce("stop", F.lit(-1)) + 1).alias("first"), "last")


def _column_name(levels: Column) -> Column:
    """One name from the levels of a header column: repeats of the level above dropped, then leading group names that
    say nothing (one level stays)."""
    texts = F.array().cast("array<string>")
    once = F.aggregate(levels, texts, lambda acc, x: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1)) == x, F.lit(False)), acc).otherwise(F.concat(acc, F.array(x))))
    generic = F.aggregate(
        once,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x.isin(*GENERIC_GROUPS), 1).otherwise(0)).alias("n"), (acc["on"] & x.isin(*GENERIC_GROUPS)).alias("on")),
        lambda acc: acc["n"],
    )
    skip = F.least(generic, F.greatest(F.size(once) - 1, F.lit(0)))
    return F.array_join(F.slice(once, skip + 1, F.greatest(F.size(once) - skip, F.lit(0))), JOINER)


def unit_hint(texts: Column) -> Column:
    """Which unit a sheet is from, from the texts above its header: a line that names it, else a title without year and
    usual endings; empty if neither has 2 to 30 characters."""

    def fits(x: Column) -> Column:
        return F.char_length(x).between(2, 30)

    def stripped(title: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(title, r"^[0-9]{4}\s*年?", ""), TITLE_ENDINGS, "")
        return F.regexp_replace(F.regexp_replace(body, r"[0-9]{4}\s*年?", ""), r"^[ \-—·（()）]+|[ \-—·（()）]+$", "")

    named = F.filter(F.transform(texts, lambda t: F.trim(F.regexp_extract(t, UNIT_PATTERN, 1))), fits)
    titles = F.filter(F.transform(F.filter(texts, lambda t: F.char_length(t).between(4, 60)), stripped), fits)
    return F.coalesce(F.get(named, F.lit(0)), F.get(titles, F.lit(0)), F.lit(""))


def is_total_row(cells: Column) -> Column:
    """One of the first two filled cells holds a word for totals."""
    return F.exists(F.slice(_filled(cells), 1, 2), lambda c: F.regexp_replace(c["text"], r"[\s　]+", "").rlike("|".join(TOTAL_MARKERS)))


def recovered(grid: DataFrame, scan_rows: int = SCAN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sheets, rows). sheets: file, sheet, header_rows, names, hint, dropped (total rows). rows: file, sheet, row_no,
    cells in the order of names; without blank and total rows. Columns with neither name nor data are left out of
    both."""
    rows = trimmed(grid)
    placed = rows.join(F.broadcast(header_blocks(rows, scan_rows)), KEYS)
    top = placed.where(F.col("at") <= F.col("last")).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("at", "row_no", "cells", (F.col("at") >= F.col("first")).alias("header")))).alias("lines")
    )
    header = F.filter("lines", lambda r: r["header"])
    above = F.flatten(F.transform(F.filter("lines", lambda r: ~r["header"]), lambda r: F.filter(r["cells"], lambda c: (c["kind"] == "s") & ~is_blank(c))))
    width = F.size(header[0]["cells"])
    levels = lambda k: F.filter(F.transform(F.col("header"), lambda r: _text(r["cells"][k])), lambda x: x.isNotNull() & (x != ""))
    heads = top.select(*KEYS, header.alias("header"), F.transform(above, _text).alias("above"), width.alias("width")).select(
        *KEYS,
        F.transform("header", lambda r: r["row_no"]).alias("header_rows"),
        F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: _column_name(levels(k))).alias("names"),
        unit_hint(F.col("above")).alias("hint"),
    )
    body = placed.where((F.col("at") > F.col("last")) & (F.size(_filled(F.col("cells"))) > 0))
    total = is_total_row(F.col("cells"))
    dropped = body.groupBy(*KEYS).agg(F.count_if(total).alias("dropped"))
    data = body.where(~total).select(*KEYS, "row_no", "cells")
    used = data.select(*KEYS, F.posexplode("cells").alias("k", "c")).where(~is_blank(F.col("c"))).select(*KEYS, "k").distinct().groupBy(*KEYS).agg(F.collect_list("k").alias("used"))
    heads = heads.join(dropped, KEYS, "left").join(used, KEYS, "left")
    keep = F.filter(
        F.sequence(F.lit(0), F.size("names") - 1), lambda k: (F.get("names", k) != "") | F.coalesce(F.array_contains(F.col("used"), k), F.lit(False))
    )
    heads = heads.withColumn("keep", keep)
    sheets = heads.select(
        *KEYS, "header_rows", F.transform("keep", lambda k: F.get("names", k)).alias("names"), "hint", F.coalesce("dropped", F.lit(0)).alias("dropped")
    )
    out = data.join(F.broadcast(heads.select(*KEYS, "keep")), KEYS).select(*KEYS, "row_no", F.transform("keep", lambda k: F.get("cells", k)).alias("cells"))
    return sheets, out


def column_samples(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, sheet, place, name, samples): each column's distinct filled values, in the order they first occur. All of a
    column's values meet in one row: counted_samples and first_samples have some of each, however long a column is."""
    cells = rows.select(*KEYS, "row_no", F.posexplode("cells").alias("place", "cell")).where(~is_blank(F.col("cell")))
    first = cells.groupBy(*KEYS, "place", _text(F.col("cell")).alias("value")).agg(F.min("row_no").alias("row_no"))
    found = first.groupBy(*KEYS, "place").agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("v"))
    named = sheets.select(*KEYS, F.posexplode("names").alias("place", "name"))
    return named.join(found, [*KEYS, "place"], "left").select(
        *KEYS, "place", "name", F.coalesce(F.transform("v", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples")
    )


def counted_samples(sheets: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(file, sheet, place, name, n, samples): the number of each column's distinct filled values, and the first most of
    them. Values are spread by value to be told apart; each task then hands on at most so many a column."""
    cells = rows.select(*KEYS, "row_no", F.posexplode("cells").alias("place", "cell")).where(~is_blank(F.col("cell")))
    first = cells.groupBy(*KEYS, "place", _text(F.col("cell")).alias("value")).agg(F.min("row_no").alias("row_no"))
    counts = first.groupBy(*KEYS, "place").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "place").orderBy("row_no", "value"))
    some = first.withColumn("rank", rank).where(F.col("rank") <= most)
    found = some.groupBy(*KEYS, "place").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
    named = sheets.select(*KEYS, F.posexplode("names").alias("place", "name"))
    return named.join(counts, [*KEYS, "place"], "left").join(found, [*KEYS, "place"], "left").select(
        *KEYS, "place", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.transform("v", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples")
    )


def first_samples(sheets: DataFrame, rows: DataFrame, most: int, change: Callable[[Column], Column] | None = None) -> DataFrame:
    """column_samples with at most so many samples a column. change (a mask) is applied before values are compared; what
    it leaves blank is none."""
    text = _text(F.col("cell"))
    cells = rows.select(*KEYS, "row_no", F.posexplode("cells").alias("place", "cell")).where(~is_blank(F.col("cell")))
    values = cells.select(*KEYS, "place", "row_no", (change(text) if change else text).alias("value")).where(F.trim("value") != "")
    found = first_distinct(values, [*KEYS, "place"], "row_no", "value", most)
    named = sheets.select(*KEYS, F.posexplode("names").alias("place", "name"))
    return named.join(found, [*KEYS, "place"], "left").select(*KEYS, "place", "name", F.coalesce("values", F.array().cast("array<string>")).alias("samples"))
