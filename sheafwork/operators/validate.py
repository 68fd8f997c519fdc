"""Validation rules over cleaned records; each gives rows of one issue table.

Records have one column a field and src_file, src_sheet, src_row, src_order. Values are judged as text. Only keys and
values of the checked fields are shuffled, and rules about whole columns use one aggregate, joined back as a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import cleaning as c
from sheafwork.functions import names as n

ISSUE = "level string, rule string, problem string, suggestion string, file string, sheet string, row int, column string, value string, field_order int"
LEVELS = ("error", "warning", "info")
NUMERIC_SHARE = 0.8
SPARSE_SHARE = 0.5
#: Files up to which their states go to every executor.
BROADCAST_FILES = 10_000


def _value(field: str) -> Column:
    return F.col(n.quoted(field)).cast("string")


def _has(field: str) -> Column:
    return _filled(_value(field))


def _filled(value: Column) -> Column:
    return F.coalesce(value.rlike(r"[^\s　]"), F.lit(False))


def _issue(level: Column | str, rule: Column | str, problem: Column, suggestion: Column | str, at: tuple[Column, Column, Column], column: Column | str, value: Column | None, order: Column | int) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    file, sheet, row = at
    empty = F.lit(None).cast("string")
    return [
        as_col(level).alias("level"), as_col(rule).alias("rule"), problem.alias("problem"), as_col(suggestion).alias("suggestion"),
        file.alias("file"), sheet.alias("sheet"), row.cast("int").alias("row"), as_col(column).alias("column"),
        (empty if value is None else value.cast("string")).alias("value"), as_col(order).cast("int").alias("field_order"),
    ]


def _here() -> tuple[Column, Column, Column]:
    return F.col("src_file"), F.col("src_sheet"), F.col("src_row")


def _nothing(records: DataFrame) -> DataFrame:
    return records.sparkSession.createDataFrame([], ISSUE)


def key_fields(fields: list[str]) -> list[str]:
    """The first group field and the first other field that identifies."""
    group = next((f for f in fields if n.is_group_of(f)), None)
    own = next((f for f in fields if f != group and n.is_identity_of(f)), None)
    return [f for f in (group, own) if f]


def _states(records: DataFrame, fields: list[str]) -> DataFrame:
    """(src_file, file_rows, all_rows, f): a row a file; f has for each field, in order, file_has, all_has, whether it is
    mostly numbers (numeric), whether the file lacks it as a whole (whole), and whether each row without it is told
    (each). One aggregate of the records, by file, from which the whole columns' sums follow."""
    numbers = [c.parse_number(_value(f), normalized=True).isNotNull() & _has(f) for f in fields]
    tests = [x for k, f in enumerate(fields) for x in (F.count_if(_has(f)).alias(f"h{k}"), F.count_if(numbers[k]).alias(f"n{k}"))]
    by_file = records.groupBy("src_file").agg(F.count(F.lit(1)).alias("file_rows"), *tests)
    names = [x for k in range(len(fields)) for x in (f"h{k}", f"n{k}")]
    totals = by_file.agg(F.sum("file_rows").alias("all_rows"), *(F.sum(x).alias(f"all_{x}") for x in names))
    of = []
    for k in range(len(fields)):
        has, every, file_rows, rows = F.col(f"h{k}"), F.col(f"all_h{k}"), F.col("file_rows"), F.col("all_rows")
        told = (every > 0) & (every < rows) & (has < file_rows)
        whole = (has == 0) & (file_rows > 1)
        numeric = (every >= 3) & (F.col(f"all_n{k}") >= NUMERIC_SHARE * every)
        of.append(F.struct(has.alias("file_has"), every.alias("all_has"), numeric.alias("numeric"), (told & whole).alias("whole"), (told & ~whole).alias("each")))
    return by_file.crossJoin(F.broadcast(totals)).select("src_file", "file_rows", "all_rows", F.array(*of).alias("f"))  # totals: one row


def _by_file(records: DataFrame, states: DataFrame, name: str) -> DataFrame:
    """records with their file's state in a column of a name that is none of theirs. The state goes to every executor if there are few files; else a file's rows may be
    split, as its state is shuffled by this join alone."""
    few = records.select("src_file").distinct().limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    packed = states.select("src_file", F.struct("all_rows", "f").alias(name))
    return records.join(F.broadcast(packed) if few else packed.hint("rebalance"), "src_file")


def _file_issues(states: DataFrame, fields: list[str]) -> DataFrame:
    names = F.array(*map(F.lit, fields))
    whole = states.select("src_file", "file_rows", F.posexplode("f").alias("k", "s")).where("s.whole").withColumn("field", F.get(names, "k"))
    return whole.select(
        *_issue("warning", "missing", F.format_string("%s is empty in all %d rows of this file, others have it", "field", "file_rows"),
                "Check whether the column was forgotten", (F.col("src_file"), F.lit(""), F.lit(None)), F.col("field"), None, F.col("k"))
    )


def _row_issues(records: DataFrame, fields: list[str], rules: tuple[str, ...], states: DataFrame | None) -> DataFrame:
    """What rules (missing, type_outlier, sparse_row) find in single rows, in one pass: first which rule holds for which
    field, as a number; texts are only written for what is found."""
    found, name = [], n.unused("state", records.columns)
    for k, f in enumerate(fields):
        state, value, has = F.get(F.col(name)["f"], F.lit(k)), _value(f), _has(f)
        if "missing" in rules:
            found.append(F.when(state["each"] & ~has, F.lit(3 * k)))
        if "type_outlier" in rules:
            odd = has & c.parse_number(value, normalized=True).isNull() & c.parse_date(value, normalized=True).isNull()
            found.append(F.when(state["numeric"] & odd, F.lit(3 * k + 1)))
    if "sparse_row" in rules and len(fields) >= 3:
        filled = sum((_has(f).cast("int") for f in fields), F.lit(0))
        found.append(F.when((filled > 0) & (filled / len(fields) < SPARSE_SHARE), F.lit(3 * len(fields) + 2)))
    if not found:
        return _nothing(records)
    rows = records if states is None else _by_file(records, states, name)
    state = F.lit(None).cast("array<struct<all_has:bigint>>") if states is None else F.col(name)["f"]
    at = rows.select("src_file", "src_sheet", "src_row", F.array(*map(_value, fields)).alias("values"), state.alias("state"), F.explode(F.array_compact(F.array(*found))).alias("code"))
    at = at.withColumn("k", F.floor(F.col("code") / 3).cast("int"))
    names, rule = F.array(*map(F.lit, fields)), F.col("code") % 3
    field, value = F.get(names, "k"), F.when(rule == 1, F.get("values", F.col("k")))
    problem = (
        F.when(rule == 0, F.format_string("%s is empty, but %d other rows have it", field, F.get("state", F.col("k"))["all_has"]))
        .when(rule == 1, F.format_string("%s is mostly numbers, this one is %s", field, value))
        .otherwise(F.format_string(f"only %d of {len(fields)} fields are filled", F.size(F.filter("values", _filled))))
    )
    rule_name, advice = F.get(F.array(*map(F.lit, ("missing", "type_outlier", "sparse_row"))), rule), F.array(
        F.lit("Check whether it was forgotten"), F.lit("Check whether it is a slip"), F.lit("Check whether the row was finished")
    )
    return at.select(*_issue("warning", rule_name, problem, F.get(advice, rule), _here(), F.coalesce(field, F.lit("")), value, F.col("k")))


def missing(records: DataFrame, fields: list[str]) -> DataFrame:
    """Values that lack where others have them: a row each, or one for a file of several rows that lacks them all."""
    if not fields:
        return _nothing(records)
    states = _states(records, fields)
    return _file_issues(states, fields).unionByName(_row_issues(records, fields, ("missing",), states))


def type_outliers(records: DataFrame, fields: list[str]) -> DataFrame:
    """Values that are neither number nor date in a field of three or more values, mostly numbers."""
    return _row_issues(records, fields, ("type_outlier",), _states(records, fields)) if fields else _nothing(records)


def duplicates(records: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose key an earlier row has. The key is made of the key fields that are filled, or of all fields if there
    are no key fields. An error within a file or if both key fields are filled, else a warning."""
    keys = key_fields(fields)
    if keys:
        parts = F.filter(F.array(*(F.when(_has(f), c.compare_key(_value(f))) for f in keys)), lambda x: x.isNotNull())
        used, some = F.size(parts), F.size(parts) > 0
    else:
        parts = F.array(*(c.compare_key(_value(f)) for f in sorted(fields)))
        used, some = F.lit(2), F.exists(parts, lambda x: x != "")
    if not fields:
        return _nothing(records)
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{f}="), F.coalesce(_value(f), F.lit("None"))) for f in keys)) if keys else F.lit("the whole row")
    rows = records.where(some).select("src_file", "src_sheet", "src_row", "src_order", F.array_join(parts, "|").alias("key"), used.alias("used"), shown.alias("shown"))
    first = rows.groupBy("key").agg(F.min(F.struct("src_order", "src_file", "src_row")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # A rebalanced side is shuffled by the join itself, so that the rows of a key that many have can be split.
    later = rows.join(first.hint("rebalance"), "key").where(F.col("src_order") > F.col("first.src_order"))
    sure = (F.col("src_file") == F.col("first.src_file")) | (F.lit(len(keys) >= 2) & (F.col("used") >= 2))
    return later.select(
        *_issue(F.when(sure, "error").otherwise("warning"), "duplicate", F.format_string("%s repeats row %d of %s", "shown", "first.src_row", "first.src_file"),
                F.when(sure, "Delete one of the two, or add a column that tells them apart").otherwise("Check whether they are the same"),
                _here(), keys[0] if keys else "", F.col("shown"), fields.index(keys[0]) if keys else 0)
    )


def sparse_rows(records: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of three or more fields with some but less than half filled."""
    return _row_issues(records, fields, ("sparse_row",), None) if len(fields) >= 3 else _nothing(records)


def low_confidence(records: DataFrame, fields: list[str], unsure: set[str]) -> DataFrame:
    rows = [
        ("info", "low_confidence", f"the columns taken for {f} are not certain", "Confirm or correct the mapping", "", "", None, f, None, k)
        for k, f in enumerate(fields)
        if f in unsure
    ]
    return records.sparkSession.createDataFrame(rows, ISSUE)


def normalization_notes(audit: DataFrame, fields: list[str]) -> DataFrame:
    """The audit of cleaning as issues."""
    order = F.coalesce(F.element_at(F.create_map(*(x for k, f in enumerate(fields) for x in (F.lit(f), F.lit(k)))), F.col("field")), F.lit(0)) if fields else F.lit(0)
    return audit.select(
        *_issue("info", "normalized", F.format_string("%s was written differently: %s became %s", "field", "before", "after"),
                "Change it back if this is wrong", _here(), F.col("field"), F.col("before"), order)
    )


def validate(records: DataFrame, fields: list[str], unsure: set[str] | None = None) -> DataFrame:
    """The issues of all rules. Rules about rows, whole columns and files share one aggregate and one pass."""
    out = duplicates(records, fields).unionByName(low_confidence(records, fields, unsure or set()))
    if not fields:
        return out
    states = _states(records, fields)
    return out.unionByName(_file_issues(states, fields)).unionByName(_row_issues(records, fields, ("missing", "type_outlier", "sparse_row"), states))


def in_order(issues: DataFrame) -> DataFrame:
    """By level, file, row and field."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return issues.orderBy(F.when(rank == 0, 9).otherwise(rank), "file", F.coalesce("row", F.lit(0)), "field_order", "rule")


def level_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def ranked_duplicates(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """Every row after the first of its key, with its place among them."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("place > 1")
