"""Read-only SQL over the consolidated table, answered twice: in full for the user, masked for a model.

A statement is prepared (quoting, a few renamed functions), parsed by Spark, and walked: only plans that read the known
views, their common table expressions and values, with Spark's own harmless functions, are run. Every result is limited
on the plan, and a statement that takes too long is cancelled.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.masking import is_name_field, mask_name, mask_rows, mask_text
from sheafwork.functions.names import quoted
from sheafwork.plans.dialect import typed

VIEW = "汇总数据"
MOST_ROWS, SHOWN_ROWS, SECONDS = 5000, 20, 5.0

#: Plans that only read.
PLANS = frozenset((
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate", "Join", "SubqueryAlias",
    "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "Union", "Intersect", "Except", "OneRowRelation",
    "UnresolvedInlineTable", "LocalRelation", "UnresolvedHaving", "WithWindowDefinition", "Window", "LateralJoin", "Generate", "Pivot",
    "UnresolvedPivot", "Unpivot", "Expand", "GroupingSets", "UnresolvedOrderBy", "ResolvedInlineTable", "UnionLoop", "UnionLoopRef", "Sample",
))
#: Functions that a statement may use: each works on its arguments alone.
ALLOWED = frozenset((
    # text
    "ascii", "bit_length", "btrim", "char", "char_length", "character_length", "chr", "concat", "concat_ws", "contains", "elt", "endswith", "find_in_set", "format_number",
    "format_string", "hex", "initcap", "instr", "lcase", "left", "len", "length", "levenshtein", "locate", "lower", "lpad", "ltrim", "md5", "octet_length", "overlay", "position",
    "printf", "quote", "regexp", "regexp_count", "regexp_extract", "regexp_instr", "regexp_like", "regexp_replace", "regexp_substr", "repeat", "replace", "reverse", "right",
    "rlike", "rpad", "rtrim", "sha1", "sha2", "soundex", "split", "split_part", "startswith", "substr", "substring", "substring_index", "translate", "trim", "ucase", "unhex",
    "upper", "like", "ilike",
    # numbers
    "abs", "acos", "asin", "atan", "atan2", "bround", "cbrt", "ceil", "ceiling", "cos", "cosh", "cot", "degrees", "div", "exp", "floor", "ln", "log", "log10", "log2", "mod",
    "negative", "pi", "pmod", "pow", "power", "radians", "rand", "randn", "random", "round", "sign", "signum", "sin", "sinh", "sqrt", "tan", "tanh", "try_add", "try_divide",
    "try_multiply", "try_subtract", "width_bucket",
    # conditions and kinds
    "bigint", "boolean", "coalesce", "decimal", "double", "float", "greatest", "if", "ifnull", "int", "isnotnull", "isnull", "least", "nullif", "nvl", "nvl2", "string",
    "try_to_number", "typeof",
    # dates
    "add_months", "current_date", "current_timestamp", "date", "date_add", "date_diff", "date_format", "date_part", "date_sub", "date_trunc", "datediff", "day", "dayofmonth",
    "dayofweek", "dayofyear", "extract", "hour", "last_day", "make_date", "minute", "month", "months_between", "next_day", "now", "quarter", "second", "timestamp", "to_date",
    "to_timestamp", "to_unix_timestamp", "trunc", "try_to_date", "try_to_timestamp", "unix_date", "unix_timestamp", "weekday", "weekofyear", "year",
    # aggregates and windows
    "any_value", "approx_count_distinct", "array_agg", "avg", "bool_and", "bool_or", "collect_list", "collect_set", "corr", "count", "count_if", "covar_pop", "covar_samp",
    "every", "first", "first_value", "grouping", "grouping_id", "kurtosis", "last", "last_value", "listagg", "max", "max_by", "mean", "median", "min", "min_by", "mode",
    "percentile", "percentile_approx", "skewness", "some", "std", "stddev", "stddev_pop", "stddev_samp", "string_agg", "sum", "try_avg", "try_sum", "var_pop", "var_samp",
    "variance", "cume_dist", "dense_rank", "lag", "lead", "nth_value", "ntile", "percent_rank", "rank", "row_number",
    # lists and JSON
    "array", "array_contains", "array_distinct", "array_join", "array_size", "cardinality", "element_at", "explode", "explode_outer", "from_json", "get_json_object",
    "json_array_length", "json_object_keys", "json_tuple", "named_struct", "posexplode", "range", "sequence", "size", "slice", "sort_array", "struct", "to_json",
))
#: Names of another SQL dialect and Spark's for the same.
RENAMED = {"iif": "if", "group_concat": "string_agg", "unicode": "ascii", "like": "ilike", "json_extract": "get_json_object", "unixepoch": "unix_timestamp"}
#: Seconds after which a late query is given up even if it doesn't end.
GRACE = 5.0
#: Date parts of the other dialect's patterns and Spark's.
_DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "%"}
_DATE_FORMS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm:ss", "time": "HH:mm:ss"}
_TOKENS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[^\W\d]\w*|.", re.S)


class Refused(ValueError):
    """The statement may not run; the text says why."""


def _date_pattern(literal: str) -> str:
    """A literal pattern of the other dialect as Spark's."""
    parts = re.findall("%.|[^%]+", literal[1:-1])
    unknown = [x for x in parts if x.startswith("%") and x not in _DATE_PARTS]
    if unknown or literal[0] != "'":
        raise Refused(f"the date pattern {literal} has no equal here")
    return '"' + "".join(_DATE_PARTS.get(x) or re.sub("([A-Za-z]+)", r"'\1'", x) for x in parts) + '"'


def _moved(base: str, modifiers: list[str]) -> str:
    """A date, moved by the other dialect's modifiers in their order. A month's days beyond its last go on in the next."""
    at = "current_timestamp()" if base.strip().lower() == "'now'" else f"TRY_CAST({base} AS TIMESTAMP_NTZ)"
    for modifier in modifiers:
        said = modifier.strip().lower()
        if m := re.fullmatch(r"'\s*([+-]?[0-9]+)\s+(day|hour|minute|second|month|year)s?\s*'", said):
            moved = f"timestampadd({m[2].upper()}, {int(m[1])}, {at})"
            at = f"timestampadd(DAY, day({at}) - day({moved}), {moved})" if m[2] in ("month", "year") else moved
        elif m := re.fullmatch(r"'\s*start of (day|month|year)\s*'", said):
            at = f"date_trunc('{m[1].upper()}', {at})"
        elif m := re.fullmatch(r"'\s*weekday\s+([0-6])\s*'", said):
            at = f"timestampadd(DAY, (8 + {m[1]} - dayofweek({at})) % 7, {at})"
        else:
            raise Refused(f"the date modifier {modifier.strip()} has no equal here")
    return at


def _glob(literal: str) -> str:
    """A GLOB pattern as a regular expression for the whole text, as a literal."""
    if literal[:1] != "'":
        raise Refused("GLOB takes a literal pattern")
    pattern, out, at = literal[1:-1].replace("''", "'"), [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and (end := pattern.find("]", at + 2 + pattern.startswith("[^", at))) > 0:
            negated = pattern[at + 1] == "^"
            members = pattern[at + 1 + negated : end]
            out.append(f"[{'^' if negated else ''}{re.sub(r'([][\\&^])', r'\\\1', members)}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in " _-'" else "\\" + c))
        at += 1
    return "'" + ("(?s)^" + "".join(out) + "\\z").replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_globs(tokens: list[str]) -> list[str]:
    out, k = [], 0
    while k < len(tokens):
        if tokens[k].lower() == "glob":
            past = k + 1
            while past < len(tokens) and tokens[past].isspace():
                past += 1
            out += ["RLIKE", " ", _glob(tokens[past] if past < len(tokens) else "")]
            k = past
        else:
            out.append(tokens[k])
        k += 1
    return out


def _call(name: str, args: list[str]) -> str | None:
    """A call of the other dialect that differs by more than its name, as Spark's; None for all others."""
    if name == "total" and len(args) == 1:
        return f"coalesce(sum({args[0]}), 0D)"
    if name == "strftime" and len(args) == 2:
        return f"date_format({args[1]}, {_date_pattern(args[0].strip())})"
    if name == "strftime" and len(args) > 2:
        return f"date_format({_moved(args[1], args[2:])}, {_date_pattern(args[0].strip())})"
    if name in _DATE_FORMS and (len(args) > 1 or name != "date"):
        return f"date_format({_moved(args[0], args[1:])}, '{_DATE_FORMS[name]}')"
    if name == "typeof" and len(args) == 1:
        kind = f"typeof({args[0]})"
        whole = f"{kind} IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') OR {kind} LIKE 'decimal%,0)'"
        return f"CASE WHEN ({args[0]}) IS NULL THEN 'null' WHEN {whole} THEN 'integer' WHEN {kind} IN ('float', 'double') OR {kind} LIKE 'decimal%' THEN 'real' ELSE 'text' END"
    if name == "julianday" and len(args) == 1:
        return f"(unix_timestamp(CAST({args[0]} AS TIMESTAMP)) / 86400D + 2440587.5D)"
    if name == "date" and len(args) == 1 and args[0].strip().lower() == "'now'":
        return "current_date()"
    if name in ("max", "min") and len(args) > 1:
        null = " OR ".join(f"({x}) IS NULL" for x in args)
        return f"CASE WHEN {null} THEN NULL ELSE {'greatest' if name == 'max' else 'least'}({', '.join(args)}) END"
    return None


def _with_calls(tokens: list[str]) -> str:
    """The tokens' text, with the calls that _call knows rewritten, those in their arguments too."""
    out, k = [], 0
    while k < len(tokens):
        token, past = tokens[k], k + 1
        while past < len(tokens) and tokens[past].isspace():
            past += 1
        if token.lower() in ("total", "strftime", "julianday", "date", "datetime", "time", "typeof", "max", "min") and past < len(tokens) and tokens[past] == "(":
            depth, at, args = 1, past + 1, [[]]
            while at < len(tokens) and depth:
                depth += (tokens[at] == "(") - (tokens[at] == ")")
                if depth == 1 and tokens[at] == ",":
                    args.append([])
                elif depth:
                    args[-1].append(tokens[at])
                at += 1
            call = None if depth else _call(token.lower(), [_with_calls(x) for x in args])
            if call is not None:
                out.append(call)
                k = at
                continue
        out.append(token)
        k += 1
    return "".join(out)


def prepared(sql: str, known: set[str], renamed: dict[str, str] | None = None) -> str:
    """A statement in Spark's dialect: known names quoted, also where single quotes stand around one; double quotes are
    identifiers; names in renamed get another name."""
    out, names = [], renamed or {}
    for token in _TOKENS.findall(sql.strip().rstrip(";").strip()):
        if token[0] == "'" and token[1:-1] in known:
            token = quoted(names.get(token[1:-1], token[1:-1]))
        elif token[0] == '"':
            own = token[1:-1].replace('""', '"')
            token = quoted(names.get(own, own))
        elif token[0] == "`":
            own = token[1:-1].replace("``", "`")
            token = quoted(names.get(own, own))
        elif token in known or token.isidentifier() and not token.isascii():
            token = quoted(names.get(token, token))
        elif token.isidentifier():
            token = RENAMED.get(token.lower(), token)
        elif token.startswith(("--", "/*")):
            token = " "
        out.append(token)
    return _with_calls(_with_globs(out))


def looks_like_select(sql: str) -> bool:
    """A hint for messages only; what may run is decided on the plan."""
    body = re.sub(r"^(?:\s|--[^\n]*\n|/\*.*?\*/)*", "", sql, flags=re.S).lower()
    return body.startswith(("select", "with"))


def _seq(found) -> list:  # noqa: ANN001
    return [found.apply(k) for k in range(found.size())]


def _kind(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(node, views: set[str], functions: set[str]) -> None:  # noqa: ANN001
    kind = _kind(node)
    if kind == "UnresolvedFunction":
        name = ".".join(_seq(node.nameParts())).lower()
        if name not in functions:
            raise Refused(f"the function {name} may not be used")
    if kind in ("CallMethodViaReflection", "InputFileName"):
        raise Refused(f"{kind} may not be used")
    inner = getattr(node, "plan", None)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery", "UnresolvedTableArgPlanId", "FunctionTableSubqueryArgumentExpression") and callable(inner) and kind != "InSubquery":
        _check_plan(node.plan(), views, functions)
    for child in _seq(node.children()):
        _check_expression(child, views, functions)


def _check_plan(plan, views: set[str], functions: set[str]) -> None:  # noqa: ANN001
    kind = _kind(plan)
    if kind not in PLANS:
        raise Refused(f"only queries of the table are run, not {kind}")
    if kind == "UnresolvedWith":
        views = set(views)
        for pair in _seq(plan.cteRelations()):
            name = pair._1() if callable(getattr(pair, "_1", None)) else pair.productElement(0)
            inner = pair._2() if callable(getattr(pair, "_2", None)) else pair.productElement(1)
            recursive = views | {name.lower()}
            _check_plan(inner, recursive, functions)
            views.add(name.lower())
    if kind == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in views:
            raise Refused(f"there is no table {'.'.join(parts)}")
    for expression in _seq(plan.expressions()):
        _check_expression(expression, views, functions)
    for child in _seq(plan.children()):
        _check_plan(child, views, functions)


def allowed_functions(spark: SparkSession) -> set[str]:
    """Those of ALLOWED that are Spark's own."""
    return {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} & ALLOWED


def check(spark: SparkSession, sql: str, views: set[str], functions: set[str] | None = None) -> None:
    """Raises Refused unless the statement is one query of the views."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as problem:  # noqa: BLE001  a parse error comes as a Java exception
        raise Refused(str(problem).split("\n\n")[0][:500]) from problem
    _check_plan(plan, {v.lower() for v in views}, allowed_functions(spark) if functions is None else functions)


def within(spark: SparkSession, seconds: float, work):  # noqa: ANN001, ANN201
    """work()'s result, or TimeoutError after so many seconds, its jobs cancelled until none runs, or GRACE is over (a
    statement that is still being planned has no job)."""
    tag, out = f"ask-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(tag, "query", True)
        try:
            out["result"] = work()
        except Exception as problem:  # noqa: BLE001  handed to the caller's thread
            out["problem"] = problem

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late, end = thread.is_alive(), time.monotonic() + GRACE
    while thread.is_alive() and time.monotonic() < end:  # a plan starts several jobs, so one cancel may come before the last
        spark.sparkContext.cancelJobGroup(tag)
        thread.join(0.2)
    if late:
        raise TimeoutError(f"the query took more than {seconds:g} seconds")
    if "problem" in out:
        raise out["problem"]
    return out["result"]


@dataclass
class Answer:
    """A query's outcome: all rows for the user, masked text for a model."""

    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    error: str = ""
    text: str = ""
    seconds: float = 0.0


class Ledger:
    """The answers to one question."""

    def __init__(self) -> None:
        self.answers: list[Answer] = []

    def add(self, answer: Answer) -> None:
        self.answers.append(answer)

    def clear(self) -> None:
        self.answers.clear()

    def last_ok(self) -> Answer | None:
        return next((a for a in reversed(self.answers) if not a.error), None)

    def __len__(self) -> int:
        return len(self.answers)


class Table:
    """A DataFrame that can be asked in SQL."""

    def __init__(self, df: DataFrame, view: str = VIEW, masks: set[str] | None = None, mask_names: bool = False, samples: int = 3) -> None:
        self._spark, self.view, self._masks, self._mask_names = df.sparkSession, view, masks, mask_names
        self._samples = samples
        self.df = df
        self.columns = df.columns
        self._functions = allowed_functions(self._spark)
        self._lock = threading.Lock()
        self._own = f"{view}_{uuid.uuid4().hex}"  # each table has a view of its own, so that none answers for another
        df.createOrReplaceTempView(quoted(self._own))

    def schema_text(self) -> str:
        """Name, rows, kinds and a few masked samples of each column, for a prompt."""
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
        head = self.df.limit(40).collect()
        lines = [f"{self.view}: {self.df.count()} rows"]
        for name, kind in self.df.dtypes:
            seen = list(dict.fromkeys(str(r[name]) for r in head if r[name] is not None and str(r[name]).strip()))
            column = F.col("v")
            shown = mask_name(column) if self._mask_names and is_name_field(name) else mask_text(column, self._masks)
            masked = [r[0] for r in self._spark.createDataFrame([(x,) for x in seen], "v string").select(shown).collect()] if seen else []
            lines.append(f"- {name} ({kinds.get(kind, 'TEXT')}): {', '.join(list(dict.fromkeys(masked))[: self._samples])}")
        return "\n".join(lines)

    def ask(self, sql: str, limit: int = MOST_ROWS, shown: int = SHOWN_ROWS, seconds: float = SECONDS, ledger: Ledger | None = None) -> Answer:
        answer, began = Answer(sql), time.monotonic()
        try:
            text = prepared(sql, {self.view, *self.columns}, {self.view: self._own})
            check(self._spark, text, {self._own}, self._functions)
            if (by_types := typed(self._spark, text)) != text:
                check(self._spark, by_types, {self._own}, self._functions)
                text = by_types

            def work() -> tuple[DataFrame, list]:
                df = self._spark.sql(text)
                return df, df.limit(limit + 1).collect()

            with self._lock:
                df, rows = within(self._spark, seconds, work)
            answer.columns, answer.truncated = df.columns, len(rows) > limit
            answer.rows = [tuple(r) for r in rows[:limit]]
            names = [f"c{k}" for k in range(len(df.columns))]
            part = self._spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in answer.rows[:shown]], ", ".join(f"`{n}` string" for n in names)) if names else None
            masked = mask_rows(part, self._masks).collect() if part is not None and answer.rows else []
            if self._mask_names:
                masked = [tuple(v[:1] + "*" * (len(v) - 1) if is_name_field(c) else v for c, v in zip(df.columns, r)) for r in masked]
            lines = [" | ".join(df.columns), *(" | ".join(r) for r in masked)]
            total = f"{len(answer.rows)}{'+' if answer.truncated else ''} rows" + (f", {shown} shown" if len(answer.rows) > shown else "")
            answer.text = "\n".join([*lines, total])
        except Exception as problem:  # noqa: BLE001  told to whoever asked
            hint = "" if looks_like_select(sql) else " (only SELECT statements are run)"
            told = str(problem).split("JVM stacktrace")[0].strip().replace(self._own, self.view)
            answer.error = f"{type(problem).__name__}: {told[:800]}{hint}"
            answer.text = answer.error
        answer.seconds = time.monotonic() - began
        if ledger is not None:
            ledger.add(answer)
        return answer
