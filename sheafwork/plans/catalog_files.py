"""Registered queries over files that Spark writes from the tables: sources, sinks, samples and names as inboxes have them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import masking
from sheafwork.operators.first_distinct import first_distinct
from sheafwork.plans.catalog import Query, _folder, _sheet, table
from sheafwork.plans.consolidate import Engine, Settings
from sheafwork.plans.inbox import Inbox
from sheafwork.sinks import tables, workbook
from sheafwork.sources.csv_split import read_csv
from sheafwork.sources.files import read_grids

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return add


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT *, coalesce(text, '') || chr(10) || '\"' || coalesce(lang, '') || '\",' AS t FROM documents)")
def split_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as csv, with line ends and quotes in their values, read in chunks of 256 KB."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit('\n"'), F.coalesce("lang", F.lit("")), F.lit('",'))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    folder = _folder(spark)
    rows.write.options(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    value = lambda k: F.coalesce(F.get("cells", F.lit(k))["text"], F.lit(""))
    read = read_csv(spark, folder, 256 << 10, "*.[cC][sS][vV]").select(value(0).alias("doc_id"), value(1).alias("t"), value(2).alias("lang"))
    return read.select("doc_id", "lang", F.char_length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(
    """
    WITH v AS (SELECT c_nationkey AS nation, '138****' || lpad(CAST(c_custkey % 37 AS VARCHAR), 4, '0') AS phone, min(c_custkey) AS first_key FROM customer GROUP BY ALL)
    SELECT nation, array_to_string(list(phone ORDER BY first_key)[1:3], ',') AS phones FROM v GROUP BY nation
    """
)
def first_masked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation the first three customers' numbers that still differ when they are masked."""
    phone = F.concat(F.lit("138"), F.lpad((F.col("c_custkey") % 97).cast("string"), 4, "0"), F.lpad((F.col("c_custkey") % 37).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", masking.mask_text(phone).alias("phone"))
    return first_distinct(rows, ["nation"], "c_custkey", "phone", 3).select("nation", F.array_join("values", ",").alias("phones"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS INTEGER) AS row_no, CAST(o_orderkey AS VARCHAR) AS orderkey, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS custkey FROM orders")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in order as a workbook, whose sheets are read again as one."""
    path = f"{_folder(spark)}.xlsx"
    tables.write_workbook(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").orderBy("o_orderkey"), path)
    text = lambda k: F.get("cells", F.lit(k))["text"]
    return workbook.rejoined(read_grids(spark, path)).select("row_no", text(0).alias("orderkey"), text(1).alias("priority"), text(2).alias("custkey"))


@query("SELECT file, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM (SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'a.csv' WHEN c_nationkey < 20 THEN 'b.csv' ELSE 'c.csv' END AS file FROM customer WHERE c_nationkey < 20 OR c_mktsegment = 'BUILDING') GROUP BY file")
def growing_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as csv files of an inbox, one of which is changed and one added before the second run."""
    base = _folder(spark)
    folder, fs = f"{base}/in", spark._jvm.org.apache.hadoop.fs
    files = fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def put(name: str, condition: str) -> None:
        rows = table(spark, sf_dir, "customer").where(condition).select(F.concat(F.lit("学院"), "c_nationkey").alias("单位"), F.col("c_name").alias("姓名"), F.col("c_custkey").alias("人数"))
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/out/{name}")
        part = next(s.getPath() for s in files.listStatus(fs.Path(f"{base}/out/{name}")) if s.getPath().getName().startswith("part-"))
        files.mkdirs(fs.Path(folder))
        files.delete(fs.Path(f"{folder}/{name}"), False)
        files.rename(part, fs.Path(f"{folder}/{name}"))

    inbox = Inbox(Engine(spark, Settings(this_year=2026)), folder, f"{base}/state")
    put("a.csv", "c_nationkey < 10")
    put("b.csv", "c_nationkey = 10")
    inbox.refresh()
    put("b.csv", "c_nationkey >= 10 AND c_nationkey < 20")
    put("c.csv", "c_nationkey >= 20 AND c_mktsegment = 'BUILDING'")
    read, gone = inbox.refresh()
    if (read, gone) != (["b.csv", "c.csv"], []):
        raise ValueError(f"read {read}, gone {gone}")
    records = inbox.consolidate(["单位", "姓名", "人数"]).records
    return records.groupBy(F.col("src_file").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("人数").cast("long").alias("total"))


@query(
    """
    SELECT c_name AS unit, c_custkey AS f, CAST(c_nationkey AS BIGINT) AS file_rows, c_custkey + 1 AS own_row, c_mktsegment AS own_file, c_custkey % 7 AS own_source,
           c_custkey % 5 AS ticked, c_custkey % 3 AS first_n, c_custkey % 4 AS second_n, c_custkey + 2 AS src_row FROM customer
    """
)
def clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with names that the engine itself uses, a backtick and two equal names, through rules, issues and SQL."""
    key = F.col("c_custkey")
    cells = {"单位": "c_name", "f": key, "file_rows": "c_nationkey", "src_row": key + 1, "src_file": "c_mktsegment", "来源文件": key % 7, "a`b": key % 5, "数量": key % 3, "数量 ": key % 4}
    grid = _sheet(table(spark, sf_dir, "customer").select(key.alias("k"), *(F.col(c).alias(f"v{i}") if isinstance(c, str) else c.alias(f"v{i}") for i, c in enumerate(cells.values()))), "a.csv", "k", [list(cells)])
    result = Engine(spark, Settings(this_year=2026)).from_grids(grid)
    result.issues.count()
    view = result.table()
    asked = view.ask('SELECT count("a`b") AS n, count("来源文件_") AS files FROM 汇总数据')
    if asked.error:
        raise ValueError(asked.error)
    names = dict(zip(("单位", "f", "file_rows", "src_row_2", "src_file_2", "来源文件", "a`b", "数量", "数量_2", "来源行"), ("unit", "f", "file_rows", "own_row", "own_file", "own_source", "ticked", "first_n", "second_n", "src_row")))
    return view.df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()))
