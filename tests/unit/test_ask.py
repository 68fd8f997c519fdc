import time

import pytest

from sheafwork.plans import ask


@pytest.fixture(scope="module")
def table(spark):
    rows = [("甲学院", "张三", "教授", 120, "a.xlsx", 2), ("甲学院", "李四", "讲师", 80, "a.xlsx", 3), ("乙学院", "13812345678", "讲师", 150, "b.xlsx", 2)]
    return ask.Table(spark.createDataFrame(rows, "`单位` string, `姓名` string, `职称` string, `学生数` long, `来源文件` string, `来源行` long"))


@pytest.mark.parametrize(
    "sql, rows",
    [
        ('SELECT SUM("学生数") FROM 汇总数据', [(350,)]),
        ("SELECT 姓名 FROM 汇总数据 WHERE 学生数 > 100 ORDER BY 学生数 DESC;", [("13812345678",), ("张三",)]),
        ("SELECT '单位', count(*) FROM 汇总数据 GROUP BY 1 ORDER BY 1", [("乙学院", 1), ("甲学院", 2)]),
        ("SELECT iif(学生数 > 100, 'x', 'y') FROM 汇总数据 WHERE \"姓名\" = '李四'", [("y",)]),
        ("WITH t AS (SELECT 单位, 学生数 FROM 汇总数据) SELECT max(学生数) FROM t WHERE 单位 LIKE '甲%'", [(120,)]),
        ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT sum(n) FROM r", [(15,)]),
        ("SELECT count(*) FROM 汇总数据 a CROSS JOIN 汇总数据 b CROSS JOIN 汇总数据 c", [(27,)]),
        ("SELECT 姓名 FROM 汇总数据 a WHERE EXISTS (SELECT 1 FROM 汇总数据 b WHERE b.单位 = a.单位 AND b.学生数 > a.学生数)", [("李四",)]),
        ("SELECT 姓名 FROM (SELECT 姓名, rank() OVER (ORDER BY 学生数 DESC) AS k FROM 汇总数据) WHERE k = 1", [("13812345678",)]),
        ("SELECT 职称 FROM 汇总数据 EXCEPT SELECT '教授'", [("讲师",)]),
    ],
)
def test_queries(table, sql, rows):
    answer = table.ask(sql)
    assert answer.error == "" and sorted(answer.rows, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW `汇总数据`", "INSERT INTO 汇总数据 VALUES (1)", "CREATE TABLE x AS SELECT 1", "SELECT 1; DROP VIEW 汇总数据", "SET spark.sql.ansi.enabled=false",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM hidden", "SHOW TABLES",
        "SELECT * FROM 汇总数据 WHERE 姓名 IN (SELECT n FROM hidden)", "SELECT (SELECT max(n) FROM hidden) FROM 汇总数据", "WITH t AS (SELECT * FROM hidden) SELECT * FROM t",
        "SELECT * FROM range(5)", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "SELECT input_file_name() FROM 汇总数据", "SELECT java_method('java.lang.System', 'nanoTime')", 'SELECT "没有这列" FROM 汇总数据', "", "nonsense",
        "SELECT * FROM 汇总数据 a JOIN LATERAL (SELECT * FROM hidden) h",
    ],
)
def test_refused_and_data_intact(spark, table, sql):
    spark.range(3).selectExpr("id AS n").createOrReplaceTempView("hidden")
    assert table.ask(sql).error != ""
    assert table.ask("SELECT count(*) FROM 汇总数据").rows == [(3,)]


def test_full_rows_for_the_user_masked_text_for_the_model(table):
    ledger = ask.Ledger()
    answer = table.ask("SELECT 姓名 FROM 汇总数据", shown=2, ledger=ledger)
    assert ("13812345678",) in answer.rows and "13812345678" not in answer.text and "3 rows, 2 shown" in answer.text
    table.ask("DROP VIEW x", ledger=ledger)
    assert len(ledger) == 2 and ledger.last_ok() is answer
    assert table.ask("SELECT * FROM 汇总数据 LIMIT 1000000", limit=2).truncated and not table.ask("SELECT * FROM 汇总数据", limit=3).truncated
    schema = table.schema_text()
    assert "138****5678" in schema and "学生数 (INTEGER)" in schema and "3 rows" in schema


def test_names_masked_on_demand(table):
    masked = ask.Table(table.df, view="名单", mask_names=True)
    assert "张*" in masked.ask("SELECT 姓名 FROM 名单").text and "张三" not in masked.schema_text()


def test_late_queries_stop_and_the_session_stays_usable(spark, table):
    big = ask.Table(spark.range(3_000_000).selectExpr("id AS n"), view="big")
    began = time.monotonic()
    answer = big.ask("SELECT count(*) FROM big a CROSS JOIN big b WHERE a.n * b.n % 7 = 3", seconds=2)
    assert "TimeoutError" in answer.error and time.monotonic() - began < 30
    assert table.ask("SELECT count(*) FROM 汇总数据").rows == [(3,)]
