import sqlite3

import pytest

from sheafwork.plans import ask

ROWS = [(7, 2, "5", 2.5, "2026-01-31"), (-7, 2, "5.0", -2.5, "2024-02-29"), (7, 0, "x9", 0.0, "2026-12-31"), (9, -4, "12abc", 1e3, "not a day"), (5, 1, " 5 ", 5.0, "2026-09-06"), (None, 3, None, None, None), (12, 5, "", 0.5, "2026-03-01")]
COLUMNS = "n, m, t, d, day"


@pytest.fixture(scope="module")
def table(spark):
    return ask.Table(spark.createDataFrame(ROWS, "n long, m long, t string, d double, day string"), view="v")


@pytest.fixture(scope="module")
def other():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE v (n INTEGER, m INTEGER, t TEXT, d REAL, day TEXT)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?, ?, ?)", ROWS)
    return con


def plain(rows):
    """Truth as 0 and 1, whole numbers alike in either type where told."""
    return sorted((tuple(int(x) if isinstance(x, bool) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT n, m, n / m, n % m, (n + 1) / m, -n/2, n/2/2, n / (m - 2) FROM v", "SELECT n / d, d / n, d / 2, 7.0 / 2, 1 / 0, 1.0 / 0, d % 2, n % 2.5 FROM v", "SELECT sum(n) / count(*), avg(n) / 2, max(n) / min(m) FROM v",
        "SELECT n FROM v WHERE n / 2 = 3", "WITH c AS (SELECT n / m AS q, m FROM v) SELECT q / 2, (SELECT max(m / 2) FROM v) FROM c", "SELECT n, n / 2 AS h FROM v ORDER BY n / 2, m LIMIT 3", "SELECT m / 2, count(*) FROM v GROUP BY m / 2 HAVING sum(m) / 2 > 0",
        "SELECT n = '7', n = '7.0', n = 'x', n <> 'x', n < 'x', n <= '7', n > 'x', n >= ' 7 ', '7' = n, 'x' > n, d = '2.5', d < '1e3' FROM v",
        "SELECT t = 5, t < 5, t > 12, 5 = t, t <> 5, t = 5.0, t >= 5 FROM v", "SELECT 1 = '1', 2 < '1', '1' < 2, '1' >= 2, 1 <> '1' FROM v LIMIT 1", "SELECT n = t, n < t, t > d FROM v WHERE t <> ' 5 '",
        "SELECT n FROM v WHERE n IN ('7', 'x', 9)", "SELECT t FROM v WHERE t IN (5, 'x9')", "SELECT m FROM v WHERE n NOT IN ('7', 'x')", "SELECT t FROM v WHERE NOT t = 5",
        "SELECT t FROM v WHERE t GLOB '*5*'", "SELECT t FROM v WHERE t GLOB '[x1]*' AND t NOT GLOB '*b?'", "SELECT t FROM v WHERE t GLOB '[^0-9]?'", "SELECT t FROM v WHERE t GLOB 'X*' OR t GLOB '5.?' OR t GLOB ''",
        "SELECT date(day, '+1 day'), date(day, '-1 month'), date(day, '+1 year', '+1 month'), date(day, 'start of month', '+1 month', '-1 day') FROM v", "SELECT date(day, 'weekday 0'), date(day, 'start of year'), datetime(day, '+36 hours', '-30 minutes'), time(day, '+90 seconds') FROM v",
        "SELECT strftime('%Y/%m', day, '+1 month') FROM v WHERE day LIKE '2%'", "SELECT typeof(n), typeof(d), typeof(t), typeof(n / 2), typeof(d / 2), typeof(NULL), typeof(1.5) FROM v", "SELECT n FROM v ORDER BY n", "SELECT n FROM v ORDER BY n DESC",
    ],
)
def test_equals_the_other_dialect(table, other, sql):
    want = other.execute(sql).fetchall()
    answer = table.ask(sql)
    assert answer.error == ""
    assert plain(answer.rows) == plain(want)
    if "ORDER BY n" in sql and "/" not in sql:
        assert answer.rows == want


@pytest.mark.parametrize("sql", ["SELECT t + 1, t * 2, 2 - t, t / 2.0 FROM v", "SELECT n + t FROM v"])
def test_text_in_arithmetic_counts_as_a_number(table, other, sql):
    floats = lambda rows: sorted((tuple(None if x is None else float(x) for x in r) for r in rows), key=repr)
    answer = table.ask(sql)
    assert answer.error == "" and floats(answer.rows) == floats(other.execute(sql).fetchall())


@pytest.mark.parametrize("sql", ["SELECT n FROM v WHERE t GLOB n", "SELECT date(day, 'utc') FROM v", "SELECT date(day, '+1.5 days') FROM v", "SELECT n / FROM v", "SELECT nope / 2 FROM v"])
def test_what_has_no_equal_is_told(table, sql):
    assert table.ask(sql).error != ""


def test_statements_without_such_operators_stay(spark, table):
    from sheafwork.plans.dialect import typed

    for sql in ("SELECT n FROM v", "SELECT n + 1 FROM v WHERE n > 2 AND t = 'a / b'"):
        text = ask.prepared(sql, {"v"}, {"v": table._own})
        assert typed(spark, text).replace(" ", "") == text.replace(" ", "")
