import duckdb
import pytest

from sheafwork.plans import catalog, catalog_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


QUERIES, ORACLE = {**catalog.QUERIES, **catalog_files.QUERIES}, {**catalog.ORACLE, **catalog_files.ORACLE}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert got.count() > 0
        return
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=repr) == want


def test_streamed_cleaning_equals_batch(spark, tmp_path):
    from sheafwork.streaming.records import cleaned_stream

    rows = spark.createDataFrame([("1.2万", "2026/9/1", "王　五"), ("无", "x", "—")], "n string, d string, t string")
    rows.write.parquet(str(tmp_path / "in"))
    kinds = {"n": "number", "d": "date", "t": "text"}
    stream = cleaned_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), kinds, 2026)
    run = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(str, spark.table("cleaned").collect())) == sorted(map(str, cleaned_stream(rows, kinds, 2026).collect()))
