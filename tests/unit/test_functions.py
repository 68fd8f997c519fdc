from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from sheafwork.functions import cleaning as c
from sheafwork.functions import masking as m
from sheafwork.functions import names as n


def values(spark, fn, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", fn(F.col("t")).alias("v")).orderBy("k").collect()]


def test_numbers(spark):
    texts = ["1.2万", "3,500", "￥1200", "５００", "50%", "约二十", "True", None, "", "1 2", "3亿元", "-1.5k", "+7", "1.", "%", "2w%", "１，０００"]
    want = [12000, 3500, 1200, 500, 0.5, None, None, None, None, 12, 300_000_000, -1500, 7, None, None, 200, 1000]
    got = values(spark, c.parse_number, texts)
    assert [None if g is None else g.normalize() for g in got] == [None if w is None else Decimal(str(w)).normalize() for w in want]


def test_dates(spark):
    serial = (date(2026, 9, 1) - date(1899, 12, 30)).days
    texts = ["2026/9/1", "2026-09-01", "2026年9月1日", "20260901", str(serial), "18990101", "20261301", "20260230", "999", "9-1", "2026 . 9 . 1", "x", None, "２０２６／９／１"]
    day = date(2026, 9, 1)
    assert values(spark, lambda t: c.parse_date(t, 2026), texts) == [day] * 5 + [None] * 4 + [day, day, None, None, day]
    assert date(1899, 12, 30) + timedelta(serial) == day


def test_texts(spark):
    assert values(spark, c.normalize_text, ["王　五", " Ａ ｂ\t", "①Ⅻ", "a​b", None]) == ["王五", "Ab", "1XII", "ab", None]
    assert values(spark, c.is_empty, ["无", " N / A ", "—", "0", "", None, "False", "－"]) == [True, True, True, False, True, True, False, True]
    assert values(spark, c.clean_text, ["无", "王　五", None]) == [None, "王五", None]
    assert values(spark, lambda t: c.pretty_number(t.cast(c.NUMBER)), ["12000", "0.50", "100.0", "-3.25"]) == ["12000", "0.5", "100", "-3.25"]
    assert values(spark, c.compare_key, [" A b", None, "Ｘ"]) == ["ab", "none", "ｘ"]


def test_masks(spark):
    texts = ["330102199001011234", "13812345678", "6222021234567890", "zhangsan@example.com", "x33010219900101123Xy", "330102900101123", "6222 0212-3456 7890123", "113812345678", None]
    assert values(spark, m.mask_text, texts) == ["3301**********1234", "138****5678", "************7890", "z***@example.com", "x3301**********123Xy", "3301********123", "************7890123", "113812345678", None]
    assert values(spark, lambda t: m.mask_bank_card(t, strict=True), ["6222021234567890123"]) == ["************0123"]
    assert values(spark, lambda t: m.mask_text(t, {"mask_email"}), ["13812345678 a@b.cn"]) == ["13812345678 a***@b.cn"]
    assert values(spark, m.mask_name, ["张三丰", "", None, "李"]) == ["张**", "", None, "李"]


def test_masked_rows_and_samples(spark):
    df = spark.createDataFrame([("张三", "13812345678", None)], "`姓名` string, phone string, n int")
    assert tuple(m.mask_rows(df).first()) == ("张三", "138****5678", "")
    assert tuple(m.mask_rows(df, mask_names=True).first()) == ("张*", "138****5678", "")
    rows = spark.createDataFrame([(["13812345678", "13899995678", " ", None, "b", "b", "c"],)], "v array<string>")
    assert rows.select(m.masked_samples(F.col("v"), 3).alias("s"), m.masked_samples(F.col("v"), 0).alias("z")).first() == (["138****5678", "b", "c"], [])


def test_names(spark):
    assert values(spark, n.normal_name, ["学生数（万元）", "No.", "a - B"]) == ["学生数", "no", "ab"] == [n.normal_name_of(x) for x in ["学生数（万元）", "No.", "a - B"]]
    pairs = [("学生人数", "学生数"), ("课时数", "课程数"), ("数", "数"), ("ab", "cd")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(n.likeness(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in rows] == [0.75, 0.5, 0.0, 0.0] == [n.likeness_of(*p) for p in pairs]
    assert values(spark, n.is_group, ["所在学院", "姓名"]) == [True, False]
    assert values(spark, n.is_identity, ["学号", "user id", "width", "ID"]) == [True, True, False, True] == [n.is_identity_of(x) for x in ["学号", "user id", "width", "ID"]]
    rows = spark.createDataFrame([(["单位", " 姓 名 "],), (["姓名", "单位", ""],)], "h array<string>").select(n.signature(F.col("h")).alias("s")).distinct()
    assert rows.count() == 1
