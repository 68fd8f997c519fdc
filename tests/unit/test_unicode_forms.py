import random
import unicodedata

from pyspark.sql import functions as F

from sheafwork.functions import cleaning
from sheafwork.functions.unicode_forms import nfkc, tables


def wrong(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "t string").repartition(8).select("t", nfkc(F.col("t")).alias("got")).collect()
    return [(r["t"], r["got"]) for r in rows if r["got"] != (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"]))]


def test_every_code_point(spark):
    chars = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    assert wrong(spark, [" ".join(chars[k : k + 16]) for k in range(0, len(chars), 16)]) == []


def test_marks_in_any_order(spark):
    rnd, t = random.Random(3), tables()
    marks = [e[0] for e in t.classes.split("\x1f")[1:]]
    letters = list("aeoAEOsSc가나ᄀ각åéǖΩ") + [e[0] for e in t.parts.split("\x1f")[1:]] + [e[0] for e in t.pairs.split("\x1f")[1:]]
    others = [e[1] for e in t.pairs.split("\x1f")[1:]] + list("ᅡᅵᆨᇂᄀ") + ["\U0001d15e", "\U000110ba", "ﬁ", "㍿", "Å", "ͅ", "ཱི"]
    texts = ["".join(rnd.choice(rnd.choice((letters, marks, others, marks))) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    assert wrong(spark, texts) == []


def test_texts(spark):
    assert wrong(spark, [None, "", "plain", "ｶﾞｷﾞ ㈱ ① ㎡ … ½ ﷺ", "ẹ́ x", "̣́a", "한글", "字゙", "\x1f\x1e…", "ab\nc̈d̈\n", "…" * 3000, "é" * 2000]) == []
    row = spark.createDataFrame([("　Ａ ｂ　㈱́ ",)], "t string").select(cleaning.normalize_text(F.col("t")).alias("a"), cleaning.normalize_all(F.array("t", F.lit(None)))).first()
    assert row[0] == "Ab(株)́" and row[1] == ["Ab(株)́", None]


def test_plan_has_no_python(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(cleaning.normalize_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
