import pytest
from pyspark.sql import functions as F

from townrisk.functions import text as X

CASES = [
    ("三宿１丁目　　　", "三宿1丁目"),
    ("大塚\U000E0104二十一丁目", "大塚21丁目"),
    ("麴町十丁目", "麹町10丁目"),
    ("八丁堀二十丁目", "八丁堀20丁目"),
    ("霞ヶ関三丁目", "霞ケ関3丁目"),
    ("丸ノ内１丁目", "丸の内1丁目"),
    ("十一丁目町", "十一丁目町"),
    ("大塚", "大塚"),
]


@pytest.mark.parametrize("fn", [X.norm_name, X.norm_name_nfkc])
def test_norm_name_cases(spark, fn):
    df = spark.createDataFrame([(a,) for a, _ in CASES], "s string")
    got = [r.n for r in df.select(fn(F.col("s")).alias("n")).collect()]
    assert got == [b for _, b in CASES]


def test_norm_idempotent(spark):
    df = spark.createDataFrame([(b,) for _, b in CASES], "s string")
    got = [r.n for r in df.select(X.norm_name(F.col("s")).alias("n")).collect()]
    assert got == [b for _, b in CASES]


def test_kanji_number(spark):
    vals = {"一": 1, "九": 9, "十": 10, "十五": 15, "二十": 20, "二十一": 21, "九十九": 99,
            "一二": None, "十十": None, "": None}
    df = spark.createDataFrame([(k,) for k in vals], "k string")
    got = {r.k: r.v for r in df.select("k", X.kanji_number(F.col("k")).alias("v")).collect()}
    assert got == vals


def test_search_norm(spark):
    cases = {"世田谷区 三軒茶屋二丁目": "世田谷区三軒茶屋2丁目", "港区十丁目": "港区10丁目",
             "港区二十一丁目": "港区二十一丁目", "ＡＢ　１": "AB1"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.n for r in df.select("s", X.search_norm(F.col("s")).alias("n")).collect()}
    assert got == cases


def test_ward_prefix_order(spark):
    df = spark.createDataFrame([("北区赤羽",), ("江戸川区一之江",), ("江東区",), ("不明町",)], "s string")
    got = [r.w for r in df.select(X.ward_of(F.col("s"), ["江東区", "北区", "江戸川区"]).alias("w")).collect()]
    assert got == ["北区", "江戸川区", "江東区", None]


def test_with_norm_name_equals_column_form(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES], "s string")
    got = [r.n for r in X.with_norm_name(df, "s", "n").collect()]
    assert got == [b for _, b in CASES]
