import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text


@pytest.fixture(scope="module")
def numbers():
    random.seed(5)
    values = [
        0.0, 0.2, 100.0, 100.25, 100.75, 340.05, 12345.6, 126650.0, 1e-5, 0.00012345, 9999.5, 99995.0, 1.0005,
        10.125, 2.675, 0.125, -3.14159, float("inf"), float("-inf"), float("nan"), 1e20, 9.999e-5, 5e-7, 12.345e-8,
    ]
    for _ in range(3000):
        e = random.randint(-9, 9)
        values.append(float(f"{random.randint(1000, 9999)}5e{e}"))  # ties at the fifth digit
        values.append(random.uniform(-1, 1) * 10.0 ** e)
        values.append(random.randint(-10**7, 10**7) / 8)
        values.append(random.randint(0, 10**6) / 1000)  # ties at the third decimal
    return values


def test_numbers_print_like_python(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = df.select("v", text.four_digits("v").alias("g"), text.two_places("v").alias("f")).collect()
    assert not [(r.v, r.g) for r in got if r.g != f"{r.v:.4g}"]
    assert not [(r.v, r.f) for r in got if abs(r.v) < 1e9 and r.f != f"{r.v:.2f}"]


def test_null_prints_null(spark, one):
    df = spark.createDataFrame([(None,)], "v double")
    assert one(df.select(text.four_digits("v").alias("g"), text.two_places("v").alias("f"))) == {"g": None, "f": None}


@pytest.mark.parametrize(
    "raw, want",
    [("a@x, b@x ,,", ["a@x", "b@x"]), ("", []), (None, []), (" , ", []), ("one", ["one"])],
)
def test_address_list(spark, one, raw, want):
    assert one(spark.range(1).select(text.address_list(F.lit(raw).cast("string")).alias("a")))["a"] == want


def test_report_line_and_cards(spark, one):
    df = spark.sql("select date'2026-01-13' report_date, true pass, 0.75D confidence")
    line = df.select(text.report_line().alias("line")).withColumn("cards", text.report_cards(F.col("line")))
    assert one(line) == {
        "line": "2026-01-13 | pass=True | confidence=0.75",
        "cards": ["2026-01-13", "pass=True", "confidence=0.75"],
    }


def test_currency(spark, one):
    assert one(spark.sql("select 1234.5D v").select(text.currency(F.col("v")).alias("c")))["c"] == "$1,234"


def test_number_text(spark, rows):
    wanted = {
        37.0: "37.0", 0.1: "0.1", 12345678.9: "12345678.9", 1e7: "10000000.0", 0.0005: "0.0005", 1.5e-5: "1.5e-05",
        1e-5: "1e-05", 2.5e16: "2.5e+16", 1e100: "1e+100", -0.00025: "-0.00025", 0.0: "0.0",
        float("inf"): "inf", float("-inf"): "-inf",
    }
    df = spark.createDataFrame([(v,) for v in wanted], "v double").select("v", text.number_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in rows(df)} == wanted
