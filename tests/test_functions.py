import pytest
from pyspark.sql import functions as F

from linkforge.functions import gtin, sizes, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("12 oz", 340.2), ("2 lb", 907.2), ("64 fl oz", 1892.7), ("12 fl oz", 354.9), ("500 ml", 500.0), ("1 gallon", 3785.4), ("3.78L", 3780.0), ("453g", 453.0), ("3.5 oz", 99.2), ("2 kg", 2000.0), ("10 lbs", None), ("Medium", None), ("1,000 ml", 0.0), (None, None), ("", None)],
)
def test_size_base(spark, raw, want):
    assert one(spark, sizes.base_amount(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "a, b, tolerance, want",
    [(100, 100, 20, 100), (100, 110, 20, 54.5455), (100, 90, 20, 50), (355, 340, 20, 78.8732), (100, 120, 20, 16.6667), (100, 80, 20, 0), (100, 130, 20, 0), (100, 110, 5, 0), (100, 105, 5, 4.7619), (100, 103, 5, 41.7476), (473.2, 500, 20, 73.2), (28.4, 30, 20, 73.3333), (28.4, 25, 20, 40.1408), (0, 0, 20, 100), (0, 1, 20, 0), (None, 1, 20, 0)],
)
def test_size_similarity(spark, a, b, tolerance, want):
    x, y = (F.lit(None if v is None else float(v)).cast("double") for v in (a, b))
    assert one(spark, F.round(sizes.similarity(x, y, tolerance), 4)) == want
    assert one(spark, F.round(sizes.similarity(y, x, tolerance), 4)) == want


def test_compose(spark):
    assert one(spark, sizes.compose(F.lit("12"), F.lit("oz"))) == "12.0 oz"
    assert one(spark, sizes.compose(F.lit("many"), F.lit("oz"))) == ""
    assert one(spark, sizes.standardise(F.lit("12 oz"))) == "340.2g"


@pytest.mark.parametrize(
    "raw, want",
    [("The ORGANIC Olive-Oil, 70%", "organic oliveoil 70"), ("WH-1000 m² crème", "wh1000 m² crème"), ("  brand  of   the ", ""), (None, ""), ("", "")],
)
def test_clean(spark, raw, want):
    got = one(spark, text.clean(F.lit(raw).cast("string")))
    assert got == want
    assert one(spark, text.clean(F.lit(got))) == want


@pytest.mark.parametrize("base, want", [("03600029145", "036000291452"), ("1234567", "12345670"), ("1234567890123", "12345678901231"), ("123456789012", ""), ("", "")])
def test_check_digit(spark, base, want):
    assert one(spark, gtin.with_check_digit(F.lit(base))) == want


def test_gtin13_flag(spark):
    assert one(spark, gtin.is_valid(F.lit("4006381333931"))) is False
    assert one(spark, gtin.is_valid(F.lit("4006381333931"), True)) is True


@pytest.mark.parametrize(
    "raw, want",
    [
        ("036000291452", {"00036000291452": "original", "03600029145200": "original", "00360002914520": "original"}),
        ("0-36000-29145-3", {"00036000291453": "original", "00036000291452": "corrected", "03600029145300": "original", "00360002914530": "original"}),
        ("1234567890123", {"01234567890123": "original", "12345678901230": "original"}),
        ("12345678901234", {"12345678901234": "original", "12345678901231": "corrected"}),
        ("123456789012345", {}),
        ("n/a", {}),
        (None, {}),
    ],
)
def test_variants(spark, raw, want):
    got = one(spark, gtin.variants(F.lit(raw).cast("string")))
    assert {r["gtin14"]: r["source"] for r in got} == want
    assert len(got) == len(want)


def test_missing_check_digit_variant(spark):
    got = {r["gtin14"]: r["source"] for r in one(spark, gtin.variants(F.lit("03600029145")))}
    assert got["00003600029145"] == "original" and got["00036000291452"] == "missing_check" and len(got) == 5


def test_pool_last_column_wins(spark):
    got = {r["gtin14"]: r["source"] for r in one(spark, gtin.pool([F.lit("036000291453"), F.lit("036000291452")]))}
    assert got["00036000291452"] == "original"
    assert one(spark, gtin.pool([])) == []
