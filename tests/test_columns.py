"""Cleaning and feature rules on hand-made values."""

from datetime import datetime

from pyspark.sql import functions as F

from payrisk.functions import columns as c


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_amount_loses_only_the_dollar_sign(spark):
    raw = ["$1,234.56", "$-77.00", "", "$abc", None, "$12.5", "1.5d", "2F", "$1e3"]
    assert values(spark, raw, c.parse_amount) == [None, -77.0, None, None, None, 12.5, None, None, 1000.0]


def test_infinity_is_a_number_and_type_letters_are_not(spark):
    assert values(spark, ["inf", "3.d ", "7 "], c.parse_amount) == [float("inf"), None, 7.0]


def test_money_loses_dollar_sign_and_commas(spark):
    assert values(spark, ["$24,295", "$0", "$1,234,567.5", "x"], c.parse_money) == [24295.0, 0.0, 1234567.5, None]


def test_only_exact_yes_is_fraud(spark):
    assert values(spark, ["Yes", "No", "yes", "Unknown", None], c.yes_no_label) == [1, 0, 0, 0, 0]


def test_error_flag_trims_spaces_only(spark):
    assert values(spark, [None, "", "   ", "\t", "Bad PIN"], c.has_error) == [0, 0, 0, 1, 1]


def test_refund_flag_of_missing_amount_is_zero(spark):
    assert values(spark, [-1.0, 0.0, None, 3.0], lambda v: c.flag(v < 0), "double") == [1, 0, 0, 0]


def test_ratio_needs_a_positive_denominator(spark):
    assert values(spark, [2.0, 0.0, -1.0, None], lambda v: c.ratio(F.lit(10.0), v), "double") == [5.0, None, None, None]


def test_sunday_is_day_zero(spark):
    days = [datetime(2024, 1, 7), datetime(2024, 1, 6), datetime(2024, 1, 8)]
    assert values(spark, days, c.day_of_week, "timestamp_ntz") == [0, 6, 1]


def test_missing_time_counts_as_future(spark):
    times = [datetime(2024, 1, 1), datetime(2024, 2, 1), None]
    found = values(spark, times, lambda v: c.period(v, datetime(2024, 2, 1)), "timestamp_ntz")
    assert found == ["TRAIN - Past", "TEST - Future", "TEST - Future"]


def test_method_label_passes_unknown_methods_through(spark):
    raw = ["Online Transaction", "Chip Transaction", "Swipe Transaction", "signup", None]
    assert values(spark, raw, c.method_label) == ["Online", "Chip", "Swipe", "signup", None]


def test_month_start(spark):
    assert values(spark, [datetime(2024, 3, 15, 7, 8)], c.month_start, "timestamp_ntz") == [datetime(2024, 3, 1)]


def test_micros_round_trip_in_any_session_zone(spark):
    times = [datetime(2024, 3, 31, 2, 30, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2001, 1, 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 does not exist there that day
        assert values(spark, times, c.epoch_micros, "timestamp_ntz")[1:] == [-1, 978307200000000]
        assert values(spark, times, lambda v: c.from_epoch_micros(c.epoch_micros(v)), "timestamp_ntz") == times
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cut_offs_mean_the_same_in_any_session_zone(spark):
    times = [datetime(2024, 1, 1, 11, 59, 59, 999999), datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12, 0, 0, 1)]
    expected = ["TRAIN - Past", "TEST - Future", "TEST - Future"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            for cut in (datetime(2024, 1, 1, 12), "2024-01-01 12:00:00"):
                assert values(spark, times, lambda v: c.period(v, cut), "timestamp_ntz") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_buckets_are_nested_and_repeatable(spark):
    ids = spark.range(20_000).withColumn("b", c.hash_bucket(F.col("id"))).withColumn(
        "m", c.hash_bucket(F.col("id"), "md5")
    )
    low, high, n25, n35, m25 = ids.agg(
        F.min("b"), F.max("b"), F.count_if(F.col("b") < 25), F.count_if(F.col("b") < 35), F.count_if(F.col("m") < 25)
    ).first()
    assert (low, high) == (0, 99)
    assert 4700 < n25 < 5300 and 6700 < n35 < 7300 and 4700 < m25 < 5300
