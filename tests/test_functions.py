import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.functions import dates, labels
from txnrisk.functions.money import cents, percent, ratio, ratio_or_zero
from txnrisk.functions.rounding import round_half_even, round_half_up
from txnrisk.functions.tails import chi_square_p, chi_square_tail, two_sided_normal_p


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    "value, places, even, up",
    [(0.5, 0, 0.0, 1.0), (1.5, 0, 2.0, 2.0), (-0.5, 0, 0.0, -1.0), (16.955, 2, 16.95, 16.95),
     (2.675, 2, 2.68, 2.68), (0.125, 2, 0.12, 0.13), (1234.5674, 3, 1234.567, 1234.567)],
)
def test_rounding_rules(spark, value, places, even, up):
    row = spark.range(1).select(
        round_half_even(F.lit(value), places), round_half_up(F.lit(value), places)
    ).first()
    assert row[0] == pytest.approx(even, abs=1e-12)
    scaled = value * 10**places
    import math

    expected = math.copysign(math.floor(abs(scaled) + 0.5) / 10**places, value)
    assert row[1] == expected


def test_rounding_keeps_null(spark):
    assert one(spark.range(1).select(round_half_up(F.lit(None).cast("double"), 2))) is None


@pytest.mark.parametrize(
    "amount, place",
    [("0.01", 0), ("25.00", 0), ("25.01", 1), ("50.00", 1), ("100.00", 2), ("200.00", 3),
     ("200.01", 4), ("220.00", 4), ("220.01", 5), ("500.00", 5), ("500.01", 6), ("999999.99", 6)],
)
def test_bands_are_right_closed(spark, amount, place):
    value = F.lit(amount).cast("decimal(12,2)")
    assert one(spark.range(1).select(labels.amount_band(value))) == S.BAND_LABELS[place]


@pytest.mark.parametrize("amount", ["0.00", "-1.00", None])
def test_band_of_non_positive_is_null(spark, amount):
    value = F.lit(amount).cast("decimal(12,2)")
    assert one(spark.range(1).select(labels.amount_band(value))) is None


@pytest.mark.parametrize("hour, place", [(0, 0), (5, 0), (6, 1), (11, 1), (12, 2), (17, 2), (18, 3), (23, 3)])
def test_day_parts(spark, hour, place):
    assert one(spark.range(1).select(labels.part_of_day(F.lit(hour)))) == S.DAY_PARTS[place][1]


@pytest.mark.parametrize("rate, place", [(5.0, 0), (4.999, 1), (2.0, 1), (1.999, 2), (0.001, 2), (0.0, 3)])
def test_tiers(spark, rate, place):
    assert one(spark.range(1).select(labels.risk_tier(F.lit(rate)))) == S.RISK_TIERS[place]


def test_fraud_type_of_unknown_scenario_is_null(spark):
    rows = spark.createDataFrame([(0,), (3,), (9,)], "s int").select(labels.fraud_type(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["Legitimate", "S3 - Account Takeover", None]


@pytest.mark.parametrize(
    "minutes, label",
    [(0.0, "a. under 1 hour"), (59.9, "a. under 1 hour"), (60.0, "b. 1-6 hours"), (360.0, "c. 6-24 hours"),
     (1440.0, "d. 1-3 days"), (4320.0, "e. over 3 days")],
)
def test_gap_buckets(spark, minutes, label):
    assert one(spark.range(1).select(labels.gap_bucket(F.lit(minutes)))) == label


def test_guarded_division(spark):
    zero, one_ = F.lit(0), F.lit(1)
    row = spark.range(1).select(
        ratio(one_, zero), ratio_or_zero(one_, zero), percent(one_, F.lit(8)), cents(F.lit("12.34").cast("decimal(12,2)"))
    ).first()
    assert tuple(row) == (None, 0.0, 12.5, 1234)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_calendar_columns_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in either zone on its clock-change day
        stamps = [dt.datetime(2024, 3, 10, 2, 30, 0, 5), dt.datetime(2024, 3, 31, 2, 30, 0, 6)]
        df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
        ts = F.col("ts")
        rows = df.select(
            dates.date_key(dates.day(ts)), F.hour(ts), dates.micros(ts), dates.key_to_date(dates.date_key(dates.day(ts)))
        ).collect()
        epoch = dt.datetime(1970, 1, 1)
        for stamp, row in zip(stamps, rows):
            assert row[0] == int(stamp.strftime("%Y%m%d")) and row[1] == 2
            assert row[2] == (stamp - epoch) // dt.timedelta(microseconds=1)
            assert row[3] == stamp.date()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tail_probabilities(spark):
    tail = chi_square_tail()
    # textbook 5 % points
    for x, dof in [(3.841459, 1), (5.991465, 2), (7.814728, 3), (12.591587, 6)]:
        assert tail(x, dof) == pytest.approx(0.05, abs=1e-7)
    assert tail(0.43830474433621214, 3) == pytest.approx(0.9322207660278953, abs=1e-12)
    row = spark.range(1).select(
        chi_square_p(F.lit(7.814728), F.lit(3)), two_sided_normal_p(F.lit(1.959964)), two_sided_normal_p(F.lit(-0.1))
    ).first()
    assert row[0] == pytest.approx(0.05, abs=1e-7)
    assert row[1] == pytest.approx(0.05, abs=1e-6)
    assert row[2] == 1.0


def test_minutes_between_are_exact_to_the_microsecond(spark):
    at = dt.datetime(2024, 2, 28, 23, 59, 59, 999_999)
    later = [at, at + dt.timedelta(microseconds=1), at + dt.timedelta(days=400, hours=5, seconds=1, microseconds=7)]
    df = spark.createDataFrame([(x, at) for x in [*later, None]], "x timestamp_ntz, y timestamp_ntz")
    got = [r[0] for r in df.select(dates.minutes_between(F.col("x"), F.col("y"))).collect()]
    assert got == [(x - at) // dt.timedelta(microseconds=1) / 1e6 / 60.0 for x in later] + [None]
    assert df.select(dates.minutes_between(F.col("y"), F.col("x"))).collect()[2][0] == -got[2]
