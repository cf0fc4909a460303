"""The star kept up day by day equals a full build of the same rows."""

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.plans import increment
from txnrisk.plans.star import build_from_clean
from txnrisk.sources.workspace import fresh_path, settled


def rows_of(df):
    return sorted(tuple(r) for r in df.select(S.FACT.fieldNames()).collect())


def full(spark, rows, order="customer"):
    return build_from_clean(settled(rows), fresh_path(spark, "full"), terminal_order=order)


@pytest.mark.parametrize("order", ["customer", "time"])
def test_later_late_and_replaced_days(spark, many, order):
    day = F.to_date("txn_datetime")
    days = sorted(r[0] for r in many.select(day.alias("d")).distinct().collect())
    first, second, third = days[: len(days) // 2], days[len(days) // 2 : -3], days[-3:]
    folder = fresh_path(spark, "inc")
    part = lambda ds: many.filter(day.isin(ds))
    increment.build_with_states(settled(part(first)), folder, order)
    # later days: numbered from the state alone
    star = increment.extend_star(settled(part(third)), folder, order)
    assert rows_of(star.fact) == rows_of(full(spark, part(first + third), order).fact)
    # late days (before the third part) and a replaced day with one row dropped and one amount changed
    redo = part([first[-1]]).filter(F.col("transaction_id") % 5 != 0).withColumn(
        "amount", F.when(F.col("transaction_id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(12,2)")
    )
    star = increment.extend_star(settled(part(second).unionByName(redo)), folder, order)
    final = part(first[:-1] + second + third).unionByName(redo)
    want = full(spark, final, order)
    assert rows_of(star.fact) == rows_of(want.fact)
    for name in ("customer", "terminal", "date", "band"):
        assert sorted(map(tuple, getattr(star, name).collect())) == sorted(map(tuple, getattr(want, name).collect()))


def test_state_tables_follow_the_fact(spark, many):
    folder = fresh_path(spark, "inc")
    day = F.to_date("txn_datetime")
    days = sorted(r[0] for r in many.select(day.alias("d")).distinct().collect())
    cut = days[len(days) // 2]  # a day landed again would replace the day, so cut between days
    increment.build_with_states(settled(many.filter(day < cut)), folder)
    increment.extend_star(settled(many.filter(day >= cut)), folder)
    other = fresh_path(spark, "inc")
    increment.build_with_states(settled(many), other)
    for name in (increment.CUSTOMER_STATE, increment.TERMINAL_STATE):
        got = sorted(map(tuple, spark.read.parquet(f"{folder}/{name}").collect()))
        assert got == sorted(map(tuple, spark.read.parquet(f"{other}/{name}").collect()))
