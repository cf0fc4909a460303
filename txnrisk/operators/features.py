"""Feature columns of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk import schema as S
from txnrisk.functions import dates, labels
from txnrisk.functions.money import cents, money
from txnrisk.functions.rounding import round_half_even
from txnrisk.operators import running
from txnrisk.operators.running import running_columns

CUSTOMER_ORDER = ("txn_datetime", "transaction_id")
DAY_ORDER = ("txn_datetime", "transaction_id")
TERMINAL_ORDERS = {
    # the published numbering walks rows by customer, then time
    "customer": ("customer_id", "txn_datetime", "transaction_id"),
    "time": ("txn_datetime", "transaction_id"),
}


def time_features(rows: DataFrame) -> DataFrame:
    ts = F.col("txn_datetime")
    return rows.withColumns(
        {
            "date_key": dates.date_key(dates.day(ts)),
            "txn_hour": F.hour(ts),
            "part_of_day": labels.part_of_day(F.hour(ts)),
        }
    )


def amount_bands(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount_band", labels.amount_band(F.col("amount")))


def fraud_types(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fraud_type", labels.fraud_type(F.col("fraud_scenario")))


def customer_history(
    rows: DataFrame, source: DataFrame | None = None, drawn: DataFrame | None = None
) -> DataFrame:
    """Place, minutes since the previous row, mean of earlier amounts and ratio to that mean.

    ``source`` and ``drawn``: the written table that ``rows`` come from and its cut rows, if ``rows``
    are still to be computed.
    """
    return customer_history_from(rows, source=source, drawn=drawn)


def customer_history_from(
    rows: DataFrame,
    state: DataFrame | None = None,
    source: DataFrame | None = None,
    drawn: DataFrame | None = None,
) -> DataFrame:
    """``customer_history`` of rows that follow earlier ones summed up in ``state``.

    ``state`` has one row per customer: n (rows), spent (cents) and last (time and id of the last
    row); every row of ``rows`` must come after its customer's last. Customers without a state row
    start afresh.
    """
    seen = running_columns(
        rows,
        "customer_id",
        CUSTOMER_ORDER,
        {
            "cust_txn_seq": running.counted(),
            "_prev_at": running.previous(F.col("txn_datetime")),
            "_spent": running.total_before(cents()),
        },
        source,
        drawn,
    )
    if state is not None:
        carried = state.select(
            "customer_id",
            F.col("n").alias("_s_n"),
            F.col("spent").alias("_s_spent"),
            F.col("last.txn_datetime").alias("_s_at"),
        )
        seen = seen.join(carried, "customer_id", "left").withColumns(
            {
                "cust_txn_seq": F.col("cust_txn_seq") + F.coalesce("_s_n", F.lit(0)),
                "_prev_at": F.coalesce("_prev_at", "_s_at"),
                "_spent": F.coalesce(F.col("_spent") + F.coalesce("_s_spent", F.lit(0)), "_s_spent"),
            }
        ).drop("_s_n", "_s_spent", "_s_at")
    minutes = dates.minutes_between(F.col("txn_datetime"), F.col("_prev_at"))
    earlier_rows = F.nullif(F.col("cust_txn_seq") - 1, F.lit(0).cast("bigint"))
    mean = money(F.col("_spent")) / earlier_rows
    with_mean = seen.withColumns(
        {
            "mins_since_prev_txn": round_half_even(minutes, 1),
            "cust_avg_amount_todate": round_half_even(mean, 2),
        }
    )
    base = F.nullif(F.col("cust_avg_amount_todate"), F.lit(0.0))
    return with_mean.withColumn(
        "amount_vs_cust_avg", round_half_even(F.col("amount").cast("double") / base, 2)
    ).drop("_prev_at", "_spent")


def terminal_sequence(
    rows: DataFrame,
    order: str = "customer",
    source: DataFrame | None = None,
    drawn: DataFrame | None = None,
) -> DataFrame:
    """``source`` and ``drawn`` as in ``customer_history``."""
    sequence = {"terminal_txn_seq": running.counted()}
    return running_columns(rows, "terminal_id", TERMINAL_ORDERS[order], sequence, source, drawn)


def fact_cut_rows(clean_rows: DataFrame, terminal_order: str = "customer") -> DataFrame:
    """Cut rows of both running orders and of the order by day that the fact is written in."""
    return running.cut_rows(
        time_features(clean_rows),
        ("customer_id", CUSTOMER_ORDER),
        ("terminal_id", TERMINAL_ORDERS[terminal_order]),
        ("date_key", DAY_ORDER),
    )


def running_features(
    clean_rows: DataFrame, terminal_order: str = "customer", drawn: DataFrame | None = None
) -> DataFrame:
    """Cleaned transactions, which should be a written table, with the columns that look at other rows.

    Only what the windows need is shuffled; ``labelled`` adds the columns of the row alone.
    """
    drawn = fact_cut_rows(clean_rows, terminal_order) if drawn is None else drawn
    # the customer columns are more numerous, so they come after the terminal's shuffle
    numbered = terminal_sequence(clean_rows, terminal_order, drawn=drawn)
    return customer_history(numbered, source=clean_rows, drawn=drawn)


def labelled(rows: DataFrame) -> DataFrame:
    """The fact's seventeen columns from rows with their running features."""
    return fraud_types(amount_bands(time_features(rows))).select(S.FACT.fieldNames())


def build_fact(clean_rows: DataFrame, terminal_order: str = "customer") -> DataFrame:
    """Seventeen fact columns from cleaned transactions, which should be a written table."""
    return labelled(running_features(clean_rows, terminal_order))


def time_sorted(fact: DataFrame) -> DataFrame:
    """Global time order, for presentation only."""
    return fact.orderBy("txn_datetime", "transaction_id")
