"""Adapters that present the supplied parquet tables as raw card transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def events_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with stand-in fraud scenarios; the terminal is the ``k`` of the JSON column.

    A step of its own parses the JSON once per row, however often the terminal is used.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    events = events.withColumn("_terminal", F.get_json_object("props", "$.k").cast("bigint"))
    terminal = F.col("_terminal")
    scenario = (
        F.when(F.col("value") > 220, 1)
        .when((terminal % 20 == 3) & (F.col("event_type") == "error"), 2)
        .when((F.col("user_id") % 25 == 7) & F.col("event_type").isin("purchase", "signup"), 3)
        .otherwise(0)
    )
    return _raw(
        events, "event_id", F.col("ts"), F.col("user_id"), terminal, F.col("value"), scenario
    )


def orders_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    """``orders``: several years of dates, so month shifts find data."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    scenario = F.when(F.col("o_orderpriority") == "1-URGENT", 1 + F.col("o_orderkey") % 3).otherwise(0)
    return _raw(
        orders,
        "o_orderkey",
        F.col("o_orderdate").cast("timestamp_ntz"),
        F.col("o_custkey"),
        F.col("o_custkey") % 97,
        F.col("o_totalprice"),
        scenario,
    )


def lineitem_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` with its repeated keys, for the duplicate rules."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    return _raw(
        items,
        F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        F.col("l_shipdate").cast("timestamp_ntz"),
        F.col("l_suppkey"),
        F.col("l_partkey"),
        F.col("l_extendedprice"),
        F.lit(0),
    )


def _raw(df, key, ts, customer, terminal, amount, scenario) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(
        key.cast("bigint").alias("TRANSACTION_ID"),
        ts.alias("TX_DATETIME"),
        customer.cast("bigint").alias("CUSTOMER_ID"),
        terminal.cast("bigint").alias("TERMINAL_ID"),
        amount.cast("double").alias("TX_AMOUNT"),
        F.when(scenario > 0, 1).otherwise(0).alias("TX_FRAUD"),
        scenario.cast("int").alias("TX_FRAUD_SCENARIO"),
    )
