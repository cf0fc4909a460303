import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("txnrisk-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clean_frame(spark):
    """Builds cleaned transactions from short tuples."""

    def build(rows):
        """(id, time text, customer, terminal, amount text, scenario)"""
        made = [
            (i, dt.datetime.fromisoformat(t), c, m, a, int(s > 0), s) for i, t, c, m, a, s in rows
        ]
        schema = (
            "transaction_id long, txn_datetime timestamp_ntz, customer_id long, terminal_id long, "
            "amount string, is_fraud int, fraud_scenario int"
        )
        df = spark.createDataFrame(made, schema)
        return df.withColumn("amount", df.amount.cast("decimal(12,2)"))

    return build


@pytest.fixture(scope="session")
def many(spark):
    """A few hundred cleaned rows with ties, a heavy customer and a heavy terminal."""
    from pyspark.sql import functions as F

    ids = spark.range(1, 901)
    i = F.col("id")
    scenario = F.when(i % 11 == 0, i % 3 + 1).otherwise(0).cast("int")
    return ids.select(
        i.alias("transaction_id"),
        F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, cast(id * 37 % 5000 as int) * 7)").alias(
            "txn_datetime"
        ),
        F.when(i % 3 == 0, 1).otherwise(i % 17 + 2).cast("long").alias("customer_id"),
        F.when(i % 2 == 0, 1).otherwise(i % 13 + 2).cast("long").alias("terminal_id"),
        ((i * 7919 % 60000 + 1) / 100).cast("decimal(12,2)").alias("amount"),
        (scenario > 0).cast("int").alias("is_fraud"),
        scenario.alias("fraud_scenario"),
    )


@pytest.fixture(scope="session")
def star(spark, many, tmp_path_factory):
    from txnrisk.operators import dims
    from txnrisk.operators.features import build_fact
    from txnrisk.plans.star import Star
    from txnrisk.sources.workspace import settled

    fact = settled(build_fact(many))
    return Star(
        fact,
        dims.build_dim_date(fact),
        settled(dims.build_dim_customer(fact)),
        settled(dims.build_dim_terminal(fact)),
        dims.build_dim_amount_band(fact),
    )
