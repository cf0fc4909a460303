"""Cleaning of raw transactions: names, types, audit, duplicates, positive amounts, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Observation, Column, DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions.rounding import round_half_even

# fixed values: published column names
RENAMES = {
    "TRANSACTION_ID": "transaction_id",
    "TX_DATETIME": "txn_datetime",
    "CUSTOMER_ID": "customer_id",
    "TERMINAL_ID": "terminal_id",
    "TX_AMOUNT": "amount",
    "TX_FRAUD": "is_fraud",
    "TX_FRAUD_SCENARIO": "fraud_scenario",
}
TARGET_TYPES = {
    "transaction_id": "bigint",
    "txn_datetime": "timestamp_ntz",
    "customer_id": "bigint",
    "terminal_id": "bigint",
    "amount": "double",
    "is_fraud": "int",
    "fraud_scenario": "int",
}
NULL_ALLOWED = ("txn_datetime", "amount")  # such rows are dropped later; other nulls abort
CLEAN_COLUMNS = list(RENAMES.values())
SOURCE_FILE = "source_file"


def rename_and_prune(raw: DataFrame) -> DataFrame:
    """Seven named columns, plus the source file where the scan recorded one."""
    kept = [F.col(old).alias(new) for old, new in RENAMES.items()]
    if SOURCE_FILE in raw.columns:
        kept.append(F.col(SOURCE_FILE))
    return raw.select(*kept)


def _value(rows: DataFrame, name: str) -> Column:
    """The column in its target type; null where the text or number does not convert."""
    if dict(rows.dtypes)[name] == TARGET_TYPES[name]:
        return F.col(name)
    return F.col(name).try_cast(TARGET_TYPES[name])


def _convertible(rows: DataFrame, name: str) -> Column:
    present = _value(rows, name).isNotNull()
    return F.col(name).isNull() | present if name in NULL_ALLOWED else present


def _converted(rows: DataFrame, name: str) -> Column:
    value = _value(rows, name)
    return round_half_even(value, 2).cast(S.MONEY) if name == "amount" else value


def typed(renamed: DataFrame) -> DataFrame:
    """Cast every column; the job fails on the first value that does not convert."""
    out = []
    for name in renamed.columns:
        if name not in TARGET_TYPES:
            out.append(F.col(name))
            continue
        complaint = F.raise_error(
            F.concat(F.lit(f"bad {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
        )
        accepted = F.when(_convertible(renamed, name), _converted(renamed, name))
        out.append(accepted.otherwise(complaint).alias(name))
    return renamed.select(*out)


def typed_with_quarantine(renamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that convert, and the untouched rows that do not."""
    good = reduce(lambda a, b: a & b, [_convertible(renamed, n) for n in CLEAN_COLUMNS])
    rest = [F.col(c) for c in renamed.columns if c not in TARGET_TYPES]
    return (
        renamed.where(good).select(
            *[_converted(renamed, n).alias(n) for n in CLEAN_COLUMNS], *rest
        ),
        renamed.where(~good),
    )


def audit(rows: DataFrame) -> DataFrame:
    """One row of counts taken before anything is dropped."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in CLEAN_COLUMNS])
    known = F.count("transaction_id") - F.count_distinct("transaction_id")
    unknown = F.count_if(F.col("transaction_id").isNull())
    return rows.agg(
        (known + F.greatest(unknown - 1, F.lit(0))).alias("duplicate_txn_ids"),
        F.count_if(any_null).alias("null_rows"),
        F.count_if(F.col("amount") <= 0).alias("zero_amount_txns"),
        F.count_if(F.col("amount") < 0).alias("negative_amounts"),
    )


def keep_first(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """First row per transaction id in file order, then rows without nulls.

    Spark trims every id to one row before the shuffle (WindowGroupLimit), so an id that is
    repeated many times does not fill one task. With ``observation`` the audit's four counts are
    gathered from the rows as they pass (``Dataset.observe``), read once the result is written; a
    row placed after the first of its id (null ids count as one id) is a duplicate. The trim before
    the shuffle is then left out, since every row must pass the counters.
    """
    arrival = [SOURCE_FILE] if SOURCE_FILE in rows.columns else []
    order = [*arrival, "txn_datetime", "customer_id", "terminal_id", "amount", "fraud_scenario"]
    window = W.partitionBy("transaction_id").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = rows.withColumn("_rn", F.row_number().over(window))
    if observation is not None:
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in CLEAN_COLUMNS])
        placed = placed.observe(
            observation,
            F.count_if(F.col("_rn") > 1).alias("duplicate_txn_ids"),
            F.count_if(any_null).alias("null_rows"),
            F.count_if(F.col("amount") <= 0).alias("zero_amount_txns"),
            F.count_if(F.col("amount") < 0).alias("negative_amounts"),
        )
    first = placed.where(F.col("_rn") == 1)
    return first.select(*CLEAN_COLUMNS).dropna()


def observed_audit(spark, observation: Observation) -> DataFrame:
    """The audit's one row from an observation that a finished write filled."""
    got = observation.get
    names = ["duplicate_txn_ids", "null_rows", "zero_amount_txns", "negative_amounts"]
    return spark.createDataFrame([tuple(int(got[n]) for n in names)], ", ".join(f"{n} long" for n in names))


def positive_amounts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("amount") > 0)


def clean(raw: DataFrame) -> DataFrame:
    return clean_typed(typed(rename_and_prune(raw)))


def clean_typed(rows: DataFrame) -> DataFrame:
    return positive_amounts(keep_first(rows))


def clean_summary(rows: DataFrame) -> DataFrame:
    """Rows kept and fraud rate in percent."""
    n = F.count(F.lit(1))
    bad = F.sum(F.col("is_fraud").cast("bigint"))
    return rows.agg(n.alias("rows_kept"), (bad / n * F.lit(100.0)).alias("fraud_rate_pct"))


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of key, not-null and reference rules, one row per rule.

    All not-null rules of a table share one scan; keys and references are counted per key before
    anything is compared.
    """
    checks = []
    for name, df in tables.items():
        key = S.KEYS[name]
        repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        checks.append(_violations(name, "unique", key, repeated))
        checks.append(_missing_values(name, df))
    fact = tables["fact_transactions"]
    for column, parent in S.FOREIGN_KEYS.items():
        orphans = fact.select(column).distinct().join(tables[parent], column, "left_anti")
        checks.append(_violations("fact_transactions", "reference", column, orphans))
    return reduce(DataFrame.unionByName, checks)


def _violations(table: str, rule: str, column: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        "violations",
    )


def _missing_values(table: str, df: DataFrame) -> DataFrame:
    required = [f.name for f in S.TABLES[table].fields if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = [x for c in required for x in (F.lit(c), F.col(c))]
    spread = F.stack(F.lit(len(required)), *pairs).alias("column_name", "violations")
    return counts.select(
        F.lit(table).alias("table_name"), F.lit("not null").alias("rule"), spread
    )
