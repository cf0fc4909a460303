"""The star kept up day by day: landed days are merged into a written star without rebuilding history.

Beside the fact, two state tables carry what the running columns need from all earlier rows:
``state_customer`` (rows, cents spent, last time and id) and ``state_terminal`` (rows and the last
key of the terminal's numbering). A new day whose rows come after everything a customer or terminal
has seen is numbered from the state alone: only the new day folders are written, and no fact row
of earlier days is read.

A key is *late* when its new rows sort before its last seen row, or when it has rows on a day that
is landed again (a replaced day). Its whole history is then read back (only its rows, by a semi
join) and numbered again, and the days that hold changed rows are rewritten whole. The published
terminal numbering walks rows by customer, then time, so a new row of a low customer id renumbers
the terminal's later rows on earlier days: those terminals are late by that rule, and their days
are rewritten. Dimensions are aggregates of the whole fact and are derived from it again.

Transaction ids must stay unique across the star, as cleaning makes them within one load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk import schema as S
from txnrisk.functions.money import cents
from txnrisk.operators import running
from txnrisk.operators.features import (
    CUSTOMER_ORDER,
    TERMINAL_ORDERS,
    amount_bands,
    customer_history,
    customer_history_from,
    fraud_types,
    terminal_sequence,
    time_features,
)
from txnrisk.operators.running import running_columns
from txnrisk.plans.star import Star, build_from_clean, open_star, write_dimensions
from txnrisk.sources import files
from txnrisk.sources.workspace import settled

CUSTOMER_STATE = "state_customer"
TERMINAL_STATE = "state_terminal"
CUSTOMER_COLUMNS = ["cust_txn_seq", "mins_since_prev_txn", "cust_avg_amount_todate", "amount_vs_cust_avg"]


def _last(order: tuple[str, ...]) -> F.Column:
    return F.max(F.struct(*[F.col(c) for c in order]))


def _first(order: tuple[str, ...]) -> F.Column:
    return F.min(F.struct(*[F.col(c) for c in order]))


def write_states(fact: DataFrame, folder: str, terminal_order: str = "customer") -> None:
    """State tables of a whole fact: one aggregation each, no window."""
    per_customer = fact.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents()).alias("spent"),
        _last(CUSTOMER_ORDER).alias("last"),
    )
    per_terminal = fact.groupBy("terminal_id").agg(
        F.count(F.lit(1)).alias("n"), _last(TERMINAL_ORDERS[terminal_order]).alias("last")
    )
    files.write_parquet(per_customer, f"{folder}/{CUSTOMER_STATE}")
    files.write_parquet(per_terminal, f"{folder}/{TERMINAL_STATE}")


def build_with_states(rows: DataFrame, folder: str, terminal_order: str = "customer") -> Star:
    """A full build from cleaned rows that leaves state tables for later days."""
    star = build_from_clean(rows, folder, terminal_order=terminal_order)
    write_states(star.fact, folder, terminal_order)
    return star


def _late(new: DataFrame, state: DataFrame, replaced: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Keys whose new rows do not all follow their state, or that have rows on a replaced day."""
    first = new.groupBy(key).agg(_first(order).alias("first"))
    before = first.join(state.select(key, "last"), key).filter(F.col("first") <= F.col("last")).select(key)
    return before.unionByName(replaced.select(key)).distinct()


def extend_star(clean_rows: DataFrame, folder: str, terminal_order: str = "customer") -> Star:
    """Merge cleaned rows of some days into the star in ``folder`` and return the star.

    Days present in both are replaced by the new rows. The result equals a full build of the kept
    and the new rows, row for row.
    """
    spark: SparkSession = clean_rows.sparkSession
    target = f"{folder}/fact_transactions"
    fact = files.read_fact(spark, target)
    new = settled(fraud_types(amount_bands(time_features(clean_rows))))
    days = settled(new.select("date_key").distinct())
    replaced = fact.join(F.broadcast(days), "date_key", "left_semi")
    kept = fact.join(F.broadcast(days), "date_key", "left_anti")
    customer_state = spark.read.parquet(f"{folder}/{CUSTOMER_STATE}")
    terminal_state = spark.read.parquet(f"{folder}/{TERMINAL_STATE}")
    t_order = TERMINAL_ORDERS[terminal_order]
    late_c = settled(_late(new, customer_state, replaced, "customer_id", CUSTOMER_ORDER))
    late_t = settled(_late(new, terminal_state, replaced, "terminal_id", t_order))

    inputs = list(new.columns)
    # customers: late ones from their whole kept history, the rest carried on from the state
    history = kept.join(late_c, "customer_id", "left_semi").select(inputs).unionByName(
        new.join(late_c, "customer_id", "left_semi")
    )
    redone_c = customer_history(settled(history)).select("transaction_id", *CUSTOMER_COLUMNS)
    fresh = new.join(late_c, "customer_id", "left_anti")
    carried_c = customer_history_from(settled(fresh), customer_state).select("transaction_id", *CUSTOMER_COLUMNS)
    customer_part = redone_c.unionByName(carried_c)

    # terminals: the same, with the numbering's own order
    rows_t = kept.join(late_t, "terminal_id", "left_semi").select(inputs).unionByName(
        new.join(late_t, "terminal_id", "left_semi")
    )
    redone_t = terminal_sequence(settled(rows_t), terminal_order).select("transaction_id", "terminal_txn_seq")
    fresh_t = settled(new.join(late_t, "terminal_id", "left_anti"))
    local = running_columns(fresh_t, "terminal_id", t_order, {"terminal_txn_seq": running.counted()})
    carried_t = local.join(terminal_state.select("terminal_id", F.col("n").alias("_n")), "terminal_id", "left").select(
        "transaction_id", (F.col("terminal_txn_seq") + F.coalesce("_n", F.lit(0))).alias("terminal_txn_seq")
    )
    terminal_part = redone_t.unionByName(carried_t)

    # every row whose values may change, with the new values where there are any
    touched_old = kept.join(late_c, "customer_id", "left_semi").unionByName(
        kept.join(late_t, "terminal_id", "left_semi")
    ).dropDuplicates(["transaction_id"])
    renamed = {c: F.col(c).alias(f"_old_{c}") for c in [*CUSTOMER_COLUMNS, "terminal_txn_seq"]}
    old = touched_old.select(*[renamed.get(c, F.col(c)) for c in S.FACT.fieldNames()])
    blank = {f"_old_{c}": F.lit(None).cast(S.FACT[c].dataType) for c in [*CUSTOMER_COLUMNS, "terminal_txn_seq"]}
    changed = old.unionByName(new.select(inputs).withColumns(blank))
    changed = changed.join(customer_part, "transaction_id", "left").join(terminal_part, "transaction_id", "left")
    changed = changed.select(
        *[
            F.coalesce(F.col(c), F.col(f"_old_{c}")).cast(S.FACT[c].dataType).alias(c)
            if c in renamed
            else F.col(c)
            for c in S.FACT.fieldNames()
        ]
    )
    changed = settled(changed)
    touched_days = changed.select("date_key").distinct()
    others = kept.join(touched_days, "date_key", "left_semi").join(changed.select("transaction_id"), "transaction_id", "left_anti")
    rewritten = settled(changed.unionByName(others.select(S.FACT.fieldNames())))
    files.write_fact(rewritten, target)

    write_dimensions(files.read_fact(spark, target), folder)
    _merge_states(spark, folder, customer_state, terminal_state, late_c, late_t, new, terminal_order)
    return open_star(spark, folder)


def _merge_states(spark, folder, customer_state, terminal_state, late_c, late_t, new, terminal_order):
    """Late keys take the aggregate of their rows in the new fact; others add their new rows."""
    fact = files.read_fact(spark, f"{folder}/fact_transactions")
    redone_c = fact.join(late_c, "customer_id", "left_semi").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents()).alias("spent"), _last(CUSTOMER_ORDER).alias("last")
    )
    added_c = new.join(late_c, "customer_id", "left_anti").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents()).alias("spent"), _last(CUSTOMER_ORDER).alias("last")
    )
    rest_c = customer_state.join(late_c, "customer_id", "left_anti").unionByName(added_c).groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.sum("spent").alias("spent"), F.max("last").alias("last")
    )
    order = TERMINAL_ORDERS[terminal_order]
    redone_t = fact.join(late_t, "terminal_id", "left_semi").groupBy("terminal_id").agg(
        F.count(F.lit(1)).alias("n"), _last(order).alias("last")
    )
    added_t = new.join(late_t, "terminal_id", "left_anti").groupBy("terminal_id").agg(
        F.count(F.lit(1)).alias("n"), _last(order).alias("last")
    )
    rest_t = terminal_state.join(late_t, "terminal_id", "left_anti").unionByName(added_t).groupBy("terminal_id").agg(
        F.sum("n").alias("n"), F.max("last").alias("last")
    )
    customers = settled(redone_c.unionByName(rest_c))
    terminals = settled(redone_t.unionByName(rest_t))
    files.write_parquet(customers, f"{folder}/{CUSTOMER_STATE}")
    files.write_parquet(terminals, f"{folder}/{TERMINAL_STATE}")
