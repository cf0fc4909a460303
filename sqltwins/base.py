"""DuckDB common table expressions that derive the star schema from the supplied tables."""

from __future__ import annotations

from txnrisk import schema as S

RAW_EVENTS = """
raw AS (
  SELECT event_id AS transaction_id, ts AS txn_datetime, user_id AS customer_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS terminal_id,
         value AS raw_amount,
         CASE WHEN value > 220 THEN 1
              WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 20 = 3 AND event_type = 'error' THEN 2
              WHEN user_id % 25 = 7 AND event_type IN ('purchase', 'signup') THEN 3
              ELSE 0 END AS fraud_scenario
  FROM events)"""

RAW_ORDERS = """
raw AS (
  SELECT o_orderkey AS transaction_id, CAST(o_orderdate AS TIMESTAMP) AS txn_datetime,
         o_custkey AS customer_id, o_custkey % 97 AS terminal_id, o_totalprice AS raw_amount,
         CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 + o_orderkey % 3 AS INTEGER)
              ELSE 0 END AS fraud_scenario
  FROM orders)"""

RAW_LINEITEM = """
raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id,
         CAST(l_shipdate AS TIMESTAMP) AS txn_datetime, l_suppkey AS customer_id,
         l_partkey AS terminal_id, l_extendedprice AS raw_amount, 0 AS fraud_scenario
  FROM lineitem)"""

TYPED = """
typed AS (
  SELECT transaction_id, txn_datetime, customer_id, terminal_id,
         CAST(round_even(raw_amount, 2) AS DECIMAL(12,2)) AS amount,
         CAST(fraud_scenario > 0 AS INTEGER) AS is_fraud,
         CAST(fraud_scenario AS INTEGER) AS fraud_scenario
  FROM raw)"""

FIRST = """
first_rows AS (
  SELECT transaction_id, txn_datetime, customer_id, terminal_id, amount, is_fraud, fraud_scenario
  FROM (SELECT *, row_number() OVER (
               PARTITION BY transaction_id
               ORDER BY txn_datetime, customer_id, terminal_id, amount, fraud_scenario) AS rn
        FROM typed)
  WHERE rn = 1 AND txn_datetime IS NOT NULL AND customer_id IS NOT NULL
    AND terminal_id IS NOT NULL AND amount IS NOT NULL)"""

CLEAN = """
clean AS (SELECT * FROM first_rows WHERE amount > 0)"""


def _case(pairs, last: str) -> str:
    whens = " ".join(f"WHEN {test} THEN '{label}'" for test, label in pairs)
    return f"CASE {whens} ELSE '{last}' END"


def band(amount: str) -> str:
    pairs = [(f"{amount} <= {u}", b) for u, b in zip(S.BAND_UPPER, S.BAND_LABELS)]
    return _case(pairs, S.BAND_LABELS[-1])


def day_part(hour: str) -> str:
    pairs = [(f"{hour} < {h}", name) for h, name in S.DAY_PARTS[:-1]]
    return _case(pairs, S.DAY_PARTS[-1][1])


def typology(scenario: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.FRAUD_TYPES.items())
    return f"CASE {scenario} {whens} END"


def tier(rate: str) -> str:
    a, b, c, d = S.RISK_TIERS
    return f"CASE WHEN {rate} >= 5 THEN '{a}' WHEN {rate} >= 2 THEN '{b}' WHEN {rate} > 0 THEN '{c}' ELSE '{d}' END"


FACT = f"""
walked AS (
  SELECT *,
         row_number() OVER cust AS cust_txn_seq,
         lag(txn_datetime) OVER cust AS prev_at,
         sum(amount) OVER (PARTITION BY customer_id ORDER BY txn_datetime, transaction_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
         row_number() OVER (PARTITION BY terminal_id
                            ORDER BY customer_id, txn_datetime, transaction_id) AS terminal_txn_seq
  FROM clean
  WINDOW cust AS (PARTITION BY customer_id ORDER BY txn_datetime, transaction_id)),
averaged AS (
  SELECT *, round_even(CAST(spent AS DOUBLE) / (cust_txn_seq - 1), 2) AS cust_avg_amount_todate
  FROM walked),
fact AS (
  SELECT transaction_id, txn_datetime,
         CAST(strftime(txn_datetime, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(txn_datetime AS DATE) AS txn_day,
         customer_id, terminal_id, amount, {band('amount')} AS amount_band,
         CAST(hour(txn_datetime) AS INTEGER) AS txn_hour,
         {day_part('hour(txn_datetime)')} AS part_of_day,
         is_fraud, fraud_scenario, {typology('fraud_scenario')} AS fraud_type,
         cust_txn_seq,
         round_even(CAST(epoch_us(txn_datetime) - epoch_us(prev_at) AS DOUBLE) / 1e6 / 60e0, 1)
           AS mins_since_prev_txn,
         CASE WHEN cust_txn_seq > 1 THEN cust_avg_amount_todate END AS cust_avg_amount_todate,
         CASE WHEN cust_txn_seq > 1 THEN
           round_even(CAST(amount AS DOUBLE) / nullif(cust_avg_amount_todate, 0), 2) END
           AS amount_vs_cust_avg,
         terminal_txn_seq
  FROM averaged)"""

DIM_DATE = """
dim_date AS (
  SELECT date_key, txn_day AS date, CAST(year(txn_day) AS INTEGER) AS year,
         CAST(month(txn_day) AS INTEGER) AS month_no, strftime(txn_day, '%b %Y') AS month_name,
         CAST(weekofyear(txn_day) AS INTEGER) AS week_no, dayname(txn_day) AS day_name,
         CAST(isodow(txn_day) AS INTEGER) AS day_of_week,
         CASE WHEN isodow(txn_day) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS is_weekend
  FROM (SELECT DISTINCT date_key, txn_day FROM fact))"""

CUSTOMER_TOTALS = """
customer_totals AS (
  SELECT customer_id, count(*) AS total_txns, CAST(sum(amount) AS DOUBLE) AS total_spend,
         round_even(CAST(sum(amount) AS DOUBLE) / count(*), 2) AS avg_txn_amount,
         CAST(max(amount) AS DOUBLE) AS max_txn_amount,
         min(txn_datetime) AS first_seen, max(txn_datetime) AS last_seen,
         CAST(sum(is_fraud) AS BIGINT) AS fraud_txns,
         round_even(CAST(sum(is_fraud) AS DOUBLE) / count(*) * 100e0, 3) AS fraud_rate_pct,
         (epoch_us(max(txn_datetime)) - epoch_us(min(txn_datetime))) // 86400000000 + 1 AS active_days,
         round_even(CAST(count(*) AS DOUBLE)
           / ((epoch_us(max(txn_datetime)) - epoch_us(min(txn_datetime))) // 86400000000 + 1), 2)
           AS txns_per_day
  FROM fact GROUP BY customer_id)"""


def _edge(q: float) -> str:
    at = f"((n - 1) * {q}e0)"
    lo = f"max(CASE WHEN place = floor{at} THEN total_spend END)"
    hi = f"max(CASE WHEN place = ceil{at} THEN total_spend END)"
    return f"{lo} + ({hi} - {lo}) * max({at} - floor{at})"


DIM_CUSTOMER = f"""
spend_order AS (
  SELECT total_spend, row_number() OVER (ORDER BY total_spend) - 1 AS place, count(*) OVER () AS n
  FROM customer_totals),
spend_edges AS (
  SELECT {_edge(0.25)} AS q1, {_edge(0.5)} AS q2, {_edge(0.75)} AS q3 FROM spend_order),
dim_customer AS (
  SELECT c.*,
         CASE WHEN total_spend <= q1 THEN '{S.SEGMENTS[0]}' WHEN total_spend <= q2 THEN '{S.SEGMENTS[1]}'
              WHEN total_spend <= q3 THEN '{S.SEGMENTS[2]}' ELSE '{S.SEGMENTS[3]}' END AS value_segment,
         CASE WHEN fraud_txns > 0 THEN 'Yes' ELSE 'No' END AS ever_compromised
  FROM customer_totals c, spend_edges)"""

DIM_TERMINAL = f"""
terminal_totals AS (
  SELECT terminal_id, count(*) AS total_txns, CAST(sum(amount) AS DOUBLE) AS total_volume,
         round_even(CAST(sum(amount) AS DOUBLE) / count(*), 2) AS avg_txn_amount,
         count(DISTINCT customer_id) AS unique_customers,
         CAST(sum(is_fraud) AS BIGINT) AS fraud_txns,
         coalesce(CAST(sum(amount) FILTER (WHERE is_fraud = 1) AS DOUBLE), 0) AS fraud_volume,
         round_even(CAST(sum(is_fraud) AS DOUBLE) / count(*) * 100e0, 3) AS fraud_rate_pct
  FROM fact GROUP BY terminal_id),
dim_terminal AS (SELECT *, {tier('fraud_rate_pct')} AS risk_tier FROM terminal_totals)"""

DIM_BAND = """
dim_amount_band AS (
  SELECT amount_band, count(*) AS txns, CAST(sum(is_fraud) AS BIGINT) AS fraud_txns,
         CAST(sum(amount) AS DOUBLE) AS total_value,
         round_even(CAST(sum(is_fraud) AS DOUBLE) / count(*) * 100e0, 3) AS fraud_rate_pct,
         round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fact) * 100e0, 2)
           AS pct_of_all_txns
  FROM fact GROUP BY amount_band)"""

PARTS = (TYPED, FIRST, CLEAN, FACT, DIM_DATE, CUSTOMER_TOTALS, DIM_CUSTOMER, DIM_TERMINAL, DIM_BAND)
NAMES = ("typed", "first_rows", "clean", "fact", "dim_date", "customer_totals", "dim_customer",
         "dim_terminal", "dim_amount_band")


def with_tables(body: str, raw: str = RAW_EVENTS, upto: str | None = None, extra: str = "") -> str:
    """Prefix ``body`` with the derivation of the tables it reads."""
    parts = [raw]
    if upto != "raw":
        parts += PARTS[: NAMES.index(upto or "dim_amount_band") + 1]
    if extra:
        parts.append("\n" + extra.strip())
    return "WITH" + ",".join(parts) + "\n" + body.strip()
