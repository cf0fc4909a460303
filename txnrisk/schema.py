"""Table schemas and the fixed business values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: labels, cut-offs and cost assumptions ---------------------
# Results are only right when these equal the published rule book.

BAND_UPPER = (25, 50, 100, 200, 220, 500)  # right-closed upper edges
BAND_LABELS = (
    "01 Micro (0-25)",
    "02 Small (25-50)",
    "03 Medium (50-100)",
    "04 Large (100-200)",
    "05 High (200-220)",
    "06 Very High (220-500)",
    "07 Extreme (500+)",
)
DAY_PARTS = (
    (6, "01 Night (00-06)"),
    (12, "02 Morning (06-12)"),
    (18, "03 Afternoon (12-18)"),
    (24, "04 Evening (18-24)"),
)
FRAUD_TYPES = {
    0: "Legitimate",
    1: "S1 - High Value Anomaly",
    2: "S2 - Terminal Compromise",
    3: "S3 - Account Takeover",
}
RISK_TIERS = ("1 - Critical", "2 - High", "3 - Watch", "4 - Clean")
RISK_TIER_FLOORS = (5, 2)  # percent; anything above zero is on watch
SEGMENTS = ("D - Low Value", "C - Mid Value", "B - High Value", "A - Premium")
GAP_BUCKETS = (
    (60, "a. under 1 hour"),
    (360, "b. 1-6 hours"),
    (1440, "c. 6-24 hours"),
    (4320, "d. 1-3 days"),
)
GAP_LONGEST = "e. over 3 days"
RULE_LABELS = ("R1 high amount", "R2 vs own baseline", "R3 rapid + sizeable", "not flagged")
TRIAGE_LABELS = ("P1 - call today", "P2 - this week", "P3 - monitor")
CLASS_LABELS = {1: "Fraudulent", 0: "Legitimate"}
HEADLINE_METRICS = (
    "Total transactions",
    "Total value processed",
    "Fraudulent transactions",
    "Fraud rate (%)",
    "Gross fraud loss",
    "Value at risk (%)",
    "Avg loss per incident",
    "High-risk terminals",
    "Customers impacted",
)
PARETO_RANKS = (10, 25, 50, 100, 200, 300, 500, 750, 1000, 1500, 2000)
REVIEW_CUTOFFS = (100, 150, 200, 220, 250, 300, 400, 500)
REVIEW_SWEEP = range(20, 601, 10)
DEFAULT_THRESHOLD = 200
NAIVE_THRESHOLD = 100
REVIEW_COST = 3.0
DECLINE_COST = 12.0
RECOVERY_RATE = 0.75
REVIEW_COST_GRID = (1.5, 3.0, 6.0)
DECLINE_COST_GRID = (6.0, 12.0, 24.0)
STABLE_RANGE = 40
WILSON_Z = 1.959964
NORMALITY_DRAWS = 5000
SEED = 42

# --- table schemas ----------------------------------------------------------

MONEY = T.DecimalType(12, 2)


def _struct(required: str, **fields) -> T.StructType:
    must = set(required.split())
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
        "date": T.DateType(),
        "ts": T.TimestampNTZType(),
        "money": MONEY,
    }
    return T.StructType([T.StructField(n, kinds[k], n not in must) for n, k in fields.items()])


RAW = _struct(
    "",
    TRANSACTION_ID="long",
    TX_DATETIME="ts",
    CUSTOMER_ID="long",
    TERMINAL_ID="long",
    TX_AMOUNT="double",
    TX_FRAUD="int",
    TX_FRAUD_SCENARIO="int",
)

FACT = _struct(
    "transaction_id txn_datetime date_key customer_id terminal_id amount is_fraud",
    transaction_id="long",
    txn_datetime="ts",
    date_key="int",
    customer_id="long",
    terminal_id="long",
    amount="money",
    amount_band="string",
    txn_hour="int",
    part_of_day="string",
    is_fraud="int",
    fraud_scenario="int",
    fraud_type="string",
    cust_txn_seq="long",
    mins_since_prev_txn="double",
    cust_avg_amount_todate="double",
    amount_vs_cust_avg="double",
    terminal_txn_seq="long",
)

DIM_DATE = _struct(
    "date_key date",
    date_key="int",
    date="date",
    year="int",
    month_no="int",
    month_name="string",
    week_no="int",
    day_name="string",
    day_of_week="int",
    is_weekend="string",
)

DIM_CUSTOMER = _struct(
    "customer_id",
    customer_id="long",
    total_txns="long",
    total_spend="double",
    avg_txn_amount="double",
    max_txn_amount="double",
    first_seen="ts",
    last_seen="ts",
    fraud_txns="long",
    fraud_rate_pct="double",
    active_days="long",
    txns_per_day="double",
    value_segment="string",
    ever_compromised="string",
)

DIM_TERMINAL = _struct(
    "terminal_id",
    terminal_id="long",
    total_txns="long",
    total_volume="double",
    avg_txn_amount="double",
    unique_customers="long",
    fraud_txns="long",
    fraud_volume="double",
    fraud_rate_pct="double",
    risk_tier="string",
)

DIM_BAND = _struct(
    "amount_band",
    amount_band="string",
    txns="long",
    fraud_txns="long",
    total_value="double",
    fraud_rate_pct="double",
    pct_of_all_txns="double",
)

TABLES = {
    "fact_transactions": FACT,
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_terminal": DIM_TERMINAL,
    "dim_amount_band": DIM_BAND,
}

KEYS = {
    "fact_transactions": "transaction_id",
    "dim_date": "date_key",
    "dim_customer": "customer_id",
    "dim_terminal": "terminal_id",
    "dim_amount_band": "amount_band",
}

# child column -> parent table; the band link exists only in the reporting model
FOREIGN_KEYS = {
    "date_key": "dim_date",
    "customer_id": "dim_customer",
    "terminal_id": "dim_terminal",
}
