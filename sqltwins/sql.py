"""One independent SQL statement per registered query, for a side-by-side check in DuckDB."""

from __future__ import annotations

from sqltwins.base import RAW_EVENTS, RAW_LINEITEM, RAW_ORDERS, with_tables
from txnrisk import schema as S

FACT_COLUMNS = (
    "transaction_id, txn_datetime, date_key, customer_id, terminal_id, CAST(amount AS DOUBLE) AS amount, "
    "amount_band, txn_hour, part_of_day, is_fraud, fraud_scenario, fraud_type, cust_txn_seq, "
    "mins_since_prev_txn, cust_avg_amount_todate, amount_vs_cust_avg, terminal_txn_seq"
)
RAW_COLUMNS = (
    "transaction_id, txn_datetime, customer_id, terminal_id, CAST(raw_amount AS DOUBLE) AS amount, "
    "CAST(fraud_scenario > 0 AS INTEGER) AS is_fraud, CAST(fraud_scenario AS INTEGER) AS fraud_scenario"
)
CLEAN_COLUMNS = (
    "transaction_id, txn_datetime, customer_id, terminal_id, CAST(amount AS DOUBLE) AS amount, "
    "is_fraud, fraud_scenario"
)


# calendar days leave as ISO text, as in the published tables
DATE_OUTPUTS = {
    "d01_dim_date": "date",
    "s04_csv_dim_date": "date",
    "s10_enriched_view": "date",
    "s10_catalog_view": "date",
    "s11_slice_reader": "txn_date",
    "q11_attack_windows": "first_fraud_day last_fraud_day",
    "q11_attack_windows_top3": "first_fraud_day last_fraud_day",
    "q16_daily_trend": "txn_date",
    "q17_weekly_movement": "week_start",
    "q17_weekly_movement_orders": "week_start",
    "q17_weekly_movement_by_iso_year": "week_start",
    "q18_alert_days": "txn_date",
    "q18_alert_days_one_sigma": "txn_date",
    "m05_fraud_loss": "date",
    "m15_fraud_rate_7d": "date",
    "m15_fraud_rate_7d_orders": "date",
    "m15_fraud_rate_7d_filtered": "date",
    "m16_running_loss": "date",
    "r04_daily": "txn_date",
    "r09_stratified_extract": "date",
    "r09_stratified_extract_small": "date",
    "r13_portfolio_header": "first_day last_day",
}


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct(a: str, b: str, digits: int | None = None) -> str:
    x = f"(100e0 * {dbl(a)} / nullif({dbl(b)}, 0))"
    return x if digits is None else f"round({x}, {digits})"


VALUE = "sum(amount)"
LOSS = "coalesce(sum(amount) FILTER (WHERE is_fraud = 1), 0)"
BAD = "CAST(sum(is_fraud) AS BIGINT)"


def build_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    t = with_tables

    # --- cleaning and features ---------------------------------------------------------------
    q["t01_rename_prune"] = t(f"SELECT {RAW_COLUMNS} FROM raw", upto="raw")
    q["t02_typed"] = t(f"SELECT {CLEAN_COLUMNS} FROM typed", upto="typed")
    audit = """
      SELECT count(*) - count(DISTINCT transaction_id) AS duplicate_txn_ids,
             count(*) FILTER (WHERE transaction_id IS NULL OR txn_datetime IS NULL
               OR customer_id IS NULL OR terminal_id IS NULL OR amount IS NULL) AS null_rows,
             count(*) FILTER (WHERE amount <= 0) AS zero_amount_txns,
             count(*) FILTER (WHERE amount < 0) AS negative_amounts
      FROM typed"""
    q["t03_quality_audit"] = t(audit, upto="typed")
    q["t03_observed_audit"] = q["t03_quality_audit"]
    q["t03_quality_audit_lineitem"] = t(audit, raw=RAW_LINEITEM, upto="typed")
    q["t04_keep_first"] = t(f"SELECT {CLEAN_COLUMNS} FROM first_rows", upto="first_rows")
    q["t04_keep_first_lineitem"] = t(
        f"SELECT {CLEAN_COLUMNS} FROM first_rows", raw=RAW_LINEITEM, upto="first_rows"
    )
    q["t05_positive_amounts"] = t(f"SELECT {CLEAN_COLUMNS} FROM clean", upto="clean")
    # some rows lack a time or an amount, a third has an amount of zero or less
    gaps = RAW_EVENTS.replace("raw AS (", "whole AS (") + """,
raw AS (
  SELECT transaction_id, CASE WHEN transaction_id % 97 <> 0 THEN txn_datetime END AS txn_datetime, customer_id, terminal_id,
         CASE WHEN transaction_id % 101 <> 0 THEN
           CASE WHEN transaction_id % 6 = 1 OR transaction_id % 3 = 2 THEN raw_amount
                WHEN transaction_id % 3 = 0 THEN -raw_amount ELSE 0 END END AS raw_amount, fraud_scenario
  FROM whole)"""
    q["t03_quality_audit_gaps"] = t(audit, raw=gaps, upto="typed")
    q["t03_observed_audit_gaps"] = q["t03_quality_audit_gaps"]
    q["t04_keep_first_gaps"] = q["t04_keep_first"].replace(RAW_EVENTS, gaps)
    q["t05_positive_amounts_gaps"] = t(f"SELECT {CLEAN_COLUMNS} FROM clean", raw=gaps, upto="clean")
    for key, columns in {
        "t06_date_key_hour": "date_key, txn_hour",
        "t07_part_of_day": "txn_hour, part_of_day",
        "t08_amount_band": "CAST(amount AS DOUBLE) AS amount, amount_band",
        "t09_customer_sequence": "customer_id, cust_txn_seq",
        "t10_minutes_since_previous": "customer_id, mins_since_prev_txn",
        "t11_expanding_mean": "customer_id, cust_avg_amount_todate",
        "t12_ratio_to_baseline": "customer_id, amount_vs_cust_avg",
        "t13_terminal_sequence": "terminal_id, terminal_txn_seq",
        "t14_fraud_type": "fraud_scenario, fraud_type",
    }.items():
        q[key] = t(f"SELECT transaction_id, {columns} FROM fact", upto="fact")
    q["t13_terminal_sequence_by_time"] = t(
        """SELECT transaction_id, terminal_id,
                  row_number() OVER (PARTITION BY terminal_id ORDER BY txn_datetime, transaction_id)
                    AS terminal_txn_seq
           FROM fact""",
        upto="fact",
    )
    q["t15_time_sorted"] = t(
        f"SELECT {FACT_COLUMNS} FROM fact ORDER BY txn_datetime, transaction_id", upto="fact"
    )
    q["t16_clean_summary"] = t(
        f"SELECT count(*) AS rows_kept, round({dbl('sum(is_fraud)')} / count(*) * 100, 6) AS fraud_rate_pct FROM clean",
        upto="clean",
    )

    # --- dimensions --------------------------------------------------------------------------
    q["d01_dim_date"] = t("SELECT * FROM dim_date", upto="dim_date")
    q["d02_customer_totals"] = t("SELECT * FROM customer_totals", upto="customer_totals")
    q["d03_dim_customer"] = t("SELECT * FROM dim_customer", upto="dim_customer")
    terminal = "SELECT * FROM dim_terminal"
    q["d04_dim_terminal"] = t(terminal, upto="dim_terminal")
    q["d05_risk_tier"] = t(
        "SELECT terminal_id, fraud_rate_pct, risk_tier FROM dim_terminal", upto="dim_terminal"
    )
    q["d06_dim_amount_band"] = t("SELECT * FROM dim_amount_band")
    q["d06_dim_amount_band_orders"] = t("SELECT * FROM dim_amount_band", raw=RAW_ORDERS)

    # --- sources and sinks: the table that makes the round trip --------------------------------
    fact = t(f"SELECT {FACT_COLUMNS} FROM fact", upto="fact")
    q["s01_daily_scan"] = q["t01_rename_prune"]
    q["s01_daily_scan_csv"] = q["s01_daily_scan_text_ids"] = q["t02_typed"]
    q["s01_daily_scan_mixed"] = q["s01_daily_scan_mixed_csv"] = q["t02_typed"]
    q["s02_landing_null_time"] = (
        f"SELECT * REPLACE (CASE WHEN transaction_id % 97 <> 0 THEN txn_datetime END AS txn_datetime)\nFROM ({q['t01_rename_prune']})"
    )
    q["t02_quarantine"] = (
        "SELECT transaction_id, CASE WHEN transaction_id % 89 = 0 THEN 'set aside' ELSE 'kept' END AS state\n"
        f"FROM ({q['t01_rename_prune']})"
    )
    q["s02_landing"] = q["t01_rename_prune"]
    q["s02_landing_replace"] = q["t01_rename_prune"]
    q["s02_landing_stream"] = q["t01_rename_prune"]
    q["s02_landing_mixed"] = q["t01_rename_prune"]
    q["s03_fact_parquet"] = fact
    q["s04_csv_round_trip"] = q["d03_dim_customer"]
    q["s04_csv_dim_date"] = q["d01_dim_date"]
    q["s04_csv_dim_terminal"] = q["d04_dim_terminal"]
    q["s04_csv_dim_amount_band"] = q["d06_dim_amount_band"]
    q["s04_csv_audit"] = q["t03_quality_audit"]
    q["s05_fact_csv"] = fact
    q["s07_table_scan"] = fact
    q["s08_star_build"] = t(
        """SELECT 'fact_transactions' AS table_name, count(*) AS row_count FROM fact
           UNION ALL SELECT 'dim_date', count(*) FROM dim_date
           UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
           UNION ALL SELECT 'dim_terminal', count(*) FROM dim_terminal
           UNION ALL SELECT 'dim_amount_band', count(*) FROM dim_amount_band"""
    )
    q["s08_star_increment"] = fact
    q["s03_terminal_lookup"] = t(
        f"""SELECT {FACT_COLUMNS} FROM fact WHERE terminal_id IN
              (SELECT terminal_id FROM dim_terminal ORDER BY fraud_volume DESC, terminal_id LIMIT 15)"""
    )
    q["s09_constraints"] = t(_constraints())
    q["s10_enriched_view"] = t(
        """SELECT transaction_id, txn_datetime, date, month_name, day_name, is_weekend,
                  f.customer_id, value_segment, f.terminal_id, risk_tier AS terminal_risk_tier,
                  CAST(amount AS DOUBLE) AS amount, amount_band, txn_hour, part_of_day,
                  amount_vs_cust_avg, mins_since_prev_txn, is_fraud, fraud_type
           FROM fact f JOIN dim_date USING (date_key)
           JOIN dim_customer c ON c.customer_id = f.customer_id
           JOIN dim_terminal m ON m.terminal_id = f.terminal_id"""
    )

    q["s10_catalog_view"] = q["s10_enriched_view"]

    _questions(q)
    _significance(q)
    _decisions(q)
    _measures(q)
    _slices(q)
    q["s11_slice_reader"] = q["r04_daily"]
    q["s04_csv_sweep"] = q["x01_threshold_sweep"]
    q["s04_csv_sensitivity"] = q["x04_sensitivity"]
    q["m24_selection_rule"] = t(
        f"""SELECT options, CASE WHEN count(DISTINCT threshold) = 1 THEN max(threshold) ELSE {S.DEFAULT_THRESHOLD} END
                     AS selected_threshold
            FROM (VALUES ('none', -1, -1), ('one', 100, 100), ('several', 100, 200)) AS o(options, low, high)
            LEFT JOIN (SELECT DISTINCT CAST(floor(amount / 100) AS INTEGER) * 100 AS threshold FROM fact) f
              ON threshold BETWEEN low AND high GROUP BY options""",
        upto="fact",
    )
    q["s06_json_results"] = t(
        f"""SELECT (SELECT u FROM u) AS u_statistic,
                   (SELECT round(chi2, 6) FROM chi) AS chi2_timing, (SELECT round(chi2, 6) FROM chi_b) AS chi2_band,
                   (SELECT {BAD} FROM fact) AS successes,
                   (SELECT threshold FROM best) AS optimal_threshold, (SELECT net_benefit FROM best) AS net_benefit,
                   (SELECT CAST(count(*) AS INTEGER) FROM grid) AS scenarios,
                   (SELECT max(optimal_threshold) - min(optimal_threshold) <= 40 FROM grid) AS stable,
                   (SELECT min(optimal_threshold) || '-' || max(optimal_threshold) FROM grid) AS threshold_range,
                   (SELECT round_even({BAD} * 1e0 / count(*) * 100, 3) FROM fact
                     WHERE part_of_day = (SELECT min(part_of_day) FROM fact)) AS first_period_rate,
                   (SELECT round(sqrt(b.chi2 / (b.n * least(b.levels - 1, 1))) / sqrt(c.chi2 / (c.n * least(c.levels - 1, 1))), 6)
                      FROM (SELECT (SELECT chi2 FROM chi_b) AS chi2, count(*) AS n, count(DISTINCT amount_band) AS levels FROM fact) b,
                           (SELECT (SELECT chi2 FROM chi) AS chi2, count(*) AS n, count(DISTINCT part_of_day) AS levels FROM fact) c)
                     AS strength_vs_timing,
                   {S.REVIEW_COST}e0 AS cost_per_review, {S.DECLINE_COST}e0 AS cost_false_decline,
                   {S.RECOVERY_RATE}e0 AS recovery_rate,
                   count(*) AS frauds_missed, CAST(count(DISTINCT fraud_type) AS INTEGER) AS types_missed
            FROM fact WHERE is_fraud = 1 AND amount < (SELECT threshold FROM best)""",
        upto="fact",
        extra=", ".join([RANKS, _chi("part_of_day"), _chi("amount_band", "_b"), SWEEP, BEST, GRID]),
    )
    q["q04_band_lift_orders"] = q["q04_band_lift"].replace(RAW_EVENTS, RAW_ORDERS)
    q["q11_attack_windows_top3"] = q["q11_attack_windows"].replace("LIMIT 15", "LIMIT 3")
    q["r16_watchlist_view_top5"] = q["r16_watchlist_view"].replace("LIMIT 300", "LIMIT 30").replace("LIMIT 60", "LIMIT 5")
    q["r19_terminal_pareto_top10"] = q["r19_terminal_pareto_top"].replace("LIMIT 100", "LIMIT 10")
    for key, columns in DATE_OUTPUTS.items():
        as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns.split())
        q[key] = f"SELECT * REPLACE ({as_text})\nFROM ({q[key]})"
    return q


def _constraints() -> str:
    rows = []
    for name, schema in S.TABLES.items():
        table = {"fact_transactions": "fact"}.get(name, name)
        key = S.KEYS[name]
        rows.append(
            f"SELECT '{name}' AS table_name, 'unique' AS rule, '{key}' AS column_name, "
            f"(SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)) AS violations"
        )
        for field in schema.fields:
            if not field.nullable:
                rows.append(
                    f"SELECT '{name}', 'not null', '{field.name}', "
                    f"(SELECT count(*) FROM {table} WHERE {field.name} IS NULL)"
                )
    for column, parent in S.FOREIGN_KEYS.items():
        rows.append(
            f"SELECT 'fact_transactions', 'reference', '{column}', "
            f"(SELECT count(DISTINCT {column}) FROM fact WHERE {column} NOT IN (SELECT {column} FROM {parent}))"
        )
    return "\nUNION ALL ".join(rows)


def _questions(q: dict[str, str]) -> None:
    t = with_tables
    q["q01_portfolio_totals"] = t(
        f"""SELECT count(*) AS total_txns, count(DISTINCT customer_id) AS customers,
                   count(DISTINCT terminal_id) AS terminals, round({dbl(VALUE)}, 2) AS total_value,
                   {BAD} AS fraud_txns, {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct,
                   round({dbl('sum(amount) FILTER (WHERE is_fraud = 1)')}, 2) AS fraud_value,
                   {pct(LOSS, VALUE, 3)} AS value_at_risk_pct
            FROM fact""",
        upto="fact",
    )
    q["q02_class_profile"] = t(
        f"""SELECT CASE WHEN is_fraud = 1 THEN 'Fraudulent' ELSE 'Legitimate' END AS txn_class,
                   count(*) AS txns,
                   {pct('count(*)', '(SELECT count(*) FROM fact)', 3)} AS pct_of_txns,
                   round({dbl(VALUE)} / count(*), 2) AS avg_amount,
                   {dbl('min(amount)')} AS min_amount, {dbl('max(amount)')} AS max_amount,
                   round({dbl(VALUE)}, 2) AS total_value,
                   {pct(VALUE, '(SELECT sum(amount) FROM fact)', 3)} AS pct_of_value
            FROM fact GROUP BY is_fraud""",
        upto="fact",
    )
    q["q03_loss_by_type"] = t(
        f"""SELECT fraud_type, count(*) AS incidents, round({dbl(VALUE)}, 2) AS loss_value,
                   round({dbl(VALUE)} / count(*), 2) AS avg_loss,
                   count(DISTINCT customer_id) AS customers_hit,
                   count(DISTINCT terminal_id) AS terminals_involved,
                   {pct(VALUE, '(SELECT sum(amount) FROM fact WHERE is_fraud = 1)', 2)} AS pct_of_total_loss
            FROM fact WHERE is_fraud = 1 GROUP BY fraud_type""",
        upto="fact",
    )
    q["q04_band_lift"] = t(
        f"""SELECT amount_band, count(*) AS txns, {BAD} AS fraud_txns,
                   {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct,
                   round({dbl(LOSS)}, 2) AS fraud_value,
                   round(({dbl('sum(is_fraud)')} / count(*))
                     / (SELECT {dbl('sum(is_fraud)')} / count(*) FROM fact), 2) AS risk_lift
            FROM fact GROUP BY amount_band""",
        upto="fact",
    )
    q["q05_band_coverage"] = t(
        f"""SELECT b.amount_band, max(b.txns) AS txns, round({dbl('max(b.loss)')}, 2) AS fraud_value,
                   round({dbl('sum(o.loss)')}, 2) AS cum_fraud_value,
                   {pct('sum(o.loss)', '(SELECT sum(loss) FROM bands)', 2)} AS cum_pct_of_loss,
                   {pct('sum(o.txns)', '(SELECT sum(txns) FROM bands)', 2)} AS cum_pct_of_txns
            FROM bands b JOIN bands o ON o.amount_band >= b.amount_band
            GROUP BY b.amount_band""",
        upto="fact",
        extra=f"bands AS (SELECT amount_band, count(*) AS txns, {LOSS} AS loss FROM fact GROUP BY ALL)",
    )
    q["q06_hourly_rate"] = t(
        f"""SELECT txn_hour, count(*) AS txns, {BAD} AS fraud_txns,
                   {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct,
                   round({dbl('sum(amount) FILTER (WHERE is_fraud = 1)')} / nullif(sum(is_fraud), 0), 2)
                     AS avg_fraud_amount,
                   CASE WHEN {dbl('sum(is_fraud)')} / count(*)
                          > (SELECT {dbl('sum(is_fraud)')} / count(*) FROM fact)
                        THEN 'ABOVE BASELINE' ELSE 'normal' END AS status
            FROM fact GROUP BY txn_hour""",
        upto="fact",
    )
    q["q07_weekday_rate"] = t(
        f"""SELECT is_weekend, day_name, count(*) AS txns, {BAD} AS fraud_txns,
                   {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct,
                   round({dbl(LOSS)}, 2) AS fraud_value
            FROM fact JOIN dim_date USING (date_key) GROUP BY is_weekend, day_name, day_of_week""",
        upto="dim_date",
    )
    q["q08_terminal_worklist"] = t(
        """SELECT terminal_id, total_txns, fraud_txns, fraud_rate_pct, round(fraud_volume, 2) AS fraud_volume,
                  unique_customers, risk_tier, CAST(rank() OVER (ORDER BY fraud_volume DESC) AS INTEGER) AS loss_rank
           FROM dim_terminal WHERE fraud_txns > 0 ORDER BY fraud_volume DESC, terminal_id LIMIT 20""",
        upto="dim_terminal",
    )
    ranks = ", ".join(map(str, S.PARETO_RANKS))
    q["q09_concentration"] = t(
        f"""SELECT CAST(rn AS INTEGER) AS terminals_reviewed,
                   {pct('rn', '(SELECT count(*) FROM dim_terminal)', 2)} AS pct_of_all_terminals,
                   round({dbl('cum')}, 2) AS cum_fraud_recovered, {pct('cum', 'total', 2)} AS cum_pct_of_loss
            FROM placed WHERE rn IN ({ranks})""",
        upto="dim_terminal",
        extra="""placed AS (
            SELECT row_number() OVER o AS rn, sum(CAST(fraud_volume AS DECIMAL(18,2))) OVER (
                     ORDER BY fraud_volume DESC, terminal_id ROWS UNBOUNDED PRECEDING) AS cum,
                   sum(CAST(fraud_volume AS DECIMAL(18,2))) OVER () AS total
            FROM dim_terminal WHERE fraud_volume > 0
            WINDOW o AS (ORDER BY fraud_volume DESC, terminal_id))""",
    )
    money_sum = "sum(CAST(fraud_volume AS DECIMAL(18,2)))"
    q["q10_tier_queues"] = t(
        f"""SELECT risk_tier, count(*) AS terminals, {big('sum(total_txns)')} AS txns_covered,
                   {big('sum(fraud_txns)')} AS fraud_txns, round({dbl(money_sum)}, 2) AS fraud_volume,
                   {pct(money_sum, f'(SELECT {money_sum} FROM dim_terminal)', 2)} AS pct_of_loss
            FROM dim_terminal GROUP BY risk_tier""",
        upto="dim_terminal",
    )
    q["q11_attack_windows"] = t(
        """SELECT terminal_id, first_fraud_day, last_fraud_day,
                  CAST(last_fraud_day - first_fraud_day + 1 AS INTEGER) AS attack_window_days,
                  fraud_txns, fraud_value,
                  round(fraud_value / (last_fraud_day - first_fraud_day + 1), 2) AS loss_per_day
           FROM attacks ORDER BY fraud_value DESC, terminal_id LIMIT 15""",
        upto="fact",
        extra=f"""attacks AS (
            SELECT terminal_id, min(txn_day) AS first_fraud_day, max(txn_day) AS last_fraud_day,
                   count(*) AS fraud_txns, round({dbl(VALUE)}, 2) AS fraud_value
            FROM fact WHERE fraud_scenario = 2 GROUP BY terminal_id)""",
    )
    spend = "sum(CAST(total_spend AS DECIMAL(18,2)))"
    q["q12_segment_risk"] = t(
        f"""SELECT value_segment, count(DISTINCT customer_id) AS customers, {big('sum(total_txns)')} AS txns,
                   round({dbl(spend)}, 2) AS spend, {big('sum(fraud_txns)')} AS fraud_txns,
                   {pct('sum(fraud_txns)', 'sum(total_txns)', 3)} AS fraud_rate_pct,
                   count(*) FILTER (WHERE ever_compromised = 'Yes') AS customers_hit,
                   {pct("count(*) FILTER (WHERE ever_compromised = 'Yes')", 'count(*)', 2)} AS pct_customers_hit
            FROM dim_customer GROUP BY value_segment""",
        upto="dim_customer",
    )
    q["q13_baseline_ratio"] = t(
        f"""SELECT CASE WHEN is_fraud = 1 THEN 'Fraudulent' ELSE 'Legitimate' END AS txn_class, count(*) AS txns,
                   round({dbl('sum(CAST(amount_vs_cust_avg AS DECIMAL(18,2)))')} / count(*), 2)
                     AS avg_ratio_to_own_baseline,
                   round(max(amount_vs_cust_avg), 2) AS max_ratio,
                   count(*) FILTER (WHERE amount_vs_cust_avg > 3) AS over_3x_baseline,
                   {pct('count(*) FILTER (WHERE amount_vs_cust_avg > 3)', 'count(*)', 2)} AS pct_over_3x
            FROM fact WHERE amount_vs_cust_avg IS NOT NULL GROUP BY is_fraud""",
        upto="fact",
    )
    q["q14_repeat_victims"] = t(
        f"""SELECT fraud_txns AS times_defrauded, count(*) AS customers,
                   round({dbl(spend)} / count(*), 2) AS avg_lifetime_spend,
                   {pct('count(*)', '(SELECT count(*) FROM dim_customer WHERE fraud_txns > 0)', 2)} AS pct_of_victims
            FROM dim_customer WHERE fraud_txns > 0 GROUP BY fraud_txns""",
        upto="dim_customer",
    )
    steps = " ".join(f"WHEN mins_since_prev_txn < {m} THEN '{name}'" for m, name in S.GAP_BUCKETS)
    q["q15_velocity"] = t(
        f"""SELECT CASE {steps} ELSE '{S.GAP_LONGEST}' END AS gap_since_prev_txn, count(*) AS txns,
                   {BAD} AS fraud_txns, {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct
            FROM fact WHERE mins_since_prev_txn IS NOT NULL GROUP BY 1""",
        upto="fact",
    )
    daily = f"""daily AS (
        SELECT txn_day AS txn_date, count(*) AS txns, {BAD} AS fraud_txns, {LOSS} AS loss, {VALUE} AS value
        FROM fact GROUP BY txn_day)"""
    q["q16_daily_trend"] = t(
        f"""SELECT txn_date, txns, fraud_txns, round({dbl('loss')}, 2) AS fraud_value,
                   {pct('fraud_txns', 'txns', 3)} AS fraud_rate_pct,
                   round(avg({pct('fraud_txns', 'txns')}) OVER w, 3) AS fraud_rate_7d_ma,
                   round({dbl('sum(loss) OVER w')} / count(*) OVER w, 2) AS fraud_value_7d_ma
            FROM daily WINDOW w AS (ORDER BY txn_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        upto="fact",
        extra=daily,
    )
    for key, raw, cols, year in (
        ("q17_weekly_movement", None, "week_no", ""),
        ("q17_weekly_movement_orders", RAW_ORDERS, "week_no", ""),
        ("q17_weekly_movement_by_iso_year", RAW_ORDERS, "iso_year, week_no", "isoyear(date) AS iso_year,"),
    ):
        select = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in cols.split(", "))
        q[key] = t(
            f"""SELECT {select}, week_start, txns, fraud_txns, round({dbl('loss')}, 2) AS fraud_value,
                       {dbl('lag(fraud_txns) OVER w')} AS prev_week_fraud,
                       {pct('(fraud_txns - lag(fraud_txns) OVER w)', 'lag(fraud_txns) OVER w', 2)} AS wow_change_pct
                FROM weekly WINDOW w AS (ORDER BY {cols})""",
            upto="dim_date",
            extra=f"""weekly AS (
                SELECT {year} week_no, min(date) AS week_start, count(*) AS txns, {BAD} AS fraud_txns, {LOSS} AS loss
                FROM fact JOIN dim_date USING (date_key) GROUP BY {cols})""",
            **({"raw": raw} if raw else {}),
        )
    for key, k in (("q18_alert_days", 2), ("q18_alert_days_one_sigma", 1)):
        q[key] = t(
            f"""SELECT txn_date, round({dbl('loss')}, 2) AS fraud_value, round(mu, 2) AS mean_daily_loss,
                       round(mu + {k} * sigma, 2) AS alert_threshold,
                       round(({dbl('loss')} - mu) / sigma, 2) AS z_score
                FROM daily, moments WHERE {dbl('loss')} > mu + {k} * sigma""",
            upto="fact",
            extra=daily
            + f""", moments AS (
                SELECT avg({dbl('loss')}) AS mu,
                       sqrt(avg({dbl('loss')} * {dbl('loss')}) - avg({dbl('loss')}) * avg({dbl('loss')})) AS sigma
                FROM daily)""",
        )
    cutoffs = ", ".join(f"({c})" for c in S.REVIEW_CUTOFFS)
    q["q19_review_simulation"] = t(
        f"""SELECT CAST(c AS INTEGER) AS review_above, count(*) FILTER (WHERE amount >= c) AS txns_for_review,
                   {pct('count(*) FILTER (WHERE amount >= c)', 'count(*)', 2)} AS pct_txns_reviewed,
                   count(*) FILTER (WHERE amount >= c AND is_fraud = 1) AS frauds_caught,
                   count(*) FILTER (WHERE amount < c AND is_fraud = 1) AS frauds_missed,
                   {pct('count(*) FILTER (WHERE amount >= c AND is_fraud = 1)', 'sum(is_fraud)', 2)} AS recall_pct,
                   {pct('count(*) FILTER (WHERE amount >= c AND is_fraud = 1)',
                        'count(*) FILTER (WHERE amount >= c)', 2)} AS precision_pct,
                   round(coalesce({dbl('sum(amount) FILTER (WHERE amount >= c AND is_fraud = 1)')}, 0), 2)
                     AS loss_prevented,
                   count(*) FILTER (WHERE amount >= c AND is_fraud = 0) AS good_customers_stopped
            FROM fact, (VALUES {cutoffs}) AS v(c) GROUP BY c""",
        upto="fact",
    )
    a, b, c, d = S.RULE_LABELS
    q["q20_layered_rules"] = t(
        f"""SELECT CASE WHEN amount >= 220 THEN '{a}' WHEN amount_vs_cust_avg >= 4 THEN '{b}'
                        WHEN mins_since_prev_txn < 60 AND amount >= 100 THEN '{c}' ELSE '{d}' END AS rule_hit,
                   count(*) AS txns_flagged, {BAD} AS frauds_caught,
                   {pct('sum(is_fraud)', 'count(*)', 2)} AS precision_pct,
                   round({dbl(LOSS)}, 2) AS loss_prevented,
                   {pct('sum(is_fraud)', '(SELECT sum(is_fraud) FROM fact)', 2)} AS pct_of_all_fraud
            FROM fact GROUP BY 1""",
        upto="fact",
    )
    q["q21_missed_by_amount"] = t(
        f"""SELECT fraud_type, count(*) AS frauds_missed, round({dbl(VALUE)}, 2) AS loss_not_prevented,
                   round({dbl(VALUE)} / count(*), 2) AS avg_missed_amount,
                   round({dbl('sum(CAST(amount_vs_cust_avg AS DECIMAL(18,2)))')} / count(amount_vs_cust_avg), 2)
                     AS avg_ratio_to_baseline
            FROM fact WHERE is_fraud = 1 AND amount < 220 GROUP BY fraud_type""",
        upto="fact",
    )
    p1, p2, p3 = S.TRIAGE_LABELS
    q["q22_triage_list"] = t(
        f"""SELECT customer_id, value_segment, total_txns, round(total_spend, 2) AS total_spend, fraud_txns,
                   fraud_rate_pct, CAST(score AS INTEGER) AS priority_score,
                   CASE WHEN score >= 9 THEN '{p1}' WHEN score >= 7 THEN '{p2}' ELSE '{p3}' END AS action
            FROM scored ORDER BY score DESC, total_spend DESC, customer_id LIMIT 25""",
        upto="dim_customer",
        extra="""scored AS (
            SELECT *, ntile(5) OVER (ORDER BY total_spend, customer_id)
                      + ntile(5) OVER (ORDER BY fraud_rate_pct, customer_id) AS score
            FROM dim_customer WHERE fraud_txns > 0)""",
    )
    q["q23_detection_latency"] = t(
        f"""SELECT f.terminal_id, x.began AS first_fraud_at, count(*) AS clean_txns_before_first_fraud,
                   round({dbl('sum(f.amount)')}, 2) AS clean_value_before,
                   any_value(m.fraud_txns) AS total_frauds_on_terminal,
                   round(any_value(m.fraud_volume), 2) AS total_fraud_loss
            FROM fact f
            JOIN (SELECT terminal_id, min(txn_datetime) AS began FROM fact WHERE is_fraud = 1 GROUP BY 1) x
              ON x.terminal_id = f.terminal_id AND f.txn_datetime < x.began
            JOIN dim_terminal m ON m.terminal_id = f.terminal_id
            GROUP BY f.terminal_id, x.began ORDER BY total_fraud_loss DESC, f.terminal_id LIMIT 15""",
        upto="dim_terminal",
    )
    q["q24_heat_map"] = t(
        f"""SELECT part_of_day, amount_band, count(*) AS txns, {BAD} AS fraud_txns,
                   {pct('sum(is_fraud)', 'count(*)', 3)} AS fraud_rate_pct
            FROM fact GROUP BY ALL HAVING count(*) > 100
            ORDER BY fraud_rate_pct DESC, part_of_day, amount_band LIMIT 25""",
        upto="fact",
    )
    m = S.HEADLINE_METRICS
    q["q25_headline"] = t(
        f"""SELECT '{m[0]}' AS metric, format('{{:,}}', n) AS value FROM base
            UNION ALL SELECT '{m[1]}', printf('%.2f', {dbl('v')}) FROM base
            UNION ALL SELECT '{m[2]}', format('{{:,}}', bad) FROM base
            UNION ALL SELECT '{m[3]}', printf('%.3f', {pct('bad', 'n')}) FROM base
            UNION ALL SELECT '{m[4]}', printf('%.2f', {dbl('loss')}) FROM base
            UNION ALL SELECT '{m[5]}', printf('%.3f', {pct('loss', 'v')}) FROM base
            UNION ALL SELECT '{m[6]}', printf('%.2f', {dbl('loss')} / bad) FROM base
            UNION ALL SELECT '{m[7]}', format('{{:,}}', count(*)) FROM dim_terminal
                      WHERE risk_tier IN ('{S.RISK_TIERS[0]}', '{S.RISK_TIERS[1]}')
            UNION ALL SELECT '{m[8]}', format('{{:,}}', count(*)) FROM dim_customer WHERE fraud_txns > 0""",
        extra=f"base AS (SELECT count(*) AS n, {BAD} AS bad, {VALUE} AS v, {LOSS} AS loss FROM fact)",
    )


RANKS = """ranked AS (
        SELECT is_fraud, rank() OVER (ORDER BY amount)
               + (count(*) OVER (PARTITION BY amount) - 1) / 2e0 AS mid_rank FROM fact),
      u AS (SELECT sum(mid_rank) FILTER (WHERE is_fraud = 1)
                   - CAST(sum(is_fraud) AS DOUBLE) * (sum(is_fraud) + 1) / 2 AS u,
                   CAST(sum(is_fraud) AS DOUBLE) AS n1, CAST(sum(1 - is_fraud) AS DOUBLE) AS n2 FROM ranked)"""
NORMALITY = """legit AS (SELECT n, CAST(n AS DOUBLE) AS c, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2
                 FROM moments WHERE is_fraud = 0),
  skew1 AS (SELECT *, g1 * sqrt((c + 1) * (c + 3) / (6 * (c - 2))) AS y,
                   sqrt(2 * (3 * (c * c + 27 * c - 70) * (c + 1) * (c + 3)
                     / ((c - 2) * (c + 5) * (c + 7) * (c + 9)) - 1)) - 1 AS w2 FROM legit),
  skew2 AS (SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt(power(y / sqrt(2 / (w2 - 1)), 2) + 1))
                      / sqrt(0.5 * ln(w2)) AS zs FROM skew1),
  kurt1 AS (SELECT *, (b2 - 3 * (c - 1) / (c + 1))
              / sqrt(24 * c * (c - 2) * (c - 3) / (power(c + 1, 2) * (c + 3) * (c + 5))) AS x,
            6 * (c * c - 5 * c + 2) / ((c + 7) * (c + 9))
              * sqrt(6 * (c + 3) * (c + 5) / (c * (c - 2) * (c - 3))) AS sb FROM skew2),
  kurt2 AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM kurt1),
  z AS (SELECT n, zs, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))))
                      / sqrt(2 / (9 * a)) AS zk FROM kurt2)"""


def _significance(q: dict[str, str]) -> None:
    t = with_tables
    q["a01_class_summary"] = t(
        f"""SELECT {dbl('median(amount) FILTER (WHERE is_fraud = 1)')} AS median_fraud,
                   {dbl('median(amount) FILTER (WHERE is_fraud = 0)')} AS median_legit,
                   round({dbl('sum(amount) FILTER (WHERE is_fraud = 1)')} / sum(is_fraud), 6) AS mean_fraud,
                   round({dbl('sum(amount) FILTER (WHERE is_fraud = 0)')} / sum(1 - is_fraud), 6) AS mean_legit,
                   round(({dbl('sum(amount) FILTER (WHERE is_fraud = 1)')} / sum(is_fraud))
                     / ({dbl('sum(amount) FILTER (WHERE is_fraud = 0)')} / sum(1 - is_fraud)), 6) AS ratio_of_means
            FROM (SELECT CAST(amount AS DOUBLE) AS x, * FROM fact)""".replace("median(amount)", "median(x)"),
        upto="fact",
    )
    moments = """moments AS (
        SELECT is_fraud, count(*) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3,
               avg(power(x - mu, 4)) AS m4
        FROM (SELECT is_fraud, CAST(amount AS DOUBLE) AS x,
                     avg(CAST(amount AS DOUBLE)) OVER (PARTITION BY is_fraud) AS mu FROM fact)
        GROUP BY is_fraud)"""
    q["a02_skewness"] = t(
        "SELECT is_fraud, round(m3 / power(m2, 1.5), 6) AS skew FROM moments", upto="fact", extra=moments
    )
    k2 = "SELECT n, round(zs * zs + zk * zk, 3) AS k2, round(exp(-(zs * zs + zk * zk) / 2), 9) AS p_value FROM z"
    q["a03_normality"] = t(k2, upto="fact", extra=moments + ", " + NORMALITY)
    # exactly 5,000 seeded places, repeats allowed, of the legitimate rows in hashed order
    drawn = f"""ordered AS (SELECT CAST(amount AS DOUBLE) AS x,
                          row_number() OVER (ORDER BY md5('{S.SEED}-' || CAST(transaction_id AS VARCHAR)), transaction_id) - 1
                            AS place FROM fact WHERE is_fraud = 0),
        places AS (SELECT CAST(floor(CAST(CAST('0x' || substr(md5('{S.SEED}:' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)
                            / power(16e0, 13) * (SELECT count(*) FROM ordered)) AS BIGINT) AS place
                   FROM range({S.NORMALITY_DRAWS}) AS r(i)),
        drawn AS (SELECT x FROM ordered JOIN places USING (place)),
        moments AS (SELECT 0 AS is_fraud, count(*) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3,
                           avg(power(x - mu, 4)) AS m4 FROM (SELECT x, avg(x) OVER () AS mu FROM drawn))"""
    q["a03_normality_sampled"] = t(k2, upto="fact", extra=drawn + ", " + NORMALITY)
    ranks = RANKS
    q["a04_mann_whitney"] = t("SELECT u AS u_statistic FROM u", upto="fact", extra=ranks)
    q["a04_mann_whitney_p"] = t(
        f"""SELECT u AS u_statistic, round(abs(1 - 2 * u / (n1 * n2)), 9) AS effect_size_rank_biserial,
                   round(p, 9) AS p_value, p < 0.05 AS significant_at_5pct
            FROM (SELECT *, {_upper_tail('0.5e0', 'z * z / 2')} AS p FROM scored)""",
        upto="fact",
        extra=ranks
        + """, ties AS (SELECT sum(power(c, 3) - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM fact GROUP BY amount)),
      scored AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5e0)
                   / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, ties)""",
    )
    q["a05_rank_biserial"] = t(
        "SELECT round(abs(1 - 2 * u / (n1 * n2)), 9) AS effect_size_rank_biserial FROM u", upto="fact", extra=ranks
    )
    for dim in ("part_of_day", "amount_band"):
        q[f"a06_chi_square_{dim}"] = t(
            f"SELECT '{dim}' AS dimension, round(chi2, 6) AS chi2, CAST(r - 1 AS INTEGER) AS dof, "
            "round(least_cell, 6) AS min_expected, least_cell > 5 AS valid FROM chi",
            upto="fact",
            extra=_chi(dim),
        )
        q[f"a06_chi_square_{dim}_p"] = t(
            f"""SELECT '{dim}' AS dimension, CAST(r - 1 AS INTEGER) AS dof, round(p, 9) AS p_value,
                       p < 0.05 AS significant_at_5pct
                FROM (SELECT r, {_upper_tail('(r - 1) / 2e0', 'chi2 / 2')} AS p FROM chi)""",
            upto="fact",
            extra=_chi(dim),
        )
    v = "sqrt(chi2 / n)"  # two classes: min(r, c) - 1 is 1
    both = " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, round(chi2, 6) AS chi2, round({v}, 9) AS cramers_v,
                   CASE WHEN {v} > 0.3 THEN 'STRONG' WHEN {v} > 0.1 THEN 'moderate' ELSE 'weak' END AS strength,
                   CASE WHEN {v} < 0.1 THEN 'weak' ELSE 'material' END AS practical_significance,
                   round({v} / (SELECT {v} FROM chi), 6) AS strength_vs_first
            FROM {c}"""
        for d, c in (("part_of_day", "chi"), ("amount_band", "chi_b"))
    )
    q["a07_association_strength"] = t(
        both, upto="fact", extra=_chi("part_of_day") + ", " + _chi("amount_band", "_b")
    )
    q["a08_rate_by_period"] = t(
        f"SELECT part_of_day, round_even({dbl('sum(is_fraud)')} / count(*) * 100e0, 3) AS fraud_rate_pct "
        "FROM fact GROUP BY part_of_day",
        upto="fact",
    )
    z = f"{S.WILSON_Z}e0"
    for key, by in (("a09_wilson_interval", ""), ("a09_wilson_by_period", "part_of_day, ")):
        q[key] = t(
            f"""SELECT {by} round(p * 100, 9) AS point_estimate_pct,
                       round((p + {z} * {z} / (2 * n) - {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4e0 * n * n)))
                         / (1 + {z} * {z} / n) * 100, 9) AS ci_lower_pct,
                       round((p + {z} * {z} / (2 * n) + {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4e0 * n * n)))
                         / (1 + {z} * {z} / n) * 100, 9) AS ci_upper_pct,
                       n, successes
                FROM (SELECT {by} count(*) AS n, {BAD} AS successes, {dbl('sum(is_fraud)')} / count(*) AS p
                      FROM fact GROUP BY ALL)""",
            upto="fact",
        )


def _upper_tail(a: str, x: str) -> str:
    """Regularised upper incomplete gamma by the series of the lower one; nothing is left beyond 100."""
    series = f"(SELECT sum(exp(({a} + k) * ln({x}) - lgamma({a} + k + 1) - ({x}))) FROM range(0, 1000) AS g(k))"
    return f"CASE WHEN {x} > 100 THEN 0e0 WHEN {x} <= 0 THEN 1e0 ELSE 1 - {series} END"


def _chi(dim: str, tag: str = "") -> str:
    return f"""cells{tag} AS (
          SELECT {dim} AS lab, k AS flag, count(*) FILTER (WHERE is_fraud = k) AS seen
          FROM fact, (VALUES (0), (1)) AS v(k) GROUP BY {dim}, k),
        expected{tag} AS (
          SELECT seen, sum(seen) OVER (PARTITION BY lab) * CAST(sum(seen) OVER (PARTITION BY flag) AS DOUBLE)
                       / sum(seen) OVER () AS e, lab FROM cells{tag}),
        chi{tag} AS (
          SELECT sum((seen - e) * (seen - e) / e) AS chi2, min(e) AS least_cell, count(DISTINCT lab) AS r,
                 CAST(sum(seen) AS DOUBLE) AS n FROM expected{tag})"""


SWEEP = """counts AS (
    SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (WHERE amount >= t) AS flagged,
           count(*) FILTER (WHERE amount >= t AND is_fraud = 1) AS caught,
           coalesce(CAST(sum(amount) FILTER (WHERE amount >= t AND is_fraud = 1) AS DOUBLE), 0) AS saved,
           coalesce(CAST(sum(amount) FILTER (WHERE amount < t AND is_fraud = 1) AS DOUBLE), 0) AS missed,
           sum(is_fraud) AS bad
    FROM fact, range(20, 601, 10) AS r(t) GROUP BY t),
  sweep AS (
    SELECT threshold, flagged AS txns_flagged, caught AS frauds_caught, flagged - caught AS false_positives,
           round_even(100e0 * caught / bad, 2) AS recall_pct,
           CASE WHEN flagged = 0 THEN 0 ELSE round_even(100e0 * caught / flagged, 2) END AS precision_pct,
           round_even(saved * 0.75e0, 2) AS loss_prevented,
           round_even(flagged * 3e0 + (flagged - caught) * 12e0, 2) AS operating_cost,
           round_even(missed, 2) AS residual_loss,
           round_even(saved * 0.75e0 - (flagged * 3e0 + (flagged - caught) * 12e0) - missed, 2) AS net_benefit
    FROM counts)"""
BEST = "best AS (SELECT * FROM sweep ORDER BY net_benefit DESC, threshold LIMIT 1)"
GRID = """nets AS (
    SELECT a AS review_cost, b AS false_decline_cost, threshold,
           saved * 0.75e0 - (flagged * a + (flagged - caught) * b) - missed AS net
    FROM counts, (VALUES (1.5e0), (3e0), (6e0)) AS x(a), (VALUES (6e0), (12e0), (24e0)) AS y(b)),
  grid AS (
    SELECT review_cost, false_decline_cost, threshold AS optimal_threshold, round_even(net, 2) AS net_benefit
    FROM (SELECT *, row_number() OVER (PARTITION BY review_cost, false_decline_cost
                                       ORDER BY net DESC, threshold) AS rn FROM nets) WHERE rn = 1)"""


def _live(review: float, decline: float, recovery: float) -> str:
    return f"""live AS (
        SELECT *, (SELECT sum(is_fraud) FROM fact)::BIGINT - frauds_caught AS frauds_missed,
               txns_flagged * {review}e0 + false_positives * {decline}e0 AS op_cost_live,
               loss_prevented / 0.75e0 * {recovery}e0 AS prevented_live,
               loss_prevented / 0.75e0 * {recovery}e0
                 - (txns_flagged * {review}e0 + false_positives * {decline}e0) - residual_loss AS net_live
        FROM sweep)"""


def _decisions(q: dict[str, str]) -> None:
    def t(body, extra):
        return with_tables(body, upto="fact", extra=extra)

    q["x01_threshold_sweep"] = t("SELECT * FROM sweep", SWEEP)
    q["x02_cost_model"] = t(
        """SELECT threshold, round(saved * 0.6e0, 4) AS prevented,
                  round(flagged * 2e0 + (flagged - caught) * 20e0, 4) AS operating, round(missed, 4) AS missed,
                  round(saved * 0.6e0 - (flagged * 2e0 + (flagged - caught) * 20e0) - missed, 4) AS net FROM counts""",
        SWEEP,
    )
    q["x03_optimum"] = t(
        """SELECT threshold AS optimal_threshold, best.* EXCLUDE (threshold),
                  round_even(net_benefit - (SELECT net_benefit FROM sweep WHERE threshold = 100), 2)
                    AS improvement_vs_naive FROM best""",
        f"{SWEEP}, {BEST}",
    )
    q["x04_sensitivity"] = t("SELECT * FROM grid", f"{SWEEP}, {GRID}")
    q["x05_stability"] = t(
        """SELECT count(DISTINCT optimal_threshold) AS distinct_optima, min(optimal_threshold) AS lowest,
                  max(optimal_threshold) AS highest, max(optimal_threshold) - min(optimal_threshold) <= 40 AS stable
           FROM grid""",
        f"{SWEEP}, {GRID}",
    )
    q["x06_sensitivity_pivot"] = t(
        """SELECT review_cost, max(optimal_threshold) FILTER (WHERE false_decline_cost = 6) AS decline_6,
                  max(optimal_threshold) FILTER (WHERE false_decline_cost = 12) AS decline_12,
                  max(optimal_threshold) FILTER (WHERE false_decline_cost = 24) AS decline_24
           FROM grid GROUP BY review_cost""",
        f"{SWEEP}, {GRID}",
    )
    below = "amount < (SELECT threshold FROM best)"
    q["x07_blind_spot"] = t(
        f"""SELECT (SELECT threshold FROM best) AS threshold, count(*) FILTER (WHERE {below}) AS frauds_missed,
                   round({pct(f'count(*) FILTER (WHERE {below})', 'count(*)')}, 9) AS pct_of_all_fraud_missed,
                   {dbl(f'coalesce(sum(amount) FILTER (WHERE {below}), 0)')} AS unprevented_loss
            FROM fact WHERE is_fraud = 1""",
        f"{SWEEP}, {BEST}",
    )
    q["x07_blind_spot_by_type"] = t(
        f"""SELECT fraud_type, count(*) AS incidents, {dbl(VALUE)} AS loss,
                   round_even({dbl('sum(CAST(amount_vs_cust_avg AS DECIMAL(18,2)))')} / count(amount_vs_cust_avg), 2)
                     AS avg_ratio_to_baseline
            FROM fact WHERE is_fraud = 1 AND {below} GROUP BY fraud_type""",
        f"{SWEEP}, {BEST}",
    )
    rounded = ", ".join(
        f"round({c}, 4) AS {c}" for c in ("op_cost_live", "prevented_live", "net_live")
    )
    q["x08_live_recost"] = t(
        f"SELECT * REPLACE ({rounded}) FROM live", f"{SWEEP}, {_live(5.0, 8.0, 0.9)}"
    )
    q["x08_chosen_setting"] = t(
        f"""SELECT now.*, top.threshold AS optimum, round(top.net_live, 4) AS optimum_net,
                   CASE WHEN abs(247 - top.threshold) <= 10 THEN 'matches'
                        WHEN 247 < top.threshold THEN 'sits below' ELSE 'sits above' END AS verdict
            FROM (SELECT * REPLACE ({rounded}) FROM live ORDER BY abs(threshold - 247), threshold LIMIT 1) now,
                 (SELECT * FROM live ORDER BY net_live DESC, threshold LIMIT 1) top""",
        f"{SWEEP}, {_live(5.0, 8.0, 0.9)}",
    )


def _ratio0(a: str, b: str) -> str:
    return f"coalesce({dbl(a)} / nullif({dbl(b)}, 0), 0)"


RATE = f"({_ratio0('sum(is_fraud)', 'count(*)')} * 100)"
JOINED = """fact f JOIN dim_date USING (date_key) JOIN (SELECT customer_id, value_segment FROM dim_customer) c USING (customer_id)
            JOIN (SELECT terminal_id, risk_tier FROM dim_terminal) m USING (terminal_id)"""

# key -> (measure expression, grouping, where)
SIMPLE_MEASURES = {
    "m01_total_transactions": ("total_transactions", "count(*)", "amount_band"),
    "m02_total_value": ("total_value", dbl(VALUE), "month_name"),
    "m03_fraud_transactions": ("fraud_transactions", BAD, "value_segment"),
    "m04_legit_transactions": ("legit_transactions", f"count(*) - {BAD}", "risk_tier"),
    "m05_fraud_loss": ("fraud_loss", dbl(LOSS), "date"),
    "m06_fraud_rate": ("fraud_rate_pct", f"round({RATE}, 9)", "value_segment, risk_tier"),
    "m07_value_at_risk": ("value_at_risk_pct", f"round({_ratio0(LOSS, VALUE)} * 100, 9)", "day_name"),
    "m08_avg_loss_per_incident": ("avg_loss_per_incident", f"round({_ratio0(LOSS, 'sum(is_fraud)')}, 9)", "txn_hour"),
    "m09_avg_transaction_value": ("avg_transaction_value", f"round({_ratio0(VALUE, 'count(*)')}, 9)", "part_of_day"),
    "m17_terminals_affected": (
        "terminals_affected", "count(DISTINCT terminal_id) FILTER (WHERE is_fraud = 1)", "week_no"),
    "m18_customers_affected": (
        "customers_affected", "count(DISTINCT customer_id) FILTER (WHERE is_fraud = 1)", "risk_tier"),
    "m19_customer_impact_rate": (
        "customer_impact_rate_pct",
        f"round({_ratio0('count(DISTINCT customer_id) FILTER (WHERE is_fraud = 1)', 'count(DISTINCT customer_id)')} * 100, 9)",
        "value_segment"),
}
THRESHOLD_MEASURES = {
    "m25_txns_flagged": "txns_flagged",
    "m26_frauds_caught": "frauds_caught",
    "m27_frauds_missed": "frauds_missed",
    "m28_false_positives": "false_positives",
    "m29_recall": "recall_pct",
    "m30_precision": "precision_pct",
    "m31_loss_prevented": "loss_prevented",
    "m32_residual_loss": "residual_loss",
    "m36_operating_cost": "operating_cost",
    "m37_net_benefit": "net_benefit",
}
FILTERED = ("date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value_segment IN "
            f"('{S.SEGMENTS[3]}', '{S.SEGMENTS[2]}') AND risk_tier IN ('{S.RISK_TIERS[0]}', '{S.RISK_TIERS[1]}')")


def _measures(q: dict[str, str]) -> None:
    t = with_tables
    for key, (name, formula, by) in SIMPLE_MEASURES.items():
        q[key] = t(f"SELECT {by}, {formula} AS {name} FROM {JOINED} GROUP BY {by}", upto="dim_terminal")
    base = f"(SELECT {RATE} FROM {JOINED} WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')"
    lift = f"({RATE} / nullif({base}, 0))"
    q["m10_portfolio_rate"] = t(
        f"""SELECT risk_tier, round({RATE}, 9) AS fraud_rate_pct, round({base}, 9) AS portfolio_fraud_rate_pct
            FROM {JOINED} WHERE {FILTERED} GROUP BY risk_tier""",
        upto="dim_terminal",
    )
    q["m10_portfolio_rate_all_dates"] = t(
        f"""SELECT risk_tier, round((SELECT {RATE} FROM fact), 9) AS portfolio_fraud_rate_pct
            FROM {JOINED} WHERE {FILTERED} GROUP BY risk_tier""",
        upto="dim_terminal",
    )
    q["m10_portfolio_rate_by_week"] = t(
        f"""SELECT w.week_no, w.value_segment, round(w.own, 9) AS fraud_rate_pct, round(p.rate, 9) AS portfolio_fraud_rate_pct
            FROM (SELECT week_no, value_segment, {RATE} AS own FROM {JOINED} GROUP BY ALL) w
            JOIN (SELECT week_no, {RATE} AS rate FROM {JOINED} GROUP BY ALL) p USING (week_no)""",
        upto="dim_terminal",
    )
    q["m11_risk_lift"] = t(
        f"SELECT risk_tier, round({lift}, 9) AS risk_lift FROM {JOINED} WHERE {FILTERED} GROUP BY risk_tier",
        upto="dim_terminal",
    )
    whole = f"({RATE} / nullif((SELECT {RATE} FROM fact), 0))"
    text = f"printf('%.1f', round({whole}, 1)) || 'x)'"
    q["m12_risk_lift_label"] = t(
        f"""SELECT terminal_id, CASE WHEN {whole} IS NULL THEN '-' WHEN {whole} >= 5 THEN 'Critical (' || {text}
                   WHEN {whole} >= 2 THEN 'High (' || {text} WHEN {whole} >= 1.2 THEN 'Elevated (' || {text}
                   ELSE 'Normal (' || {text} END AS risk_lift_label FROM fact GROUP BY terminal_id""",
        upto="fact",
    )
    monthly = f"""now AS (SELECT year, month_no, {dbl(LOSS)} AS loss FROM fact JOIN dim_date USING (date_key) GROUP BY ALL),
        asked AS (SELECT year, month_no, min(date) AS first_day, max(date) AS last_day FROM dim_date GROUP BY ALL),
        shifted AS (
          SELECT DISTINCT d.year, d.month_no, CAST(d.date - INTERVAL 1 MONTH AS DATE) AS day FROM dim_date d
          UNION
          SELECT a.year, a.month_no, CAST(s.day AS DATE) FROM asked a,
                 LATERAL (SELECT unnest(generate_series(CAST(a.last_day - INTERVAL 1 MONTH AS DATE),
                                                        last_day(CAST(a.last_day - INTERVAL 1 MONTH AS DATE)), INTERVAL 1 DAY)) AS day) s
          WHERE a.last_day = last_day(a.last_day)),
        before AS (SELECT s.year, s.month_no, {dbl(LOSS)} AS prev FROM shifted s JOIN fact ON txn_day = s.day GROUP BY ALL)"""
    for source, raw in (("", None), ("_orders", RAW_ORDERS)):
        kw = {"raw": raw} if raw else {}
        q[f"m13_fraud_loss_previous_month{source}"] = t(
            "SELECT year, month_no, loss AS fraud_loss, prev AS fraud_loss_pm FROM now LEFT JOIN before USING (year, month_no)",
            upto="dim_date", extra=monthly, **kw)
        q[f"m14_fraud_loss_mom{source}"] = t(
            "SELECT year, month_no, round((loss - prev) / nullif(prev, 0) * 100, 9) AS fraud_loss_mom_pct "
            "FROM now LEFT JOIN before USING (year, month_no)",
            upto="dim_date", extra=monthly, **kw)
        q[f"m15_fraud_rate_7d{source}"] = t(
            """SELECT a.date, round(avg(coalesce(b.rate, 0)), 9) AS fraud_rate_7d_ma
               FROM dim_date a JOIN (SELECT date, rate FROM dim_date LEFT JOIN rates ON txn_day = date) b
                 ON b.date BETWEEN a.date - 6 AND a.date GROUP BY a.date""",
            upto="dim_date", extra=f"rates AS (SELECT txn_day, {RATE} AS rate FROM fact GROUP BY txn_day)", **kw)
    q["m15_fraud_rate_7d_filtered"] = t(
        """SELECT a.date, round(avg(coalesce(b.rate, 0)), 9) AS fraud_rate_7d_ma
           FROM dim_date a JOIN (SELECT date, rate FROM dim_date LEFT JOIN rates ON txn_day = date) b
             ON b.date BETWEEN a.date - 6 AND a.date
           WHERE a.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY a.date""",
        upto="dim_date",
        extra=f"rates AS (SELECT txn_day, {RATE} AS rate FROM fact WHERE terminal_id IN (3, 23) GROUP BY txn_day)",
    )
    q["m16_running_loss"] = t(
        f"""SELECT a.date, {dbl('sum(coalesce(b.loss, 0))')} AS fraud_loss_running_total
            FROM dim_date a JOIN (SELECT date, loss FROM dim_date LEFT JOIN losses ON txn_day = date) b ON b.date <= a.date
            WHERE a.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND b.date >= DATE '2024-01-05'
            GROUP BY a.date""",
        upto="dim_date", extra=f"losses AS (SELECT txn_day, {LOSS} AS loss FROM fact GROUP BY txn_day)")
    q["m20_high_risk_terminals"] = t(
        f"SELECT count(*) AS high_risk_terminals FROM dim_terminal WHERE risk_tier IN ('{S.RISK_TIERS[0]}', '{S.RISK_TIERS[1]}')",
        upto="dim_terminal")
    pareto = f"""losses AS (SELECT terminal_id, {LOSS} AS loss FROM fact GROUP BY terminal_id),
        pareto AS (SELECT terminal_id, {dbl('loss')} AS fraud_loss, dense_rank() OVER (ORDER BY loss DESC) AS terminal_loss_rank,
                          sum(loss) OVER (ORDER BY loss DESC RANGE UNBOUNDED PRECEDING) AS cum, sum(loss) OVER () AS whole FROM losses)"""
    q["m21_terminal_loss_rank"] = t(
        "SELECT terminal_id, fraud_loss, terminal_loss_rank FROM pareto", upto="fact", extra=pareto)
    q["m22_cumulative_loss"] = t(
        f"SELECT terminal_id, {dbl('cum')} AS cumulative_loss FROM pareto", upto="fact", extra=pareto)
    q["m23_cumulative_loss_pct"] = t(
        f"SELECT terminal_id, round({_ratio0('cum', 'whole')} * 100, 9) AS cumulative_loss_pct FROM pareto",
        upto="fact", extra=pareto)
    q["m24_selected_threshold"] = t(
        "SELECT risk_tier, 200 AS selected_threshold, count(*) FILTER (WHERE amount >= 200) AS txns_flagged "
        f"FROM {JOINED} GROUP BY risk_tier",
        upto="dim_terminal",
    )
    body = f"""sim AS (
        SELECT risk_tier, CAST(t AS INTEGER) AS selected_threshold, count(*) FILTER (WHERE amount >= t) AS txns_flagged,
               count(*) FILTER (WHERE amount >= t AND is_fraud = 1) AS frauds_caught,
               count(*) FILTER (WHERE amount < t AND is_fraud = 1) AS frauds_missed,
               count(*) FILTER (WHERE amount >= t AND is_fraud = 0) AS false_positives,
               round({_ratio0('count(*) FILTER (WHERE amount >= t AND is_fraud = 1)', 'sum(is_fraud)')} * 100, 9) AS recall_pct,
               round({_ratio0('count(*) FILTER (WHERE amount >= t AND is_fraud = 1)', 'count(*) FILTER (WHERE amount >= t)')} * 100, 9)
                 AS precision_pct,
               coalesce({dbl('sum(amount) FILTER (WHERE amount >= t AND is_fraud = 1)')}, 0) AS loss_prevented,
               coalesce({dbl('sum(amount) FILTER (WHERE amount < t AND is_fraud = 1)')}, 0) AS residual_loss
        FROM {JOINED}, (VALUES (100), (200), (400)) AS v(t) GROUP BY risk_tier, t),
      costed AS (
        SELECT *, txns_flagged * 3e0 + false_positives * 12e0 AS operating_cost,
               round(loss_prevented * 0.75e0 - (txns_flagged * 3e0 + false_positives * 12e0) - residual_loss, 6) AS net_benefit
        FROM sim)"""
    for key, name in THRESHOLD_MEASURES.items():
        q[key] = t(f"SELECT risk_tier, selected_threshold, {name} FROM costed", upto="dim_terminal", extra=body)
    q["m33_m35_cost_parameters"] = t(
        """SELECT risk_tier, selected_threshold, 3e0 AS review_cost_per_case, 12e0 AS false_decline_cost,
                  0.75e0 AS recovery_rate FROM costed""", upto="dim_terminal", extra=body)


def _slices(q: dict[str, str]) -> None:
    t = with_tables
    q["r01_kpi_source"] = t(
        f"""SELECT count(*) AS txns, count(DISTINCT customer_id) AS customers, count(DISTINCT terminal_id) AS terminals,
                   {dbl(VALUE)} AS value, {BAD} AS frauds, {dbl(LOSS)} AS fraud_value,
                   round({pct('sum(is_fraud)', 'count(*)')}, 9) AS fraud_rate_pct,
                   round({pct(LOSS, VALUE)}, 9) AS value_at_risk_pct FROM fact""",
        upto="fact")
    rate = pct("sum(is_fraud)", "count(*)", 3)
    q["r02_band"] = t(
        f"""SELECT amount_band, count(*) AS txns, {BAD} AS fraud_txns, {rate} AS fraud_rate_pct,
                   round({dbl(LOSS)}, 2) AS fraud_value, round({dbl(VALUE)}, 2) AS total_value
            FROM fact GROUP BY amount_band""", upto="fact")
    types = f"""types AS (
        SELECT fraud_type, count(*) AS incidents, round({dbl(VALUE)}, 2) AS loss_value,
               round({dbl(VALUE)} / count(*), 2) AS avg_loss, count(DISTINCT customer_id) AS customers_hit,
               count(DISTINCT terminal_id) AS terminals FROM fact WHERE is_fraud = 1 GROUP BY fraud_type)"""
    q["r03_type"] = t("SELECT * FROM types", upto="fact", extra=types)
    daily = f"""slice AS (
        SELECT txn_day AS txn_date, count(*) AS txns, {BAD} AS fraud_txns, {rate} AS fraud_rate_pct,
               round({dbl(LOSS)}, 2) AS fraud_value, round({dbl(VALUE)}, 2) AS total_value
        FROM fact GROUP BY txn_day),
      smooth AS (
        SELECT *, round_even({dbl('sum(CAST(fraud_rate_pct AS DECIMAL(12,3))) OVER w')} / count(*) OVER w, 3) AS fraud_rate_7d_ma
        FROM slice WINDOW w AS (ORDER BY txn_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
    q["r04_daily"] = t("SELECT * FROM smooth", upto="fact", extra=daily)
    q["r05_hour"] = t(
        f"""SELECT txn_hour, part_of_day, count(*) AS txns, {BAD} AS fraud_txns, {rate} AS fraud_rate_pct
            FROM fact GROUP BY txn_hour, part_of_day""", upto="fact")
    for key, limit in (("r06_watchlist", 250), ("r06_watchlist_slice", 300), ("r06_watchlist_top20", 20)):
        q[key] = t(
            f"""SELECT terminal_id, total_txns, fraud_txns, fraud_rate_pct, fraud_volume, unique_customers, risk_tier
                FROM dim_terminal WHERE fraud_txns > 0 ORDER BY fraud_volume DESC, terminal_id LIMIT {limit}""",
            upto="dim_terminal")
    q["r07_segment"] = t(
        f"""SELECT value_segment, count(*) AS customers, {big('sum(total_txns)')} AS txns,
                   round({dbl('sum(CAST(total_spend AS DECIMAL(18,2)))')}, 2) AS spend, {big('sum(fraud_txns)')} AS fraud_txns,
                   {pct('sum(fraud_txns)', 'sum(total_txns)', 3)} AS fraud_rate_pct,
                   count(*) FILTER (WHERE fraud_txns > 0) AS customers_hit
            FROM dim_customer GROUP BY value_segment""", upto="dim_customer")
    q["r08_threshold_view"] = t(
        "SELECT * FROM sweep WHERE threshold BETWEEN 100 AND 400", upto="fact", extra=SWEEP)
    view = """view AS (
        SELECT transaction_id, txn_datetime, date, month_name, day_name, is_weekend, customer_id, value_segment,
               terminal_id, risk_tier AS terminal_risk_tier, CAST(amount AS DOUBLE) AS amount, amount_band, txn_hour,
               part_of_day, amount_vs_cust_avg, mins_since_prev_txn, is_fraud, fraud_type FROM """ + JOINED + ")"
    for key, limit in (("r09_stratified_extract", 40_000), ("r09_stratified_extract_small", 2_000)):
        q[key] = t(
            f"""SELECT * FROM view WHERE is_fraud = 1 UNION ALL
                (SELECT * FROM view WHERE is_fraud = 0
                 ORDER BY md5('{S.SEED}-' || CAST(transaction_id AS VARCHAR)), transaction_id LIMIT {limit})""",
            upto="dim_terminal", extra=view)
    q["r10_heat_map"] = t(
        f"""SELECT part_of_day, amount_band, count(*) AS txns, {BAD} AS fraud_txns, {rate} AS fraud_rate_pct
            FROM fact GROUP BY ALL""", upto="fact")
    cells = ", ".join(
        f"max(rate) FILTER (WHERE amount_band = '{b}') AS band_{b[:2]}" for b in S.BAND_LABELS)
    q["r10_heat_pivot"] = t(
        f"SELECT part_of_day, {cells} FROM (SELECT part_of_day, amount_band, {rate} AS rate FROM fact GROUP BY ALL) GROUP BY part_of_day",
        upto="fact")
    q["r11_amount_histogram"] = t(
        f"""SELECT is_fraud, bin, n, round(100e0 * n / sum(n) OVER (PARTITION BY is_fraud), 9) AS pct_of_class
            FROM (SELECT is_fraud, CAST(floor(amount / 10) * 10 AS INTEGER) AS bin, count(*) AS n
                  FROM fact WHERE amount < 600 GROUP BY ALL)""", upto="fact")
    curve = f"""curve AS (
        SELECT terminal_id, 100e0 * row_number() OVER o / count(*) OVER () AS pct_terminals,
               100e0 * {dbl('sum(CAST(fraud_volume AS DECIMAL(18,2))) OVER (ORDER BY fraud_volume DESC, terminal_id ROWS UNBOUNDED PRECEDING)')}
                 / {dbl('sum(CAST(fraud_volume AS DECIMAL(18,2))) OVER ()')} AS cum_pct
        FROM dim_terminal WINDOW o AS (ORDER BY fraud_volume DESC, terminal_id))"""
    q["r12_pareto_curve"] = t(
        "SELECT terminal_id, round(pct_terminals, 6) AS pct_terminals, round(cum_pct, 6) AS cum_pct FROM curve",
        upto="dim_terminal", extra=curve)
    q["r12_pareto_readings"] = t(
        """SELECT round(max(cum_pct) FILTER (WHERE pct_terminals <= 5), 6) AS at_5,
                  round(max(cum_pct) FILTER (WHERE pct_terminals <= 10), 6) AS at_10 FROM curve""",
        upto="dim_terminal", extra=curve)
    q["r13_portfolio_header"] = t(
        f"""SELECT count(*) AS total_txns, {BAD} AS total_fraud, {dbl(VALUE)} AS total_value, {dbl(LOSS)} AS fraud_value,
                   round({pct('sum(is_fraud)', 'count(*)')}, 9) AS fraud_rate_pct,
                   round({pct(LOSS, VALUE)}, 9) AS value_at_risk_pct,
                   min(txn_day) AS first_day, max(txn_day) AS last_day FROM fact""", upto="fact")
    q["r14_headline_shares"] = t(
        f"""SELECT fraud_type, round_even(100e0 * loss_value / sum(loss_value) OVER (), 1) AS share_of_loss_pct,
                   round(100e0 * incidents / sum(incidents) OVER (), 9) AS share_of_incidents_pct,
                   row_number() OVER (ORDER BY loss_value DESC, fraud_type) = 1 AS is_top,
                   (SELECT round(({dbl('sum(amount) FILTER (WHERE is_fraud = 1)')} / sum(is_fraud))
                     / ({dbl('sum(amount) FILTER (WHERE is_fraud = 0)')} / sum(1 - is_fraud)), 9) FROM fact) AS ratio_of_means
            FROM types""", upto="fact", extra=types)
    q["r15_band_levels"] = t(
        f"""SELECT amount_band, rate AS fraud_rate_pct, round_even(rate / p, 1) AS lift,
                   CASE WHEN rate > 2 * p THEN 'above twice portfolio' WHEN rate > p THEN 'above portfolio'
                        ELSE 'at or below portfolio' END AS flag,
                   round(100e0 * (SELECT sum(txns) FROM b WHERE rn <= 3) / (SELECT sum(txns) FROM b), 9) AS lowest_bands_pct_of_txns,
                   (SELECT {big('sum(bad)')} FROM b WHERE rn <= 3) AS lowest_bands_fraud_txns
            FROM b, (SELECT {pct('sum(is_fraud)', 'count(*)')} AS p FROM fact)""",
        upto="fact",
        extra=f"""b AS (SELECT amount_band, count(*) AS txns, {BAD} AS bad, {rate} AS rate,
                               row_number() OVER (ORDER BY amount_band) AS rn FROM fact GROUP BY amount_band)""")
    q["r16_watchlist_view"] = t(
        f"""SELECT * FROM (SELECT terminal_id, total_txns, fraud_txns, fraud_rate_pct, fraud_volume, unique_customers, risk_tier
                FROM dim_terminal WHERE fraud_txns > 0 ORDER BY fraud_volume DESC, terminal_id LIMIT 300)
            WHERE risk_tier IN ('{S.RISK_TIERS[0]}', '{S.RISK_TIERS[1]}')
            ORDER BY fraud_volume DESC, terminal_id LIMIT 60""", upto="dim_terminal")
    impact = SIMPLE_MEASURES["m19_customer_impact_rate"][1]
    q["r17_segment_matrix"] = t(
        f"""SELECT value_segment, count(DISTINCT customer_id) FILTER (WHERE is_fraud = 1) AS customers_affected,
                   {impact} AS customer_impact_rate_pct, round({RATE}, 9) AS fraud_rate_pct,
                   round({RATE} / (SELECT {RATE} FROM fact), 9) AS risk_lift
            FROM {JOINED} GROUP BY value_segment""", upto="dim_terminal")
    q["r18_executive_view"] = t(
        f"""SELECT count(*) AS total_transactions, coalesce({dbl(VALUE)}, 0) AS total_value, coalesce({BAD}, 0) AS fraud_transactions,
                   round({RATE}, 9) AS fraud_rate_pct, {dbl(LOSS)} AS fraud_loss,
                   round({_ratio0(LOSS, VALUE)} * 100, 9) AS value_at_risk_pct
            FROM {JOINED} WHERE {FILTERED}""", upto="dim_terminal")
    whole = f"({RATE} / nullif((SELECT {RATE} FROM fact), 0))"
    text = f"printf('%.1f', round({whole}, 1)) || 'x)'"
    q["r19_terminal_table"] = t(
        f"""SELECT terminal_id, count(*) AS total_transactions, {BAD} AS fraud_transactions, round({RATE}, 9) AS fraud_rate_pct,
                   {dbl(LOSS)} AS fraud_loss,
                   CASE WHEN {whole} IS NULL THEN '-' WHEN {whole} >= 5 THEN 'Critical (' || {text}
                        WHEN {whole} >= 2 THEN 'High (' || {text} WHEN {whole} >= 1.2 THEN 'Elevated (' || {text}
                        ELSE 'Normal (' || {text} END AS risk_lift_label, any_value(risk_tier) AS risk_tier
            FROM {JOINED} GROUP BY terminal_id""", upto="dim_terminal")
    q["r19_terminal_pareto_top"] = t(
        f"""SELECT terminal_id, {dbl('loss')} AS fraud_loss, round({_ratio0('cum', 'whole')} * 100, 9) AS cumulative_loss_pct
            FROM (SELECT *, sum(loss) OVER (ORDER BY loss DESC RANGE UNBOUNDED PRECEDING) AS cum, sum(loss) OVER () AS whole
                  FROM (SELECT terminal_id, {LOSS} AS loss FROM fact GROUP BY terminal_id))
            ORDER BY loss DESC, terminal_id LIMIT 100""", upto="fact")
